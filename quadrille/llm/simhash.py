"""SimHash near-duplicates by deletion-variant signatures.

Each text gets a 128-bit SimHash over its words, weighted by the root of their
counts, and a 128-bit sketch of its word shingles: each shingle falls into TURNS
of 128 bins, a bin keeps one bit of its least hash (an empty one that of the next
bin), so two sketches differ in about half of the share of shingles that the
texts don't have in common. Two texts are near copies if their signatures differ
in at most ``max_bits`` bits and their sketches in at most ``max_sketch``: words
alone would take very long unrelated texts of one language for copies, as their
word frequencies converge. Groups are the connected components.

The signature is cut into ``ceil((max_bits + 1) / 2)`` segments, so by the
pigeonhole principle one segment of a near pair differs in at most one bit. The
index has a one-wildcard variant for each bit of each segment; segments that
differ in at most one bit share a variant. What is shuffled is coarser: the
wildcards of one block of bits share a key (the segment with the block wiped
out), so a signature travels BLOCKS times a segment and not once a bit. The rows
of a key are sorted by what the block holds; those that hold the same or differ
in one bit of it, which are those that share a variant, are compared in full:
nothing within the bounds is missed. Exact copies of signature and sketch are
collapsed before, and a comparison goes from what is reached to what is not
reached yet, so of a group of thousands of copies only a spanning forest is made.
A key of more than SLICE rows is cut into slices, and each pair of slices is a
task of its own: no task holds more than two slices, whatever the group.

Work grows with the square of the corpus, over 2 to the segments' width (14 bits
at the bounds used here): 17 bits are needed for the recall of near copies.
Fewer ``max_bits`` make wider segments for a corpus of very many documents.

Defined results. A null text has no signature: its row is a group of its own
and is kept. Texts without a word (empty ones too) are copies of one another.
Rows that share a doc_id count as one document: their groups are one. A null
doc_id can't be named: such rows get a null group, match nothing and are kept.
Of a group the row with the least doc_id stays; among repeated rows of that
doc_id the least by (text, source, lang, n_chars), then by all columns as JSON.
doc_id must be a whole number or a string of one. Columns other than doc_id
and text are never looked at by the grouping, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, forget, fresh, written

BITS, MAX_BITS, MAX_SKETCH = 128, 17, 38
#: Words whose hash a task remembers.
CACHE = 1 << 18
#: Words of a shingle, the bins that each shingle falls into, and what hashes them: sums of word hashes times FACTORS, modulo PRIME, times TURNS.
SHINGLE, BINS, FACTORS, PRIME = 3, 128, (402_653_189, 331_804_471, 273_041_119), 2**44 - 17
TURNS = (1, 174_763, 233_021, 349_529, 402_049, 451_669, 486_041, 519_947)
#: Keys of a segment; rows of a key that one task compares; rows that a task gathers before it compares; candidates compared at once.
BLOCKS, SLICE, CHUNK, AT_ONCE = 3, 1 << 20, 1 << 19, 1 << 20
#: Groups of rows whose product is above this are compared as matrices.
SMALL = 2048


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; a pair within max_bits differs by at most one bit in one of them."""
    n = max(-(-(max_bits + 1) // 2), 3)
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class Signer:
    """A text's signature and sketch, as four signed longs."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.empty((CACHE, BITS), np.int8)
        self.codes: dict[str, int] = {}

    def words(self, counts: Counter) -> np.ndarray:
        sums = np.zeros(BITS, np.int64)
        words = list(counts)
        weights = np.floor(16 * np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))).astype(np.float32)
        for a in range(0, len(words), 8192):  # so that float32 sums are exact and long texts take little memory
            part = words[a : a + 8192]
            if len(self.ids) + len(part) > CACHE:
                self.ids, self.codes = {}, {}
            new = [w for w in part if w not in self.ids]
            if new:
                start = len(self.ids)
                digests = b"".join(hashlib.md5(w.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for w in new)
                self.rows[start : start + len(new)] = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS).astype(np.int8) * 2 - 1
                self.ids.update(zip(new, range(start, start + len(new))))
                self.codes.update(zip(new, np.frombuffer(digests, ">u4")[::4].tolist()))
            ids = self.ids
            sums += (weights[a : a + 8192] @ self.rows[[ids[w] for w in part]].astype(np.float32)).astype(np.int64)
        return sums > 0

    def shingles(self, words: list[str]) -> np.ndarray:
        """The bits of the bins."""
        code, out = self.codes.get, np.full(BINS, np.iinfo(np.int64).max)
        for a in range(0, max(1, len(words) - SHINGLE + 1), 1 << 16):
            own = words[a : a + (1 << 16) + SHINGLE - 1]
            h = np.zeros(max(len(own), SHINGLE), np.int64)
            got = [code(w) for w in own]
            if None in got:  # forgotten within a very long text
                got = [int.from_bytes(hashlib.md5(w.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:4], "big") if c is None else c for w, c in zip(own, got)]
            h[: len(own)] = got
            n = len(h) - SHINGLE + 1
            x = sum(h[k : k + n] * f for k, f in enumerate(FACTORS)) % PRIME
            x = (x[:, None] * np.array(TURNS) % PRIME).ravel()
            np.minimum.at(out, x % BINS, x // BINS)
        held = np.flatnonzero(out < np.iinfo(np.int64).max)
        return (out[held[np.searchsorted(held, np.arange(BINS)) % len(held)]] & 1).astype(bool)

    def __call__(self, text: str) -> tuple[int, int, int, int]:
        words = WORD.findall(text.lower())
        if not words:
            return 0, 0, 0, 0
        counts = Counter(words)
        return tuple(np.packbits(np.r_[self.words(counts), self.shingles(words)]).view(">i8").tolist())


COLUMNS = ("hi", "lo", "s1", "s2")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer = Signer()
    for batch in batches:
        signed = list(zip(*map(signer, batch.column(1).to_pylist()))) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in signed)], ["id", *COLUMNS])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def signatures(docs: DataFrame) -> DataFrame:
    """(id, hi, lo, s1, s2) of each row that has a doc_id and a text."""
    return _texts(docs).mapInArrow(_sign, "id long, hi long, lo long, s1 long, s2 long")


def blocks(max_bits: int, per: int = BLOCKS) -> list[tuple[int, int, int, int]]:
    """(first bit, width, first bit of the block within, width of the block) of each key of a signature."""
    return [(first, width, width * k // per, width * (k + 1) // per - width * k // per) for first, width in segments(max_bits) for k in range(per)]


def _values(hi: np.ndarray, lo: np.ndarray, first: int, width: int) -> np.ndarray:
    """The bits of a signature from the first on, as numbers; hi and lo are unsigned."""
    if first + width <= 64:
        return (hi >> np.uint64(64 - first - width)) & np.uint64((1 << width) - 1)
    if first >= 64:
        return (lo >> np.uint64(128 - first - width)) & np.uint64((1 << width) - 1)
    right = first + width - 64
    return ((hi & np.uint64((1 << (64 - first)) - 1)) << np.uint64(right)) | (lo >> np.uint64(64 - right))


def _keys(hi: np.ndarray, lo: np.ndarray, max_bits: int) -> Iterator[np.ndarray]:
    for n, (first, width, at, wide) in enumerate(blocks(max_bits)):
        wiped = ((1 << width) - 1) & ~(((1 << wide) - 1) << (width - at - wide))
        yield (_values(hi, lo, first, width) & np.uint64(wiped)).astype(np.int64) | (n << 48)


def _unsigned(batch: pa.RecordBatch, start: int, n: int = 2) -> list[np.ndarray]:
    return [batch.column(start + i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(n)]


def _tally(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def result() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])
            counts.clear()
            return made

        for batch in batches:
            for key in _keys(*_unsigned(batch, 0), max_bits):
                counts.update(dict(zip(*(x.tolist() for x in np.unique(key, return_counts=True)))))
            if len(counts) > CACHE:
                yield result()
        yield result()

    return run


def _spread(max_bits: int, slices: dict[int, int]):
    """A row for each key of a signature; where a key is cut into slices, one for each pair of slices that has the row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(sorted(slices), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 10_000):
                batch = whole.slice(start, 10_000)
                hi, lo = _unsigned(batch, 1)
                key = np.stack(list(_keys(hi, lo, max_bits)), 1)
                row = np.repeat(np.arange(len(hi)), key.shape[1])
                key, part = key.ravel(), np.zeros(key.size, np.int64)
                at = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
                if at.any():
                    more: list[tuple[int, int, int]] = []
                    mixed = (hi * np.uint64(0x9E3779B97F4A7C15)) ^ (lo * np.uint64(0xBF58476D1CE4E5B9))
                    for r, k in zip(row[at].tolist(), key[at].tolist()):
                        n = slices[k]
                        own = int(mixed[r] >> np.uint64(40)) % n
                        more += [(r, k, min(own, i) * n + max(own, i) + 1) for i in range(n)]
                    extra = np.array(more, np.int64)
                    row, key, part = (np.r_[x[~at], extra[:, i]] for i, x in enumerate((row, key, part)))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), *(c.take(pa.array(row)) for c in batch.columns)], ["key", "part", "id", *COLUMNS])

    return run


class Forest:
    """Edges between near rows of one task, none that closes a circle."""

    def __init__(self, id_: np.ndarray, sig: list[np.ndarray], max_bits: int, max_sketch: int) -> None:
        self.id, self.sig, self.max_bits, self.max_sketch = id_, sig, max_bits, max_sketch
        self.parent = np.arange(len(id_))
        self.edges: list[tuple[int, int]] = []

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows, those that are near."""
        hi, lo, s1, s2 = self.sig
        first = np.bitwise_count(hi[a] ^ hi[b])
        keep = np.flatnonzero(first <= self.max_bits)
        a, b, first = a[keep], b[keep], first[keep]
        keep = (first + np.bitwise_count(lo[a] ^ lo[b]) <= self.max_bits) & (np.bitwise_count(s1[a] ^ s1[b]) + np.bitwise_count(s2[a] ^ s2[b]) <= self.max_sketch)
        return a[keep], b[keep]

    def matrix(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The near pairs of a row of a with one of b."""
        hi = self.sig[0]
        x, y = np.nonzero(np.bitwise_count(hi[a][:, None] ^ hi[b][None, :]) <= self.max_bits)
        return self.near(a[x], b[y])

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        got = p[x]
        while True:
            up = p[got]
            if (up == got).all():
                p[x] = got
                return got
            got = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        apart = self.roots(a) != self.roots(b)
        p = self.parent
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            rx, ry = x, y
            while p[rx] != rx:
                rx = p[rx]
            while p[ry] != ry:
                ry = p[ry]
            if rx != ry:
                p[max(rx, ry)] = min(rx, ry)
                self.edges.append((x, y))

    def pairs(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> None:
        """Compares runs of rows, given by start and length, each of a with that of b in the same place; a run with itself if both start alike."""
        size = na * nb
        for big in np.flatnonzero(size > SMALL).tolist():
            self.explore(np.arange(a[big], a[big] + na[big]), np.arange(b[big], b[big] + nb[big]) if a[big] != b[big] else None)
        rest = np.flatnonzero((size > 0) & (size <= SMALL))
        ends = np.cumsum(size[rest])
        start = 0
        while start < len(rest):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
            own = rest[start:stop]
            n = size[own]
            of = np.repeat(np.arange(len(own)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wide = nb[own][of]
            x, y = a[own][of] + k // wide, b[own][of] + k % wide
            once = x < y
            self.join(*self.near(x[once], y[once]))
            start = stop

    def explore(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """Joins the near rows of two sets, or those of one. Floods from one row while that reaches many, else compares block by block."""
        one, dense = b is None, True
        b = a if one else b
        while len(a) and len(b):
            if dense:
                before = len(a) + len(b)
                a, b = self.flood(a, b, one)
                dense = before - len(a) - len(b) > before // 8
                continue
            s = a[: max(1, min(256, (1 << 24) // len(b)))]
            a = a[len(s) :]
            if one:
                b = a
                x, y = self.matrix(s, s)
                self.join(x[x < y], y[x < y])
            x, y = self.matrix(s, b)
            self.join(x, y)
            dense = len(x) > 4 * (len(s) + len(b))

    def flood(self, a: np.ndarray, b: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
        """Joins all that the first row of a reaches; returns what is left. Each row reached is compared with all that is left on the other side, so none of its near rows is missed."""
        sides = [a[1:], a[1:] if one else b]
        queue, side = a[:1], 0
        while len(queue):
            side = 1 - side
            found, at, step = [], 0, 1
            while at < len(queue) and len(sides[side]):
                x, y = self.matrix(queue[at : at + step], sides[side])
                at, step = at + step, max(1, min(4 * step, 256, (1 << 24) // len(sides[side])))
                if len(y):
                    self.join(x, y)
                    found.append(np.unique(y))
                    sides[side] = sides[side][~np.isin(sides[side], found[-1])]
            queue = np.concatenate([queue[:0], *found])
            if one:
                sides[1 - side] = sides[side]
        return sides[0], sides[1]


def _compare(key: np.ndarray, id_: np.ndarray, sig: list[np.ndarray], max_bits: int, max_sketch: int) -> list[tuple[int, int]]:
    """Edges that join whatever is near among the rows of each key. Rows of one key and part are together."""
    layout = blocks(max_bits)
    number = key[:, 0] >> 48
    held = np.zeros(len(id_), np.int64)
    for n in np.unique(number).tolist():
        first, width, at, wide = layout[n]
        own = number == n
        held[own] = ((_values(sig[0][own], sig[1][own], first, width) >> np.uint64(width - at - wide)) & np.uint64((1 << wide) - 1)).astype(np.int64)
    order = np.lexsort((held, key[:, 1], key[:, 0]))
    key, held, number = key[order], held[order], number[order]
    forest = Forest(id_[order], [c[order] for c in sig], max_bits, max_sketch)
    new = np.r_[True, (key[1:] != key[:-1]).any(1) | (held[1:] != held[:-1])]
    start = np.flatnonzero(new)
    n = np.diff(np.r_[start, len(held)])
    group, value = np.cumsum(np.r_[True, (key[start[1:]] != key[start[:-1]]).any(1)]), held[start]
    most = max(b[3] for b in layout)
    code = group << most | value
    for bit in range(most):
        low = np.flatnonzero(value >> bit & 1 == 0)
        to = np.searchsorted(code, code[low] | 1 << bit)
        there = (to < len(code)) & (code[np.minimum(to, len(code) - 1)] == code[low] | 1 << bit)
        low, to = low[there], to[there]
        forest.pairs(start[low], n[low], start[to], n[to])
    same = np.flatnonzero((number[start] % BLOCKS == 0) & (n > 1))  # an equal segment comes under each of its keys: once is enough
    forest.pairs(start[same], n[same], start[same], n[same])
    return [(int(forest.id[x]), int(forest.id[y])) for x, y in forest.edges]


def _verify(max_bits: int, max_sketch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, due = 0, CHUNK

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            cols = [np.concatenate(c) for c in zip(*held)]
            key, part = cols[:2]
            before = np.flatnonzero((key != key[-1]) | (part != part[-1]))  # the last key may go on
            cut = len(key) if last else int(before[-1]) + 1 if len(before) else 0
            held, size = [[c[cut:] for c in cols]], len(key) - cut
            if cut:
                edges = _compare(np.stack([key[:cut], part[:cut]], 1), cols[2][:cut], [c[:cut].view(np.uint64) for c in cols[3:]], max_bits, max_sketch)
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([min(e) for e in edges], pa.int64()), pa.array([max(e) for e in edges], pa.int64())], ["a", "b"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)])
            size += batch.num_rows
            if size >= due:
                yield from flush(False)
                due = CHUNK + 2 * size
        if size:
            yield from flush(True)

    return run


def near_pairs(signed: DataFrame, max_bits: int = MAX_BITS, max_sketch: int = MAX_SKETCH, slice_rows: int = SLICE) -> DataFrame:
    """Edges (a, b), a < b, that join every near pair of distinct (id, hi, lo, s1, s2), directly or through others."""
    tally = signed.select("hi", "lo").mapInArrow(_tally(max_bits), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # few come to the driver: of each of the BLOCKS x segments layouts at most a share 1 / slice_rows of the rows, and at these bounds 2^10
    slices = {r.key: -(-r.n // slice_rows) for r in tally.where(F.col("n") > slice_rows).collect()}
    keys = signed.select("id", *COLUMNS).mapInArrow(_spread(max_bits, slices), "key long, part long, id long, hi long, lo long, s1 long, s2 long")
    together = keys.repartition("key", "part").sortWithinPartitions("key", "part")
    return together.mapInArrow(_verify(max_bits, max_sketch), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, group) of every id in an edge but the least of each component; group is that least id. Large star and small star by turns, each a minimum joined back, so a hub's neighbours are never gathered."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        large = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = written(large.distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        old, now = now, written(small, "edges")
        forget(old, large)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("group"))
        state = new


def _joined(signed: DataFrame, key: list[str], distinct: DataFrame, edges: Callable[[], DataFrame]) -> DataFrame:
    # rows of one doc_id under several signatures, and reps that stand for several signatures, are one node already
    member = signed.join(distinct.select(*key, "rep"), key).select("id", "rep").distinct()
    several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    links = member.join(several.select("id", "a"), "id").select("a", F.col("rep").alias("b")).union(several.select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")))
    found = components(edges().union(links))
    to = found.withColumnRenamed("id", "rep")
    return member.join(to, "rep", "left").select("id", F.coalesce("group", "rep").alias("group")).groupBy("id").agg(F.min("group").alias("group"))


def groups(docs: DataFrame, max_bits: int = MAX_BITS, max_sketch: int = MAX_SKETCH) -> DataFrame:
    """(id, group) of each distinct doc_id that has a text."""
    signed = written(signatures(docs), "signatures")
    distinct = written(signed.groupBy(*COLUMNS).agg(F.min("id").alias("rep")), "distinct")
    return _joined(signed, list(COLUMNS), distinct, lambda: near_pairs(distinct.withColumnRenamed("rep", "id"), max_bits, max_sketch))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, max_sketch: int = MAX_SKETCH) -> DataFrame:
    """(doc_id, group_id, keep) of each row of docs; of repeated rows of a doc_id one row is returned."""
    found = groups(docs, max_bits, max_sketch)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").isNull().alias("bare"))
    alone = named.where("doc_id IS NOT NULL AND bare").select("doc_id").distinct().join(found.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    rows = found.select(F.col("id").alias("doc_id"), F.col("group").alias("group_id")).union(alone.select("doc_id", F.col("doc_id").alias("group_id")))
    lost = named.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("group_id"))
    return rows.union(lost).select("doc_id", "group_id", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)).alias("keep"))


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS, max_sketch: int = MAX_SKETCH) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns."""
    key, mark = fresh(docs, "dedup_id", "dedup_mark")
    id_ = F.col("doc_id").cast("long")
    gone = groups(docs, max_bits, max_sketch).where("id <> group").select(F.col("id").alias(key))
    # doc_ids of several rows; written, so that Spark knows their number: the texts are shuffled for them only if they are many
    several = written(docs.select(id_.alias(key)).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "several")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = docs.withColumn(key, id_).join(several, key, "left_anti").join(gone, key, "left_anti").select(*columns)
    order = [*(F.col(c) for c in ("text", "source", "lang", "n_chars") if c in docs.columns), F.to_json(F.struct(*columns))]
    rows = docs.withColumn(key, id_).join(several.join(gone, key, "left_anti"), key)
    one = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias(mark)).select(f"{mark}.*")
    return single.unionByName(one)
