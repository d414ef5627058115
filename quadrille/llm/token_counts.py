"""Token counts of documents without token ids.

Each text is cut into pre-tokens; of each batch of documents the frequencies are
gathered by pre-token (which documents hold it how often, as packed integers),
so a frequent pre-token is one row per batch and not one per document. The
distinct pre-tokens of the corpus are tokenised once each, their piece counts
are joined to the frequencies by pre-token, and the products are summed: first
per batch within each partition of the join, sorted by batch so that a task holds
the sums of one batch at a time, then per document. No list of ids is ever made.

Defined results. One row per input row, repeated ones too; null doc_ids are
handed on. Null and empty texts have 0 tokens. An empty table gives no rows. A
pre-token of any length or frequency counts in full. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import CHUNK, PATTERN, encoding

#: Documents in a batch; positions in it fit into 16 bits.
BATCH = 1 << 14
#: Chunks counted at a time, and entries packed at a time.
RUN = 1 << 18
#: Bytes, about, of chunks and entries at which a task hands on what it has of a batch.
HELD = 160 << 20
_TOP = 255
_findall = regex.compile(PATTERN).findall


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _pieces(chunk: str) -> list[str]:
    if chunk[chunk[0] == " " :].isalpha():
        return [chunk]
    head, last = chunk[:-1], chunk[-1]
    if head[head[:1] == " " :].isalpha() and not last.isalnum() and last != "'":
        return [head, last]
    return _findall(chunk)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens of the texts; beyond about HELD bytes of chunks, those so far."""
    for batch in batches:
        chunks: set[str] = set()
        for i, found in chain(_cut(batch.column(0)), [(-1, [])]):
            chunks.update(found)
            if i < 0 or 200 * len(chunks) > HELD:
                pieces = set(chain.from_iterable(map(_pieces, chunks)))
                chunks = set()
                yield pa.RecordBatch.from_arrays([pa.array(sorted(pieces), pa.string())], ["piece"])


def distinct_pretokens(docs: DataFrame) -> DataFrame:
    return _rows(docs).select("text").mapInArrow(_distinct, "piece string").distinct()


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(p)) for p in batch.column(0).to_pylist()], pa.int64())], ["piece", "n"])

    return run


class _Numbers(dict):
    """Numbers its keys from 0 as they are asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class _Chunks(dict):
    """Numbers chunks likewise, and the pre-tokens of all: flat has those of chunk i from start[i] to start[i + 1]. size: bytes held, about."""

    def __init__(self) -> None:
        self.pieces, self.flat, self.start, self.size = _Numbers(), array("i"), array("q", [0]), 0

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.flat.extend([self.pieces[p] for p in _pieces(chunk)])
        self.start.append(len(self.flat))
        self.size += 200 + len(chunk)
        return n


def _cut(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The number of a text and its chunks, those of a long text in several parts."""
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        if len(t) <= RUN:
            yield i, CHUNK.findall(t)
        else:
            found = map(re.Match.group, CHUNK.finditer(t))
            while part := list(islice(found, RUN)):
                yield i, part


def _entries(chunks: _Chunks, token: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Sorted numbers that have a pre-token's number above bit 24, the text's above bit 8 and the frequency, at most _TOP, below."""
    flat, start = np.array(chunks.flat), np.array(chunks.start)
    n = start[token + 1] - start[token]
    at = np.repeat(start[token] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    key, often = np.unique(flat[at].astype(np.int64) << 16 | np.repeat(text, n), return_counts=True)
    times = -(-often // _TOP)  # a frequency beyond _TOP takes several entries
    last = np.cumsum(times) - 1
    value = np.full(int(times.sum()), _TOP)
    value[last] = often - _TOP * (times - 1)
    return np.repeat(key, times) << 8 | value


def _gather(texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray]]:
    """Pre-tokens of a batch and their sorted entries. Whatever the texts, a task holds about HELD bytes of them and the chunks of one run: beyond that it hands on what it has and begins anew, even within a text."""
    chunks, held, tokens, of, n = _Chunks(), [], [], [], 0
    for i, found in chain(_cut(texts), [(-1, [])]):
        tokens.append(np.fromiter(map(chunks.__getitem__, found), np.int32, len(found)))
        of.append(i)
        n += len(found)
        if n >= RUN or i < 0 and n:
            held.append(_entries(chunks, np.concatenate(tokens), np.repeat(of, [len(t) for t in tokens])))
            tokens, of, n = [], [], 0
        if held and not n and (i < 0 or chunks.size + 8 * sum(map(len, held)) > HELD):
            pieces, key = list(chunks.pieces), np.concatenate(held)
            chunks, held = _Chunks(), []
            key.sort()
            yield pieces, key


def _pack(which: np.ndarray, docs: np.ndarray, often: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a cell for each piece: the texts' numbers in 2 bytes each, then the frequencies in 1 each."""
    n = np.bincount(which, minlength=pieces)
    start = np.cumsum(n) - n
    i = np.arange(len(which)) - start[which]
    out, begin = np.empty(3 * len(which), np.uint8), 3 * start[which]
    out[begin + 2 * i], out[begin + 2 * i + 1], out[begin + 2 * n[which] + i] = docs & 255, docs >> 8, often
    return 3 * np.r_[0, np.cumsum(n)], out


def _unpack(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of the cell, that of the text and the frequency, of each entry."""
    n = np.fromiter(map(len, cells), np.int64, len(cells)) // 3
    data = np.frombuffer(b"".join(cells), np.uint8).astype(np.int64)
    start, which = np.cumsum(n) - n, np.repeat(np.arange(len(cells)), n)
    i, begin = np.arange(len(which)) - start[which], 3 * start[which]
    return which, data[begin + 2 * i] + 256 * data[begin + 2 * i + 1], data[begin + 2 * n[which] + i]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, piece, packed texts and frequencies), and one that has the batch's doc_ids, under a key that no pre-token can be: NUL and a digit are never in one."""
    names = ["batch", "piece", "data"]
    for number, whole in enumerate(batches):
        for at in range(0, max(1, whole.num_rows), BATCH):
            batch = whole.slice(at, BATCH)
            own = batch.column(0)
            ids = own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + own.is_null().to_numpy(zero_copy_only=False).tobytes()
            uid = xxhash.xxh64_intdigest(ids, _task() * 1_000_003 + number * 4099 + at) - (1 << 63)
            yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([f"\0{uid + (1 << 63)}"], pa.string()), pa.array([ids], pa.binary())], names)
            for pieces, key in _gather(batch.column(1)):
                a = 0
                while a < len(key):  # about RUN entries at a time, all of a pre-token together
                    b = int(np.searchsorted(key, ((key[min(a + RUN, len(key)) - 1] >> 24) + 1) << 24))
                    part, first, last = key[a:b], int(key[a] >> 24), int(key[b - 1] >> 24) + 1
                    offsets, packed = _pack((part >> 24) - first, part >> 8 & 0xFFFF, part & 255, last - first)
                    data = pa.BinaryArray.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(last - first, uid, np.int64)), pa.array(pieces[first:last], pa.string()), data], names)
                    a = b


def _task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pieces x frequency by batch and position, over one partition of the join, which is sorted by batch; doc_ids pass."""
    names = ["batch", "ids", "sums"]
    now, held = None, np.zeros(BATCH)

    def result() -> pa.RecordBatch:
        at = np.flatnonzero(held)
        packed = at.astype("<u2").tobytes() + held[at].astype("<u4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([None], pa.binary()), pa.array([packed], pa.binary())], names)

    for batch in batches:
        other = pc.is_null(batch.column(2))
        own = batch.filter(other)
        if own.num_rows:
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1).cast(pa.binary()), pa.nulls(own.num_rows, pa.binary())], names)
        rest = batch.filter(pc.invert(other))
        uids, n, data = rest.column(0).to_numpy(), rest.column(2).to_numpy(), rest.column(1)
        starts = np.r_[np.flatnonzero(np.r_[True, uids[1:] != uids[:-1]]), len(uids)] if len(uids) else np.zeros(1, int)
        for first in range(0, len(starts) - 1, 32):
            edges = starts[first : first + 33]
            a, b = int(edges[0]), int(edges[-1])
            which, text, often = _unpack(data.slice(a, b - a).to_pylist())
            run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            sums = np.bincount(run[which] * BATCH + text, often * n[a:b][which], (len(edges) - 1) * BATCH).reshape(-1, BATCH)
            for uid, got in zip(uids[edges[:-1]].tolist(), sums):
                if uid != now and now is not None:
                    yield result()
                    held = np.zeros(BATCH)
                now, held = uid, held + got
    if now is not None:
        yield result()


def _total(group: pa.Table) -> pa.Table:
    ids = next(x for x in group.column("ids").to_pylist() if x is not None)
    n = len(ids) // 9
    sums = np.zeros(n, np.int64)
    for s in group.column("sums").to_pylist():
        if s:
            k = len(s) // 6
            sums[np.frombuffer(s, "<u2", k)] += np.frombuffer(s, "<u4", k, 2 * k)
    lost = np.frombuffer(ids, bool, n, 8 * n)
    return pa.table({"doc_id": pa.array(np.frombuffer(ids, "<i8", n), pa.int64(), mask=lost), "n_tokens": pa.array(sums, pa.int64())})


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) of each row."""
    counted = distinct_pretokens(docs).mapInArrow(_count(vocabulary), "piece string, n long")
    frequencies = _rows(docs).mapInArrow(_frequencies, "batch long, piece string, data binary")
    joined = frequencies.join(counted, "piece", "left").select("batch", "data", "n").sortWithinPartitions("batch")
    partial = joined.mapInArrow(_partial, "batch long, ids binary, sums binary")
    return partial.groupBy("batch").applyInArrow(_total, "doc_id long, n_tokens long")
