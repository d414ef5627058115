"""Minimax contiguous partition into shards.

Documents go to shards in the order of doc_id. The rows of one doc_id are an
atomic group that is never split; its size is the sum of their characters. Of
all partitions into at most ``shards`` runs of groups the one sought has the
smallest largest shard. Whether a capacity is enough is checked greedily (each
shard takes groups while they fit), the smallest feasible capacity is found by
binary search, and the groups are cut there.

The check is exact but needs few groups on the driver. Prefix sums are made in
blocks of ids (see ordered.py), and blocks are cut into leaves of LEAF groups.
The driver holds the sums of the blocks (ordered.MOST at most). For a capacity
it guesses where the cuts fall, fetches the leaves there, all in one job, then
goes from cut to cut and fetches only what the guess missed: a leaf a shard, of
LEAF groups each, however large the largest document and however many the
shards. Leaves stay until there are more than HELD of them, so the later steps
of the search, which move the cuts little, fetch next to nothing. A cut is an
id, so placing a document is a comparison with the cuts: the texts are neither
shuffled nor joined.

Defined results. Null and empty texts have size 0 and go with their place in
the order. Rows with a null doc_id are one group, before all others. An empty
table gives no rows. Fewer groups than shards leave shards unused; shard ids
count from 0 without gaps. Other columns are handed on by assign().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written
from .ordered import block, quantiles

SHARDS = 64
#: Groups of a leaf; leaves that the driver holds.
LEAF, HELD = 4096, 1024


def sizes(docs: DataFrame) -> DataFrame:
    """(id, size) of each atomic group."""
    size = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long")
    return docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.sum(size).alias("size"))


def prefixes(groups: DataFrame) -> DataFrame:
    """(block, leaf, id, prefix): the running sum of sizes in the order of id."""
    keys = [F.col("id").isNotNull().cast("long"), F.coalesce("id", F.lit(0).cast("long"))]
    cuts = quantiles(groups.select(keys[0].alias("a"), keys[1].alias("b")))
    cut = groups.withColumn("block", block(keys, cuts))
    sums = cut.groupBy("block").agg(F.sum("size").alias("s"))
    before = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))
    order = Window.partitionBy("block").orderBy("id")
    leaf = F.floor((F.row_number().over(order) - 1) / LEAF).cast("int")
    within = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(before, "block").select("block", leaf.alias("leaf"), "id", (F.col("before") + within).alias("prefix"))


class Prefixes:
    """The prefix sums in order, of which the driver reads those leaves that it is asked for."""

    def __init__(self, running: DataFrame) -> None:
        self.running = running
        self.blocks, self.block_ends = self.ends(running.groupBy("block"), "block")
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.total = int(self.block_ends[-1]) if len(self.blocks) else 0

    @staticmethod
    def ends(grouped, name: str) -> tuple[np.ndarray, np.ndarray]:
        got = grouped.agg(F.max("prefix").alias("end")).toArrow()
        at, end = got.column(name).to_numpy(), got.column("end").to_numpy()
        order = np.argsort(at)
        return at[order], end[order]

    @staticmethod
    def before(ends: np.ndarray, target: int) -> int:
        """The first run that ends beyond the target, or else the last: the last prefix that is not above the target is in it or ends the run before it."""
        return min(int(np.searchsorted(ends, target, "right")), len(ends) - 1)

    def load(self, targets: list[int]) -> None:
        """Reads the leaves of all targets, in one job for what is missing of each level."""
        want = {int(self.blocks[self.before(self.block_ends, t)]) for t in targets}
        missing = sorted(want - self.leaves.keys())
        if missing:
            got = self.running.where(F.col("block").isin(missing)).groupBy("block", "leaf").agg(F.max("prefix").alias("end")).toArrow()
            block_, leaf, end = (got.column(c).to_numpy() for c in ("block", "leaf", "end"))
            for b in missing:
                own = np.flatnonzero(block_ == b)
                own = own[np.argsort(leaf[own])]
                self.leaves[b] = leaf[own], end[own]
        cells = {self.place(t) for t in targets}
        new = sorted(cells - self.held.keys())
        if new:
            if len(self.held) + len(new) > HELD:
                self.held = {k: v for k, v in self.held.items() if k in cells}
            code = F.col("block").cast("long") * (1 << 32) + F.col("leaf")
            # at most LEAF rows for each target
            rows = self.running.where(F.col("block").isin(sorted({x for x, _ in new})) & code.isin([(x << 32) + y for x, y in new])).select("block", "leaf", "prefix").toArrow()
            block_, leaf, prefix = (rows.column(c).to_numpy() for c in ("block", "leaf", "prefix"))
            for cell in new:
                self.held[cell] = np.sort(prefix[(block_ == cell[0]) & (leaf == cell[1])])

    def place(self, target: int) -> tuple[int, int]:
        b = int(self.blocks[self.before(self.block_ends, target)])
        names, ends = self.leaves[b]
        return b, int(names[self.before(ends, target)])

    def last(self, target: int) -> int | None:
        """The last prefix that is not above the target; None if its leaf isn't held."""
        b = int(self.blocks[self.before(self.block_ends, target)])
        if b not in self.leaves or (cell := self.place(target)) not in self.held:
            return None
        prefix = self.held[cell]
        n = int(np.searchsorted(prefix, target, "right"))
        if n:
            return int(prefix[n - 1])
        at, of = self.before(self.leaves[b][1], target), self.before(self.block_ends, target)
        return int(self.leaves[b][1][at - 1]) if at else int(self.block_ends[of - 1]) if of else 0

    def greedy(self, capacity: int, most: int) -> list[int] | None:
        """The prefix at the end of each shard, or None if more than most are needed."""
        cuts, base = [], 0
        while base < self.total:
            if len(cuts) == most:
                return None
            got = self.last(min(base + capacity, self.total))
            if got is None:
                self.load([min(base + k * capacity, self.total) for k in range(1, most - len(cuts) + 1) if base + (k - 1) * capacity < self.total])
                got = self.last(min(base + capacity, self.total))
            base = got
            cuts.append(base)
        return cuts


def best_cuts(groups: DataFrame, shards: int = SHARDS) -> list[int | None]:
    """The last id of each shard of the best partition."""
    total, most = groups.agg(F.sum("size"), F.max("size")).first()
    if total is None:
        return []
    running = written(prefixes(groups), "prefixes")
    sums = Prefixes(running)
    low = max(most, -(-total // shards))
    high = low + most
    while low < high:
        mid = (low + high) // 2
        if sums.greedy(mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    ends = sums.greedy(low, shards) or [0]
    # of groups without a character at a cut, the last belongs to the shard
    last = running.where(F.col("prefix").isin(ends)).groupBy("prefix").agg(F.max("id").alias("id")).collect()
    forget(running)
    by = {r.prefix: r.id for r in last}
    return [by[e] for e in ends]


def shard_of(id_: Column, cuts: list[int | None]) -> Column:
    """The number of cuts below the id, by a tree of comparisons."""
    if len(cuts) < 2:
        return F.lit(0)
    half = (len(cuts) - 1) // 2
    last = cuts[half]
    left, right = shard_of(id_, cuts[: half + 1]), shard_of(id_, cuts[half + 1 :]) + F.lit(half + 1)
    return F.when(id_.isNull() if last is None else id_.isNull() | (id_ <= F.lit(last)), left).otherwise(right)


def plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, n_chars, shard_id) of each doc_id; n_chars is the size of its group."""
    groups = written(sizes(docs), "sizes")
    at = shard_of(F.col("id"), best_cuts(groups, shards))
    return groups.select(F.col("id").alias("doc_id"), F.col("size").alias("n_chars"), at.cast("int").alias("shard_id"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with a column shard_id added (a column of that name is replaced)."""
    groups = written(sizes(docs), "sizes")
    cuts = best_cuts(groups, shards)
    forget(groups)
    return docs.withColumn("shard_id", shard_of(F.col("doc_id").cast("long"), cuts).cast("int"))
