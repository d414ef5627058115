"""Prefix sums over an order of unbounded length: rows are cut into blocks along the order, the blocks' sums are accumulated, and within each block a window goes on from there.

Blocks are cut at quantiles of a sample, so they are even whatever the values
(clustered, or over all 64 bits). Where the cuts fall changes how the work is
spread, never a sum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in a block, about; blocks at most; rows of the sample for each block.
ROWS, MOST, SAMPLE = 4096, 1 << 14, 8


def quantiles(keys: DataFrame, rows: int = ROWS) -> np.ndarray:
    """Cuts between blocks: rows of as many longs as keys has columns, none of them null. Collects SAMPLE x MOST rows at most, about."""
    n = keys.count()
    parts = min(MOST, n // rows)
    if parts < 2:
        return np.empty((0, len(keys.columns)), np.int64)
    got = keys.sample(min(1.0, SAMPLE * parts / n), 7).toArrow()
    values = np.stack([c.to_numpy() for c in got.columns], 1) if got.num_rows else np.empty((0, len(keys.columns)), np.int64)
    values = values[np.lexsort(values.T[::-1])]
    at = np.unique(np.arange(1, parts) * len(values) // parts)
    return np.unique(values[at], axis=0) if len(values) else values


def block(keys: list[Column], cuts: np.ndarray) -> Column:
    """The number of cuts that are not above the keys, by binary search: it ascends with them."""
    if not len(cuts):
        return F.lit(0)
    columns = [F.split(F.lit(",".join(map(str, c.tolist()))), ",").cast("array<bigint>") for c in cuts.T]

    def above(at: Column) -> Column:
        out = F.lit(False)
        for key, column in reversed(list(zip(keys, columns))):
            own = F.get(column, at)
            out = (own > key) | ((own == key) & out)
        return out

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        lower = above(mid)
        moved = F.struct(F.when(lower, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(lower, mid).otherwise(s["hi"]).alias("hi"))
        return F.when(s["lo"] < s["hi"], moved).otherwise(s)

    rounds = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step, lambda s: s["lo"])
