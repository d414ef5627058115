"""Mixing sources to target weights by systematic sampling.

A source's share of the mixture is its target weight over the sum of weights;
the mixture has as many characters as the input. A document of source s is thus
expected ``weight_s x total / (sum of weights x characters_s)`` times. Expected
copies are summed along the order of doc_id within the source, one random offset
in [0, 1) is added, and a document is emitted once for each integer boundary
that its stretch crosses: the copies of each source add up to the expected
number, rounded up or down, and each document comes floor or ceil of its
expectation times. All of it is done in whole millionths, so every engine and
every retry gets the same rows; the offset comes from a seed and the source.

The weights are given as {source: integer}; without them (the setting used
here) each source weighs the root of its characters, which flattens hot sources.

A hot source is no bottleneck: prefix sums are made in blocks of (doc_id, length,
hash of the text) (see ordered.py), so no task handles a source, or one doc_id, as
a whole; only rows that are equal in all three are together. Whole rows are
shuffled once, by (source, block).

Given weights are whole numbers of at most 12 digits, or a ValueError says so.

Defined results. Null sources are a source of their own. A source without a
character is emitted once per document, as is one that weights leave at no size.
Null doc_ids come first in their source; ties of doc_id are ordered by the
length of the text and its hash, and repeated rows are sampled one by one. A
source that the given weights lack weighs 0 and goes. An empty table gives no
rows. Extra columns are handed on, also where their names clash with ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written
from .ordered import block, quantiles

UNIT, SEED = 1_000_000, 17


def emissions(docs: DataFrame, weights: dict[str, int] | None = None, seed: int = SEED) -> tuple[DataFrame, str]:
    """docs, each row as often as it is emitted, and the name of an added column that counts a row's copies from 1."""
    src, blk, rate, start, rank, copy, has, size = fresh(docs, "mix_source", "mix_block", "mix_rate", "mix_start", "mix_rank", "mix_copy", "mix_has", "mix_size")
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keys = [id_.isNotNull().cast("long"), F.coalesce(id_, F.lit(0).cast("long")), F.coalesce(F.length(text), F.lit(-1)).cast("long"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))]
    cuts = quantiles(docs.select(*(k.alias(f"k{n}") for n, k in enumerate(keys))))
    if weights is not None and any(not 0 <= int(v) < 10**12 for v in weights.values()):
        raise ValueError("weights must be from 0 to 12 digits")
    # a null source sorts with no other: real ones get a prefix
    keyed = docs.withColumn(src, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).withColumn(blk, block(keys, cuts))
    sums = written(keyed.groupBy(src, blk).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length(text), F.lit(0))).cast("long").alias(size)), "sums")
    per = sums.groupBy(src).agg(F.sum(size).alias("size"))
    if weights is None:
        per = per.withColumn("w", F.floor(F.sqrt(F.col("size").cast("double"))).cast("long"))
    else:
        known = [(f"={k}" if k is not None else "", int(v)) for k, v in weights.items()] or [("=", 0)]
        listed = docs.sparkSession.createDataFrame(known, f"`{src}` string, w long")
        per = per.join(listed, src, "left").withColumn("w", F.coalesce("w", F.lit(0).cast("long")))
    whole = per.agg(F.sum("size").alias("b"), F.sum("w").alias("ws"))
    exact = F.expr(f"(CAST(w AS DECIMAL(12,0)) * CAST(b AS DECIMAL(17,0)) * CAST({UNIT} AS DECIMAL(7,0))) div (CAST(ws AS DECIMAL(16,0)) * CAST(size AS DECIMAL(18,0)))")
    r = F.when((F.col("size") == 0) | (F.col("ws") == 0), F.lit(UNIT)).otherwise(exact)
    u = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(src)).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(UNIT))
    rated = per.crossJoin(whole).select(src, r.cast("long").alias(rate), u.alias("u"))
    before = F.sum("n").over(Window.partitionBy(src).orderBy(blk).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    begun = sums.join(rated, src).select(src, blk, rate, (before * F.col(rate) + F.col("u")).alias(start))
    order = [id_.asc_nulls_first(), F.length(text).asc_nulls_first(), F.xxhash64(text)]
    ranked = keyed.join(begun.hint("shuffle_hash"), [src, blk]).withColumn(rank, F.row_number().over(Window.partitionBy(src, blk).orderBy(*order)).cast("long"))
    crossed = F.expr(f"(`{start}` + `{rank}` * `{rate}`) div {UNIT} - (`{start}` + (`{rank}` - 1) * `{rate}`) div {UNIT}")
    out = ranked.withColumn(has, crossed).where(F.col(has) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(has))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), copy), copy


def sample(docs: DataFrame, weights: dict[str, int] | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copy), a row for each emission."""
    out, copy = emissions(docs, weights, seed)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(copy).alias("copy"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, seed: int = SEED) -> DataFrame:
    """The emitted rows, with the columns of docs."""
    out, copy = emissions(docs, weights, seed)
    return out.drop(copy)
