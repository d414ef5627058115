"""A corpus from raw documents to shards: five of the corpus operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next. All but the last return the
columns of documents; the last adds shard_id. What a stage decides takes effect:
rejected, duplicate and contaminated documents are gone, sampled ones come as
often as they were drawn. Nulls, empty texts, repeated rows, ties, empty tables
and extra columns have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontaminate, mixing, ordinal, sharding, simhash
from quadrille.llm.common import forget, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted to labels, rejects go."""
    return ordinal.select(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are sampled to their target weights."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the shard of the best contiguous partition."""
    return sharding.assign(docs)


STAGES = [("quality_classifier", quality_classifier), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("source_mixing", source_mixing), ("sharding", shards)]

#: SQL can't fit the classifier of the first stage; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)  # what this stage has read
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
