"""Statements as a stream: lines in, quads out, batches appended or validated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.turtle import parsed_lines


def read_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """(g, s, p, o) of the N-Triples or N-Quads files that come to a folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parsed_lines(reader.text(folder))


def append(quads: DataFrame, table: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Goes on appending to a Parquet folder partitioned by predicate; exactly once, by the checkpoint."""
    return quads.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy("p").trigger(**(trigger or {"availableNow": True})).start()


def each_batch(quads: DataFrame, checkpoint: str, use: Callable[[DataFrame, int], None], **trigger: object) -> StreamingQuery:
    """Hands each batch on, for example to a validator."""
    return quads.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
