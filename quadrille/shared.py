"""Cutting lineage: tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        warnings.warn(f"spark.checkpoint.dir is unset: intermediate tables of this local session go to {at}", stacklevel=2)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder: what comes after doesn't compute it again, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.settled_at = path
    return made


def forget(*made: DataFrame) -> None:
    """Deletes what settled() wrote; no later step may read it. Other DataFrames are left alone."""
    for df in made:
        if path := getattr(df, "settled_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def once(df: DataFrame) -> DataFrame:
    """The rows, each once. They meet by their hash before any are gathered: where nearly all differ, gathering them in the tasks that read them would hold a whole file's."""
    return df.repartition(*df.columns).distinct()


def spread(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """The inner join of a and b on pairs of equal columns (all rows with all if there are none), for results much larger than both: each key's pairs are dealt to all tasks. Row for row of b, a's rows are repeated once for each task."""
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = a.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = b.withColumn("_share", F.pmod(F.xxhash64(*b.columns), F.lit(n)).cast("int"))
    x, y = [k for k, _ in keys] + ["_part"], [k for _, k in keys] + ["_share"]
    left, right = left.repartition(n, *x), right.repartition(n, *y)  # with a number, so that small inputs aren't put into one task
    on = F.col("_part") == F.col("_share")
    for k, m in keys:
        on = on & (F.col(k) == F.col(m))
    return left.join(right.hint("merge"), on).drop("_part", "_share")
