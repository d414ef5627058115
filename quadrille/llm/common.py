"""What the corpus operators share: names, the shared folder, token regexes."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of letters and digits; SQL writes it ``[\p{L}\p{N}]+``.
WORD = re.compile(r"[^\W_]+")
#: What ``str.split()`` splits at, as a class for RE2.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until it clashes with no column of df (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        warnings.warn(f"spark.checkpoint.dir is unset: intermediate tables of this local session go to {at}", stacklevel=2)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends here and no lost executor can undo it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def forget(*made: DataFrame) -> None:
    """Deletes what written() wrote; no later step may read it."""
    for df in made:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
