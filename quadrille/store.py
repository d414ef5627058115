"""A store of quads in files: each commit is a version, partitioned by predicate, and old versions stay readable."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import Repository
from .errors import GraphError
from .sources.quads import QuadSource
from .terms import QUADS, TERM


class QuadStore:
    """A folder on any file system that Spark reads. A commit writes its files first and names them in a small file of its own last, which another writer of the same version makes fail: readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._file("versions")
        return sorted(int(f.getPath().getName().partition(".")[0]) for f in fs.listStatus(at)) if fs.exists(at) else []

    def _entry(self, version: int | None) -> dict | None:
        there = self.versions()
        if not there:
            return None
        if version is not None and version not in there:
            raise GraphError(f"no version {version}")
        fs, at = self._file(f"versions/{there[-1] if version is None else version}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def quads(self, version: int | None = None) -> DataFrame:
        """(g, s, p, o) of a version, the latest if none is named. A filter on p reads only the folders of those predicates."""
        entry = self._entry(version)
        if entry is None:
            return self.spark.createDataFrame([], QUADS)
        rows = self.spark.read.schema(f"g string, s {TERM}, o {TERM}, predicate string").parquet(f"{self.path}/{entry['data']}")
        return rows.select("g", "s", F.col("predicate").alias("p"), "o")

    def source(self, version: int | None = None) -> QuadSource:
        return QuadSource(self.quads(version))

    def repository(self, version: int | None = None) -> Repository:
        repo = Repository(self.spark, self.quads(version))
        entry = self._entry(version)
        repo.graphs = set(entry["graphs"]) if entry else set()
        repo.base_version = max(self.versions(), default=-1) if version is None else version
        return repo

    def commit(self, quads: DataFrame, graphs: list[str] = [], expected: int | None = None) -> int:  # noqa: B006
        """Writes a version; its number. expected: the version that the writer started from; if another came since, nothing changes and a GraphError says so."""
        there = self.versions()
        latest = max(there, default=-1)
        if expected is not None and expected != latest:
            raise GraphError(f"version {latest} came after {expected}")
        data = f"data/{uuid.uuid4().hex}"
        quads.select("g", "s", "o", F.col("p").alias("predicate")).repartition("predicate", F.pmod(F.xxhash64("s"), F.lit(32))).write.partitionBy("predicate").parquet(f"{self.path}/{data}")
        fs, at = self._file(f"versions/{latest + 1}.json")
        try:
            stream = fs.create(at, False)
        except Exception as e:
            raise GraphError(f"version {latest + 1} was written by another") from e
        stream.write(bytearray(json.dumps({"data": data, "graphs": sorted(graphs)}).encode()))
        stream.close()
        return latest + 1

    def save(self, repository: Repository) -> int:
        """A repository that repository() gave, with its changes, as the next version."""
        return self.commit(repository.quads, sorted(repository.graphs), getattr(repository, "base_version", None))
