"""A repository of named graphs with updates and transactions."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GraphError
from .plans import ast as A
from .plans.engine import Engine
from .plans.parser import parse_update
from .shared import settled
from .sources.quads import QuadSource
from .sources.turtle import read
from .terms import QUADS


class Repository:
    """Quads as an immutable DataFrame that each change replaces. graphs: the names of graphs, those without a quad too."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, services: dict[str, Any] | None = None) -> None:
        self.spark, self.services = spark, services or {}
        self.quads = (quads if quads is not None else spark.createDataFrame([], QUADS)).select("g", "s", "p", "o")
        self.graphs: set[str] = set()

    # reading
    @property
    def engine(self) -> Engine:
        return Engine(self.spark, QuadSource(self.quads), self.services)

    def query(self, text: str | Any) -> DataFrame:
        return self.engine.run(text)

    def select(self, text: str | Any) -> DataFrame:
        return self.engine.select(text)

    def ask(self, text: str | Any) -> bool:
        return bool(self.engine.ask(text).first()[0])

    def select_or_none(self, text: str | Any) -> DataFrame | None:
        from .errors import QuadrilleError

        try:
            return self.select(text)
        except QuadrilleError:
            return None

    def graph(self, name: str | None = None) -> DataFrame:
        """(s, p, o); a graph that isn't there is the default one."""
        if name is not None and self.has_graph(name):
            return self.quads.where(F.col("g") == name).select("s", "p", "o")
        return self.quads.where("g IS NULL").select("s", "p", "o")

    def has_triple(self, s: Any, p: str, o: Any) -> bool:
        return self.ask(A.Ask(A.Group((A.Triple(s, A.Link(p), o),))))

    def list_graphs(self) -> list[str]:
        return sorted(self.graphs | {r[0] for r in self.quads.where("g IS NOT NULL").select("g").distinct().collect()})

    def has_graph(self, name: str) -> bool:
        return name in self.graphs or not self.quads.where(F.col("g") == name).isEmpty()

    def statistics(self) -> DataFrame:
        return self.quads.groupBy("g").agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"))

    # writing
    def add(self, quads: DataFrame) -> None:
        self.quads = settled(self.quads.unionByName(quads.select("g", "s", "p", "o")).distinct(), "quads")

    def remove(self, quads: DataFrame) -> None:
        gone = quads.select("g", "s", "p", "o").distinct()
        same = reduce(lambda a, b: a & b, [self.quads[c].eqNullSafe(gone[c]) for c in ("g", "s", "p", "o")])
        self.quads = settled(self.quads.join(gone, same, "left_anti"), "quads")

    def create_graph(self, name: str) -> None:
        if self.has_graph(name):
            raise GraphError(f"graph {name} exists")
        self.graphs.add(name)

    def remove_graph(self, name: str) -> bool:
        there = self.has_graph(name)
        self.graphs.discard(name)
        self.quads = self.quads.where(~F.col("g").eqNullSafe(F.lit(name)))
        return there

    def transaction(self) -> "Transaction":
        return Transaction(self)

    def update(self, text: str | A.Update, prefixes: dict[str, str] | None = None) -> None:
        """All operations of a request, one after the other; none if one of them fails."""
        ops = (parse_update(text, prefixes) if isinstance(text, str) else text).ops
        with self.transaction():
            for op in ops:
                self._apply(op)

    def _made(self, quads: tuple, sols: Any, default: str | None) -> DataFrame:
        out = []
        for g, t in quads:
            name = sols.values[g.name].text() if isinstance(g, A.Var) else F.lit(default if g is None else g.lex)
            out.append(self.engine.instantiate((t,), sols, name.cast("string")))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], QUADS)

    def _apply(self, op: Any) -> None:
        from .plans.solutions import Solutions

        if isinstance(op, A.InsertData):
            self.add(self._made(op.quads, Solutions.unit(self.spark), None))
        elif isinstance(op, A.DeleteData):
            self.remove(self._made(op.quads, Solutions.unit(self.spark), None))
        elif isinstance(op, A.Modify):
            engine = self.engine
            if op.using or op.using_named:
                engine = Engine(self.spark, engine.source.dataset(op.using, op.using_named), self.services)
            elif op.with_:
                engine = Engine(self.spark, QuadSource(self.quads, (op.with_,)), self.services)
            sols = engine.group(op.where)
            sols = Solutions(settled(sols.df, "solutions"), sols.values, sols.maybe)  # both templates see the same ones
            gone, new = self._made(op.delete, sols, op.with_), self._made(op.insert, sols, op.with_)
            if op.delete:
                self.remove(gone)
            if op.insert:
                self.add(new)
        elif isinstance(op, A.Load):
            try:
                rows = read(self.spark, op.source)
                self.add(rows.withColumn("g", F.lit(op.into)) if op.into else rows)
            except Exception:
                if not op.silent:
                    raise
        else:
            self._graph_op(op)

    def _picked(self, ref: str):
        return {"DEFAULT": F.col("g").isNull(), "NAMED": F.col("g").isNotNull(), "ALL": F.lit(True)}.get(ref, F.col("g").eqNullSafe(F.lit(ref)))

    def _graph_op(self, op: A.GraphOp) -> None:
        special = op.source in ("DEFAULT", "NAMED", "ALL")
        if op.op == "create":
            if not (op.silent and self.has_graph(op.source)):
                self.create_graph(op.source)
            return
        if not special and not self.has_graph(op.source):
            if op.silent or op.op == "clear":
                return
            raise GraphError(f"no graph {op.source}")
        if op.op in ("clear", "drop"):
            self.quads = self.quads.where(~self._picked(op.source))
            if op.op == "drop":
                self.graphs = set() if op.source in ("NAMED", "ALL") else self.graphs - {op.source}
            elif not special:
                self.graphs.add(op.source)
            return
        if op.source == op.target:
            return
        to = F.lit(None if op.target == "DEFAULT" else op.target).cast("string")
        rows = self.quads.where(self._picked(op.source)).withColumn("g", to)
        kept = self.quads if op.op == "add" else self.quads.where(~self._picked(op.target))
        if op.op == "move":
            kept = kept.where(~self._picked(op.source))
            self.graphs.discard(op.source)
        self.quads = settled(kept.unionByName(rows).distinct(), "quads")
        if op.target != "DEFAULT":
            self.graphs.add(op.target)


class Transaction:
    """Restores the repository as it was if what runs inside fails."""

    def __init__(self, repository: Repository) -> None:
        self.repository = repository

    def __enter__(self) -> Repository:
        self.before = (self.repository.quads, set(self.repository.graphs))
        return self.repository

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is not None:
            self.repository.quads, self.repository.graphs = self.before
