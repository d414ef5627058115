"""Quads as a source of triple patterns: a DataFrame (g, s, p, o); a null g is the default graph."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Value, matches
from ..plans import ast as A
from ..plans.solutions import Solutions
from ..terms import IRI, QUADS, Term


class QuadSource:
    """defaults: named graphs whose union is the default graph (else the quads without a graph); named: those that GRAPH sees (else all)."""

    def __init__(self, quads: DataFrame, defaults: tuple[str, ...] | None = None, named: tuple[str, ...] | None = None, mixed_default: bool = False) -> None:
        self.quads, self.defaults, self.named, self.mixed = quads, defaults, named, mixed_default
        self.spark = quads.sparkSession

    @staticmethod
    def of_triples(triples: DataFrame) -> "QuadSource":
        return QuadSource(triples.select(F.lit(None).cast("string").alias("g"), "s", "p", "o"))

    @staticmethod
    def of_rows(spark: Any, rows: list[tuple[Term, str, Term] | tuple[str | None, Term, str, Term]]) -> "QuadSource":
        made = [(None, r[0].row, r[1], r[2].row) if len(r) == 3 else (r[0], r[1].row, r[2], r[3].row) for r in rows]
        return QuadSource(spark.createDataFrame(made, QUADS).distinct())

    def dataset(self, froms: tuple[str, ...], named: tuple[str, ...]) -> "QuadSource":
        return QuadSource(self.quads, tuple(froms), tuple(named))

    def triples(self, graph: Any = None) -> DataFrame:
        """(s, p, o) of a graph: the default one, a named one, or for a variable all named ones. A set."""
        q = self.quads
        if graph is None:
            if self.mixed:
                return q.select("s", "p", "o").distinct()
            if self.defaults is None:
                return q.where("g IS NULL").select("s", "p", "o")
            rows = q.where(F.col("g").isin(*self.defaults)).select("s", "p", "o")
            return rows.distinct() if len(self.defaults) != 1 else rows
        rows = q.where("g IS NOT NULL") if isinstance(graph, A.Var) else q.where(F.col("g") == graph)
        if self.named is not None:
            rows = rows.where(F.col("g").isin(*self.named))
        return rows.select("s", "p", "o", *(["g"] if isinstance(graph, A.Var) else []))

    def around(self, terms: list[Term]) -> DataFrame:
        return self.triples()

    def stars(self, patterns: list[A.Triple], graph: Any = None) -> list[Solutions]:
        return [self.pattern(t, graph) for t in patterns]

    def pattern(self, t: A.Triple, graph: Any = None) -> Solutions:
        rows = self.triples(graph)
        values: dict[str, Value] = {}
        conditions = []
        whole = [(t.s, Value("term", F.col("s"))), (t.p, Value("iri", F.col("p"))), (t.o, Value("term", F.col("o")))]
        if isinstance(graph, A.Var):
            whole.append((graph, Value("iri", F.col("g"))))
        for n, v in whole:
            if isinstance(n, Term):
                conditions.append(F.col("p") == n.lex if v.form == "iri" and n.kind == IRI else matches(v, n))
            elif n.name in values:
                conditions.append(values[n.name].term() == v.term())
            else:
                values[n.name] = v
        if conditions:
            rows = rows.where(reduce(lambda a, b: a & b, conditions))
        return Solutions.of(rows, values)
