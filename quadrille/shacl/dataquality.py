"""Checks of data quality that compare values with one another, with a check digit or with a trusted reference.

Each check is one DataFrame of violations (as validate() gives them) over all
nodes at once; over tables it stays on native columns. Without a class it holds
for every node that has the property, with one for the class's instances only.
Values are compared as text, so 7 and "7" agree. What compares nodes or looks up
a reference is an equi-join or a grouping, never a pair of all with all: the
uniqueness check reports a node once for each value that another node has too.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ast as A
from ..plans.engine import Engine
from ..plans.solutions import Solutions
from ..terms import IRI, TERM, Term, iri
from ..vocab import RDF


class DataQuality:
    def __init__(self, spark: SparkSession, source: Any) -> None:
        self.engine = Engine(spark, source)

    def found(self, properties: dict[str, str], cls: str | None = None, via: tuple[str, str] | None = None) -> Solutions:
        """Solutions of f and of each name, whose property it is; via: (name, property), whose node has the property instead."""
        f = A.Var("f")
        parts: list[A.Triple] = [A.Triple(f, Term(IRI, RDF.type), iri(cls))] if cls else []
        for name, p in properties.items():
            at = f
            if via and via[0] == name:
                at = A.Var("between")
                parts.append(A.Triple(f, Term(IRI, via[1]), at))
            parts.append(A.Triple(at, Term(IRI, p), A.Var(name)))
        return self.engine.group(A.Group(tuple(A.Triple(t.s, A.Link(t.p.lex), t.o) for t in parts)))

    def rows(self, sols: Solutions, *names: str) -> DataFrame:
        """(f, <name>, <name>_text ...)"""
        cols = [sols.values["f"].term().alias("f")]
        for n in names:
            cols += [sols.values[n].term().alias(n), sols.values[n].text().alias(f"{n}_text")]
        return sols.df.select(*cols)

    @staticmethod
    def violations(rows: DataFrame, path: str | None, value: Column | None, what: str, message: str) -> DataFrame:
        v = F.lit(None).cast(TERM) if value is None else value
        return rows.select(F.col("f").alias("focus"), F.lit(path).cast("string").alias("path"), v.alias("value"), F.lit("Violation").alias("severity"), F.lit(message).alias("message"), F.lit(f"urn:quadrille:dq:{what}").alias("shape"), F.lit(what).alias("constraint"))

    def ean13(self, p: str, cls: str | None = None) -> DataFrame:
        """Thirteen digits of which the last checks the others."""
        rows = self.rows(self.found({"v": p}, cls), "v")
        digit = lambda i: F.substring("v_text", i, 1).cast("int")
        total = sum((digit(i) * (3 if i % 2 == 0 else 1) for i in range(1, 14)), F.lit(0))
        good = F.when(F.col("v_text").rlike("^[0-9]{13}$"), total % 10 == 0).otherwise(False)
        return self.violations(rows.where(~good), p, F.col("v"), "ean13", "the check digit is wrong")

    def unique(self, p: str, cls: str | None = None) -> DataFrame:
        """No value that two nodes share."""
        rows = self.rows(self.found({"v": p}, cls), "v").distinct()
        twice = rows.groupBy("v_text").agg(F.min("f").alias("a"), F.max("f").alias("b")).where("a <> b").select("v_text")
        return self.violations(rows.join(twice, "v_text"), p, F.col("v"), "unique", "another node has the value too")

    def _reference(self, cls: str, **properties: str) -> DataFrame:
        rows = self.rows(self.found(properties, cls), *properties)
        return rows.select(*(F.col(f"{n}_text").alias(n) for n in properties)).distinct()

    def legal(self, p: str, reference_class: str, reference_property: str, cls: str | None = None, via: str | None = None) -> DataFrame:
        """Only values that the reference has. via: a property to the node that has p."""
        rows = self.rows(self.found({"v": p}, cls, ("v", via) if via else None), "v")
        ref = self._reference(reference_class, r=reference_property)
        return self.violations(rows.join(ref, F.col("v_text") == F.col("r"), "left_anti"), p, F.col("v"), "legal", "the reference lacks the value")

    def illegal(self, p: str, reference_class: str, reference_property: str, cls: str | None = None) -> DataFrame:
        """No value that the reference has."""
        rows = self.rows(self.found({"v": p}, cls), "v")
        ref = self._reference(reference_class, r=reference_property)
        return self.violations(rows.join(ref, F.col("v_text") == F.col("r"), "left_semi"), p, F.col("v"), "illegal", "the reference forbids the value")

    def implies(self, p: str, value: str, target: str, target_value: str, cls: str | None = None) -> DataFrame:
        """A node with one value has that other value, too."""
        rows = self.rows(self.found({"v": p}, cls), "v").where(F.col("v_text") == value).select("f").distinct()
        ok = self.rows(self.found({"w": target}), "w").where(F.col("w_text") == target_value).select("f")
        return self.violations(rows.join(ok, "f", "left_anti"), target, None, "implies", f"{value} without {target_value}")

    def empty_when(self, p: str, value: str, empty: str) -> DataFrame:
        """A node with the value has an empty text there."""
        return self.implies(p, value, empty, "")

    def trusted_pair(self, p1: str, p2: str, reference_class: str, reference1: str, reference2: str, cls: str | None = None, via: str | None = None) -> DataFrame:
        """Pairs of values only that one node of the reference has. via: a property to the node that has p1."""
        rows = self.rows(self.found({"v": p1, "w": p2}, cls, ("v", via) if via else None), "v", "w")
        ref = self._reference(reference_class, r=reference1, q=reference2)
        return self.violations(rows.join(ref, (F.col("v_text") == F.col("r")) & (F.col("w_text") == F.col("q")), "left_anti"), p1, F.col("v"), "trusted_pair", "the reference lacks the pair")
