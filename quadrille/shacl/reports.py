"""Validation reports for reading: JSON, Turtle, Markdown. Counts are made where the data are; of the results themselves the first ones, in order, come to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.turtle import to_turtle
from ..vocab import PREFIXES
from .validate import as_triples

_RANK = {"Violation": 0, "Error": 0, "Warning": 1}


def summary(violations: DataFrame) -> dict:
    """Whether the data conform, and the number of results by severity, shape and constraint."""
    rows = violations.groupBy("severity", "shape", "constraint").count().collect()
    by = lambda name: {k: sum(r["count"] for r in rows if r[name] == k) for k in sorted({r[name] for r in rows})}
    return {"conforms": not any(r["severity"] in ("Violation", "Error") for r in rows), "results_total": sum(r["count"] for r in rows), "by_severity": by("severity"), "by_shape": by("shape"), "by_constraint": by("constraint")}


def _first(violations: DataFrame, most: int | None) -> list[dict]:
    rank = F.when(F.col("severity").isin("Violation", "Error"), 0).when(F.col("severity") == "Warning", 1).otherwise(2)
    rows = violations.select(rank.alias("rank"), F.col("focus.lex").alias("focus"), "path", F.col("value.lex").alias("value"), "severity", "message", "shape", "constraint").orderBy("rank", "focus", "shape", "constraint", "value").drop("rank")
    return [r.asDict() for r in (rows if most is None else rows.limit(most)).collect()]


def by_resource(violations: DataFrame) -> DataFrame:
    """(focus, n, worst) of each focus node."""
    rank = F.when(F.col("severity").isin("Violation", "Error"), 0).when(F.col("severity") == "Warning", 1).otherwise(2)
    return violations.groupBy(F.col("focus.lex").alias("focus")).agg(F.count(F.lit(1)).alias("n"), F.min_by("severity", rank).alias("worst"))


def to_json(violations: DataFrame, most: int | None = None) -> str:
    """most: results that are written out, all if None; the counts are always those of all."""
    return json.dumps({**summary(violations), "results": _first(violations, most)}, ensure_ascii=False, indent=1)


def to_markdown(violations: DataFrame, most: int | None = 100, title: str = "Quality report") -> str:
    s = summary(violations)
    out = [f"# {title}", "", f"The data {'conform' if s['conforms'] else 'do not conform'}: {s['results_total']} results.", "", "| Severity | Results |", "| --- | --- |"]
    out += [f"| {k} | {n} |" for k, n in sorted(s["by_severity"].items(), key=lambda x: (_RANK.get(x[0], 2), x[0]))]
    cell = lambda x: str(x if x is not None else "").replace("|", "\\|").replace("\n", " ")
    out += ["", "| Severity | Focus | Path | Value | Message |", "| --- | --- | --- | --- | --- |"]
    out += [f"| {cell(r['severity'])} | {cell(r['focus'])} | {cell(r['path'])} | {cell(r['value'])} | {cell(r['message'])} |" for r in _first(violations, most)]
    return "\n".join(out) + "\n"


def report_turtle(violations: DataFrame) -> str:
    return to_turtle(as_triples(violations), {"sh": PREFIXES["sh"]})
