"""Sets of solutions: a DataFrame with a column for each variable, and what is known of each."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Value, constant
from ..shared import spread


def column(name: str) -> str:
    return f"v_{name}"


@dataclass
class Solutions:
    df: DataFrame
    values: dict[str, Value]
    maybe: frozenset[str] = field(default_factory=frozenset)  # may be unbound

    @staticmethod
    def of(df: DataFrame, values: dict[str, Value], maybe: frozenset[str] | set[str] = frozenset()) -> "Solutions":
        """Selects the values from df, one column each."""
        kept = [v.col.alias(column(n)) for n, v in values.items()]
        return Solutions(df.select(*kept, *([] if kept else [F.lit(1).alias("unit")])), {n: v.at(column(n)) for n, v in values.items()}, frozenset(maybe))

    @staticmethod
    def unit(spark: SparkSession) -> "Solutions":
        return Solutions(spark.range(1).select(F.lit(1).alias("unit")), {})

    def none(self) -> "Solutions":
        return Solutions(self.df.where(F.lit(False)), self.values, self.maybe)

    def project(self, names: list[str]) -> "Solutions":
        values = {n: self.values.get(n) or constant(None) for n in names}
        return Solutions.of(self.df, values, {n for n in names if n in self.maybe or n not in self.values})

    def distinct(self) -> "Solutions":
        return Solutions(self.df.distinct(), self.values, self.maybe)

    def cast(self, names: set[str]) -> "Solutions":
        """With these variables as term structs."""
        return Solutions.of(self.df, {n: v.as_term() if n in names else v for n, v in self.values.items()}, self.maybe)

    def where(self, condition: Column) -> "Solutions":
        return Solutions(self.df.where(condition), self.values, self.maybe)

    def native(self) -> DataFrame:
        """Plain columns named like the variables."""
        return self.df.select(*(v.native().alias(n) for n, v in self.values.items()))

    def terms(self) -> DataFrame:
        """Term structs named like the variables; null is unbound."""
        return self.df.select(*(v.term().alias(n) for n, v in self.values.items()))


def _aligned(a: Solutions, b: Solutions) -> tuple[Solutions, Solutions, list[str]]:
    shared = [n for n in a.values if n in b.values]
    mixed = {n for n in shared if not a.values[n].like(b.values[n])}
    return (a.cast(mixed), b.cast(mixed), shared) if mixed else (a, b, shared)


def join(a: Solutions, b: Solutions, how: str = "inner", on=None) -> Solutions:
    """Compatible solutions together. how: inner, left, semi or anti; on: makes a condition from all values of both.

    Variables bound on both sides are equi-join keys. Where one may be unbound,
    its side is split into the bound and the unbound rows, so that both parts
    stay equi-joins."""
    a, b, shared = _aligned(a, b)
    unsure = [n for n in shared if n in a.maybe]
    if unsure:
        n = unsure[0]
        bound = Solutions(a.df.where(a.values[n].col.isNotNull()), a.values, a.maybe - {n})
        free = Solutions.of(a.df.where(a.values[n].col.isNull()), {k: v for k, v in a.values.items() if k != n}, a.maybe)
        return union([join(bound, b, how, on), join(free, b, how, on)])
    if how == "inner" and (unsure := [n for n in shared if n in b.maybe]):
        n = unsure[0]
        bound = Solutions(b.df.where(b.values[n].col.isNotNull()), b.values, b.maybe - {n})
        free = Solutions.of(b.df.where(b.values[n].col.isNull()), {k: v for k, v in b.values.items() if k != n}, b.maybe)
        return union([join(a, bound, how, on), join(a, free, how, on)])
    names = {n: f"r_{n}" if n in shared else column(n) for n in b.values}
    right = b.df.select(*(v.col.alias(names[n]) for n, v in b.values.items()), *([] if b.values else [F.lit(1).alias("unit_r")]))
    terms = []
    for n in shared:
        x, y = F.col(column(n)), F.col(names[n])
        terms.append((x == y) | y.isNull() if n in b.maybe else x == y)
    both = {**{n: v.at(names[n]) for n, v in b.values.items()}, **a.values}
    if on is not None and how == "left" and not terms:
        try:
            right, on = right.where(on(both)), None  # a condition on the right side alone
        except AnalysisException:
            pass
    if on is not None:
        terms.append(on(both))
    if how == "left" and not terms:  # each with each, which tasks share; where the right side is empty, the left one alone
        none = a.df.sparkSession.range(1).join(right.limit(1), F.lit(True), "left_anti").drop("id")
        alone = a.df.crossJoin(F.broadcast(none)).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema))
        return Solutions.of(spread(a.df, right, []).unionByName(alone), both, a.maybe | b.maybe | {n for n in b.values if n not in a.values})
    condition = reduce(lambda x, y: x & y, terms) if terms else F.lit(True)
    made = a.df.join(right, condition, {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}[how])
    if how in ("semi", "anti"):
        return Solutions(made, a.values, a.maybe)
    extra = {n for n in b.values if n not in a.values}
    return Solutions.of(made, both, a.maybe | (b.maybe & extra) | (extra if how == "left" else set()))


def met(a: Solutions, b: Solutions) -> Solutions:
    """Like an inner join, for results much larger than both sides: see shared.spread()."""
    a, b, shared = _aligned(a, b)
    if not shared or any(n in a.maybe or n in b.maybe for n in shared):
        return join(a, b)
    names = {n: f"r_{n}" if n in shared else column(n) for n in b.values}
    right = b.df.select(*(v.col.alias(names[n]) for n, v in b.values.items()))
    made = spread(a.df, right, [(column(n), names[n]) for n in shared])
    return Solutions.of(made, {**{n: v.at(names[n]) for n, v in b.values.items()}, **a.values}, a.maybe | (b.maybe - set(a.values)))


def minus(a: Solutions, b: Solutions) -> Solutions:
    """Solutions of a that are compatible with none of b with which they share a bound variable."""
    a, b, shared = _aligned(a, b)
    if not shared:
        return a
    # what may be unbound is split into the bound and the unbound rows: each part is an equi-join on what both have bound
    for side, other in ((a, b), (b, a)):
        for n in (n for n in shared if n in side.maybe):
            bound = Solutions(side.df.where(side.values[n].col.isNotNull()), side.values, side.maybe - {n})
            free = Solutions.of(side.df.where(side.values[n].col.isNull()), {k: v for k, v in side.values.items() if k != n}, side.maybe - {n})
            if side is a:
                return _whole(union([minus(bound, b), minus(free, b)]), a)
            return minus(minus(a, bound), free)
    return join(a, b.project(shared), "anti")


def _whole(found: Solutions, like: Solutions) -> Solutions:
    """With all variables of like, in its order."""
    missing = {n: v for n, v in like.values.items() if n not in found.values}
    df = found.df
    for n in missing:
        df = df.withColumn(column(n), F.lit(None).cast(like.df.schema[column(n)].dataType))
    return Solutions(df, {n: found.values.get(n, v) for n, v in like.values.items()}, like.maybe)


def union(branches: list[Solutions]) -> Solutions:
    """All solutions of all branches; columns of different forms become terms."""
    names = list(dict.fromkeys(n for b in branches for n in b.values))
    mixed = {n for n in names if len({i for i, b in enumerate(branches) if n in b.values and not b.values[n].like(next(x.values[n] for x in branches if n in x.values))})}
    aligned = [b.cast(mixed & set(b.values)) for b in branches]
    forms = {n: next(b.values[n] for b in aligned if n in b.values) for n in names}
    types = {n: next(b.df.schema[column(n)].dataType for b in aligned if n in b.values) for n in names}
    frames = [b.df.select(*(F.col(column(n)) if n in b.values else F.lit(None).cast(types[n]).alias(column(n)) for n in names), *([] if names else [F.lit(1).alias("unit")])) for b in aligned]
    maybe = {n for n in names if any(n not in b.values or n in b.maybe for b in branches)}
    return Solutions(reduce(DataFrame.unionByName, frames), {n: v.at(column(n)) for n, v in forms.items()}, frozenset(maybe))

