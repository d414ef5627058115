"""Property paths as pairs of ends.

Sequences and alternatives are bags, closures are sets. A closure without a
fixed start squares the relation until nothing is new, so a chain of n links
takes log2(n) joins; one with a constant start follows a frontier from there.
Every round is written to the shared folder: plans stay short, and no lost
executor sends the loop back to its start.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Value, matches
from ..plans import ast as A
from ..plans.solutions import Solutions, join, met, union
from ..shared import forget, settled
from ..terms import IRI, Term, lit

X, Y, Z = "_x", "_y", "_z"


def _renamed(s: Solutions, to: dict[str, str]) -> Solutions:
    return Solutions.of(s.df, {to[n]: v for n, v in s.values.items()}, {to[n] for n in s.maybe})


def pairs(source: Any, path: A.Path, graph: Any = None, start: Term | None = None) -> Solutions:
    """Solutions of _x and _y. start: a constant _x."""
    if isinstance(path, A.Link):
        return source.stars([A.Triple(A.Var(X), Term(IRI, path.iri), A.Var(Y))], graph)[0].project([X, Y])
    if isinstance(path, A.Inverse):
        return _renamed(pairs(source, path.path, graph), {X: Y, Y: X}).project([X, Y])
    if isinstance(path, A.Sequence):
        return sequence(source, path, pairs(source, path.steps[0], graph), graph)
    if isinstance(path, A.Alternative):
        return union([pairs(source, p, graph) for p in path.options])
    if isinstance(path, A.Negated):
        made = []
        everything = source.stars([A.Triple(start if start is not None and not path.backward else A.Var(X), A.Var(Z), A.Var(Y))], graph)[0]
        if X not in everything.values:
            everything = Solutions.of(everything.df, {**everything.values, X: Value("term", lit(start))})
        if path.forward or not path.backward:
            made.append(everything.where(~everything.values[Z].text().isin(*path.forward)).project([X, Y]))
        if path.backward:
            made.append(_renamed(everything.where(~everything.values[Z].text().isin(*path.backward)).project([X, Y]), {X: Y, Y: X}).project([X, Y]))
        return union(made)
    if isinstance(path, A.Repeat):
        return repeat(source, path, graph, start)
    raise TypeError(path)


def sequence(source: Any, path: A.Sequence, made: Solutions, graph: Any = None) -> Solutions:
    """The steps after the first, from solutions of it. A step that goes back on one that went there may give many nodes for each of many: all nodes of a nation for each of them."""
    for before, step in zip(path.steps, path.steps[1:]):
        many = isinstance(step, A.Inverse) and not isinstance(before, A.Inverse)
        made = (met if many else join)(_renamed(made, {X: X, Y: Z}), _renamed(pairs(source, step, graph), {X: Z, Y: Y})).project([X, Y])
    return made


def identity(source: Any, graph: Any, start: Term | None) -> Solutions:
    """Each node with itself; a constant start too, though the graph lacks it."""
    if start is not None:
        df = source.spark.range(1).select(lit(start).alias("t"))
        return Solutions.of(df, {X: Value("term", F.col("t")), Y: Value("term", F.col("t"))})
    t = source.triples(graph)
    nodes = t.select(F.col("s").alias("t")).union(t.select(F.col("o").alias("t"))).distinct()
    return Solutions.of(nodes, {X: Value("term", F.col("t")), Y: Value("term", F.col("t"))})


def repeat(source: Any, path: A.Repeat, graph: Any, start: Term | None) -> Solutions:
    if path.low == 0:
        none = identity(source, graph, start)
        if path.high == 0:
            return none
        more = A.Repeat(path.path, 1, path.high)
        return union([none, pairs(source, more, graph, start)]).distinct()
    if path.high is None:
        once = pairs(source, path.path, graph)
        closed = closure(once, start)
        return closed if path.low == 1 else chain(pairs(source, A.Sequence((path.path,) * (path.low - 1)) if path.low > 2 else path.path, graph), closed).distinct()
    step = pairs(source, path.path, graph)
    made, out = step, []
    for n in range(1, path.high + 1):
        if n > 1:
            made = chain(made, step)
        if n >= path.low:
            out.append(made)
    return (union(out) if len(out) > 1 else out[0]).distinct()


def chain(a: Solutions, b: Solutions) -> Solutions:
    return join(_renamed(a, {X: X, Y: Z}), _renamed(b, {X: Z, Y: Y})).project([X, Y])


def closure(once: Solutions, start: Term | None = None) -> Solutions:
    """One or more steps, as a set."""
    if not once.values[X].like(once.values[Y]):
        once = once.cast({X, Y})
    x, y = once.values[X], once.values[Y]
    edges = settled(once.df.select(x.col.alias("x"), y.col.alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct(), "edges")
    reached = closed_from(edges, edges.where(matches(x.at("x"), start))) if start is not None else closed(edges)
    return Solutions.of(reached, {X: x.at("x"), Y: y.at("y")})


def closed(edges: DataFrame) -> DataFrame:
    """(x, y) of the transitive closure, by squaring."""
    reach, n = edges, edges.count()
    while True:
        more = reach.join(reach.select(F.col("x").alias("m"), F.col("y").alias("z")), F.col("y") == F.col("m")).select("x", F.col("z").alias("y"))
        before, reach = reach, settled(reach.union(more).distinct(), "closure")
        if before is not edges:
            forget(before)
        grown = reach.count()
        if grown == n:
            return reach
        n = grown


def closed_from(edges: DataFrame, first: DataFrame) -> DataFrame:
    """(x, y) reached from the ends of first, by its frontier."""
    new = reach = settled(first, "frontier")
    while not new.isEmpty():
        step = new.join(edges.select(F.col("x").alias("m"), F.col("y").alias("z")), F.col("y") == F.col("m")).select("x", F.col("z").alias("y")).distinct()
        new = settled(step.join(reach, ["x", "y"], "left_anti").select("x", "y"), "frontier")
        reach = reach.union(new)
    return reach


def path_solutions(source: Any, s: A.Node, path: A.Path, o: A.Node, graph: Any = None) -> Solutions:
    """The pattern s path o."""
    start = s if isinstance(s, Term) else None
    if start is None and isinstance(o, Term):  # from the constant end, backwards
        return path_solutions(source, o, A.Inverse(path) if not isinstance(path, A.Repeat) else A.Repeat(A.Inverse(path.path), path.low, path.high), s, graph)
    made = pairs(source, path, graph, start)
    values, conditions = {}, []
    for n, v in ((s, made.values[X]), (o, made.values[Y])):
        if isinstance(n, A.Var):
            if n.name in values:
                conditions.append(values[n.name].term() == v.term())
            else:
                values[n.name] = v
        else:
            conditions.append(matches(v, n))
    df = made.df
    for c in conditions:
        df = df.where(c)
    return Solutions.of(df, values)

