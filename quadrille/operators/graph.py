"""Algorithms over triples (s, p, o): descriptions, differences, isomorphism, RDFS, lists, resources, similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..shared import forget, once, settled
from ..terms import BNODE, IRI, LITERAL, QUOTED, TERM, TRIPLE, Term, equivalent, make, nt, nt_text
from ..vocab import OWL, RDF, RDFS


def describe(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """The concise bounded description of nodes (node): their triples and, through blank-node objects, those of what they name. Circles end."""
    t = triples.select("s", "p", "o")
    seen = nodes.select(F.col("node").alias("n")).distinct()
    frontier, parts = seen, []
    while True:
        found = settled(t.join(frontier, F.col("s") == F.col("n"), "left_semi"), "described")
        parts.append(found)
        seen = settled(seen, "seen")
        nxt = found.where(f"o.kind = {BNODE}").select(F.col("o").alias("n")).distinct()
        frontier = settled(nxt.join(seen, "n", "left_anti"), "frontier")
        if frontier.isEmpty():
            return reduce(DataFrame.union, parts).distinct()
        seen = seen.union(frontier)


def union_graphs(*graphs: DataFrame) -> DataFrame:
    return once(reduce(DataFrame.unionByName, graphs))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, s, p, o): what only one of two graphs has, in the order of its text."""
    own = lambda a, b, side: a.select("s", "p", "o").subtract(b.select("s", "p", "o")).select(F.lit(side).alias("side"), "s", "p", "o")
    return own(left, right, "left").union(own(right, left, "right")).orderBy("side", nt(F.col("s")), "p", nt(F.col("o")))


def snapshot(triples: DataFrame) -> DataFrame:
    """(line): the graph in N-Triples, sorted."""
    return triples.distinct().select(line(F.col("s"), F.col("p"), F.col("o")).alias("line")).orderBy("line")


def line(s: Column, p: Column, o: Column, g: Column | None = None) -> Column:
    return F.concat(nt(s), F.lit(" <"), p, F.lit("> "), nt(o), *([F.when(g.isNotNull(), F.concat(F.lit(" <"), g, F.lit(">"))).otherwise("")] if g is not None else []), F.lit(" ."))


def colours(triples: DataFrame) -> DataFrame:
    """(node, colour) of each blank node: refined by its edges, both ways, until no more classes appear, which takes at most as many rounds as there are blank nodes."""
    t = settled(triples.select("s", "p", "o").distinct(), "graph")
    nodes = settled(t.select(F.col("s").alias("n")).union(t.select("o")).where(f"n.kind = {BNODE}").select(F.col("n.lex").alias("node")).distinct(), "nodes")
    now, classes = nodes.withColumn("colour", F.lit("0")), 1
    edges = t.select(F.col("s.lex").alias("node"), (F.col("s.kind") == BNODE).alias("b"), F.lit("+").alias("d"), "p", F.col("o").alias("x")).union(t.select(F.col("o.lex"), F.col("o.kind") == BNODE, F.lit("-"), "p", "s")).where("b").drop("b")
    while True:
        ends = edges.join(now.select(F.col("node").alias("m"), F.col("colour").alias("c")), (F.col("x.kind") == BNODE) & (F.col("x.lex") == F.col("m")), "left")
        seen = ends.groupBy("node").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(" ", "d", "p", F.coalesce("c", nt(F.col("x"))))))), 256).alias("e"))
        now = settled(now.join(seen, "node", "left").select("node", F.sha2(F.concat_ws("|", "colour", "e"), 256).alias("colour")), "colours")
        found = now.select("colour").distinct().count()
        if found <= classes:
            return now
        classes = found


def _coloured(triples: DataFrame, c: DataFrame) -> DataFrame:
    name = lambda col, j: F.coalesce(F.when(col["kind"] == BNODE, F.concat(F.lit("_:"), F.col(j))), nt(col))
    rows = triples.select("s", "p", "o").distinct().join(c.select(F.col("node").alias("n1"), F.col("colour").alias("c1")), (F.col("s.kind") == BNODE) & (F.col("s.lex") == F.col("n1")), "left")
    rows = rows.join(c.select(F.col("node").alias("n2"), F.col("colour").alias("c2")), (F.col("o.kind") == BNODE) & (F.col("o.lex") == F.col("n2")), "left")
    return rows.select(F.concat_ws(" ", name(F.col("s"), "c1"), "p", name(F.col("o"), "c2")).alias("row")).groupBy("row").count()


def _refined(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The colours of two graphs; None if they tell the graphs apart."""
    if left.distinct().count() != right.distinct().count():
        return None
    c, d = colours(left), colours(right)
    a, b = _coloured(left, c), _coloured(right, d)
    return (c, d) if a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() else None


def isomorphic(left: DataFrame, right: DataFrame) -> bool:
    """Whether two graphs differ only in the labels of their blank nodes. Colour refinement decides, distributed, if every blank node has a colour of its own; else the blank nodes are matched on the driver, which they have to fit."""
    found = _refined(left, right)
    if found is None:
        return False
    if found[0].groupBy("colour").count().where("count > 1").isEmpty():
        return True
    return _matched(left, right, *found) is not None


def blank_node_mapping(left: DataFrame, right: DataFrame) -> dict[str, str] | None:
    """Labels of the left graph to those of the right, None if there is no such mapping. For graphs whose blank nodes fit on the driver."""
    found = _refined(left, right)
    return None if found is None else _matched(left, right, *found)


class _Blanks:
    """The blank nodes of a graph on the driver: colours, edges between them, and the parts that hang together."""

    def __init__(self, triples: DataFrame, colours_: DataFrame) -> None:
        self.colour = {r["node"]: r["colour"] for r in colours_.collect()}
        self.edges: dict[str, set[tuple[str, str, str]]] = {n: set() for n in self.colour}
        for r in triples.where(f"s.kind = {BNODE} AND o.kind = {BNODE}").select("s.lex", "p", F.col("o.lex").alias("o")).distinct().collect():
            self.edges[r["lex"]].add(("+", r["p"], r["o"]))
            self.edges[r["o"]].add(("-", r["p"], r["lex"]))
        self.parts: list[list[str]] = []
        seen: set[str] = set()
        for n in sorted(self.colour, key=lambda n: (self.colour[n], n)):
            if n not in seen:
                seen.add(n)
                part = [n]
                for x in part:  # grows as it goes: each node comes after one that it touches
                    for _, _, y in sorted(self.edges[x]):
                        if y not in seen:
                            seen.add(y)
                            part.append(y)
                self.parts.append(part)


def _matched(left: DataFrame, right: DataFrame, c: DataFrame, d: DataFrame) -> dict[str, str] | None:
    """Part by part: parts that can be mapped onto one another are alike for every other part too, so a part is matched once and never given back."""
    a, b = _Blanks(left, c), _Blanks(right, d)
    by: dict[tuple, list[list[str]]] = {}
    for part in b.parts:
        by.setdefault(tuple(sorted(b.colour[n] for n in part)), []).append(part)
    out: dict[str, str] = {}
    for part in a.parts:
        same = by.get(tuple(sorted(a.colour[n] for n in part)), [])
        for i, other in enumerate(same):
            if (found := _mapping(a, part, b, other)) is not None:
                out |= found
                del same[i]
                break
        else:
            return None
    return out


def _mapping(a: _Blanks, part: list[str], b: _Blanks, other: list[str]) -> dict[str, str] | None:
    """By backtracking along the edges: a node's image is next to that of a neighbour, of its colour, with the same edges to what is mapped."""
    to: dict[str, str] = {}
    used: set[str] = set()

    def choices(n: str) -> Iterator[str]:
        near = next(((d, p, x) for d, p, x in sorted(a.edges[n]) if x in to), None)
        if near is None:
            some = other
        else:
            back = "-" if near[0] == "+" else "+"
            some = sorted({y for d, p, y in b.edges[to[near[2]]] if (d, p) == (back, near[1])})
        mapped = {(d, p, x) for d, p, x in a.edges[n] if x in to or x == n}
        for y in some:
            if y in used or b.colour[y] != a.colour[n]:
                continue
            if {(d, p, y if x == n else to[x]) for d, p, x in mapped} == {(d, p, x) for d, p, x in b.edges[y] if x in used or x == y}:
                yield y

    tried = [choices(part[0])]
    while tried:
        n = part[len(tried) - 1]
        if n in to:
            used.discard(to.pop(n))
        y = next(tried[-1], None)
        if y is None:
            tried.pop()
            continue
        to[n] = y
        used.add(y)
        if len(to) == len(part):
            return to
        tried.append(choices(part[len(tried)]))
    return None


# RDFS
def _links(t: DataFrame, p: str) -> DataFrame:
    return t.where(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b")).where(f"b.kind <> {LITERAL}")


#: Rules of more rows than this aren't broadcast.
MOST_RULES = 100_000


def _few(rules: DataFrame) -> DataFrame:
    """What the schema says of predicates, to be joined with data: as a broadcast, since one predicate may be that of all the data, which a join by predicates would put into one task."""
    made = settled(rules.distinct(), "rules")
    return F.broadcast(made) if made.limit(MOST_RULES + 1).count() <= MOST_RULES else made


def _new(now: DataFrame, made: list[DataFrame], name: str) -> DataFrame:
    """The statements made that aren't known, each once, as a table. Only what is known of their predicates is read."""
    found = settled(once(reduce(DataFrame.union, made).select("s", "p", "o").where(f"s.kind <> {LITERAL}")), name)
    said = [r[0] for r in found.select("p").distinct().limit(1001).collect()]
    known = now.where(F.col("p").isin(said)) if len(said) <= 1000 else now
    new = settled(found.join(known, ["s", "p", "o"], "left_anti"), name)
    forget(found)
    return new


def _transitive(t: DataFrame, p: str) -> DataFrame:
    l = _links(t, p)  # noqa: E741
    return l.join(l.select(F.col("a").alias("m"), F.col("b").alias("c")), F.col("b") == F.col("m")).select(F.col("a").alias("s"), F.lit(p).alias("p"), F.col("c").alias("o"))


def _typed(t: DataFrame, rule: str, at: str, only_iris: bool) -> DataFrame:
    rules = _few(_links(t, rule).select(F.col("a.lex").alias("q"), F.col("b").alias("class")))
    rows = t.join(rules, F.col("p") == F.col("q"))
    if at == "o":
        rows = rows.where(f"o.kind = {IRI}" if only_iris else f"o.kind <> {LITERAL}")
    return rows.select(F.col(at).alias("s"), F.lit(RDF.type).alias("p"), F.col("class").alias("o"))


def infer(triples: DataFrame, mode: str = "single_pass", owl: bool = False) -> DataFrame:
    """The triples that the schema adds, without those given.

    single_pass applies transitivity, domain and range once to what is given;
    fixpoint also hands types and properties up and goes on until nothing is new.
    owl adds inverse, symmetric and transitive properties, equivalence and sameAs."""
    if mode not in ("single_pass", "fixpoint"):
        raise GraphError(f"unknown mode {mode}")
    rules = lambda t, once: [_transitive(t, RDFS.subClassOf), _transitive(t, RDFS.subPropertyOf), _typed(t, RDFS.domain, "s", True), _typed(t, RDFS.range, "o", once)]
    if mode == "single_pass":  # the schema is read first; of the data only the triples whose predicate it names, and only new types are made distinct
        schema = settled(triples.select("s", "p", "o").where(F.col("p").isin(RDFS.subClassOf, RDFS.subPropertyOf, RDFS.domain, RDFS.range)).distinct(), "schema")
        named = settled(schema.where(F.col("p").isin(RDFS.domain, RDFS.range)).select(F.col("s.lex").alias("q")).distinct(), "named")
        data = triples.select("s", "p", "o").join(named, F.col("p") == F.col("q"), "left_semi")
        typed = [rule(data.unionByName(schema.where(F.col("p") == r)), r, at, True) for rule, r, at in ((_typed, RDFS.domain, "s"), (_typed, RDFS.range, "o"))]
        made = reduce(DataFrame.union, [_transitive(schema, RDFS.subClassOf), _transitive(schema, RDFS.subPropertyOf), *typed])
        known = triples.select("s", "p", "o").where(F.col("p").isin(RDF.type, RDFS.subClassOf, RDFS.subPropertyOf))
        return made.distinct().join(known, ["s", "p", "o"], "left_anti")
    now, added = settled(once(triples.select("s", "p", "o")), "given"), []
    while True:
        made = rules(now, False)
        up = _links(now, RDFS.subClassOf).select(F.col("a").alias("o"), F.col("b").alias("c"))
        made.append(now.where(F.col("p") == RDF.type).join(up, "o").select("s", "p", F.col("c").alias("o")))
        wider = _few(_links(now, RDFS.subPropertyOf).select(F.col("a.lex").alias("p"), F.col("b.lex").alias("q")))
        made.append(now.join(wider, "p").select("s", F.col("q").alias("p"), "o"))
        if owl:
            made += _owl(now)
        new = _new(now, made, "inferred")
        added.append(new)
        if new.isEmpty():
            return reduce(DataFrame.union, added)
        now = now.union(new)


def _owl(t: DataFrame) -> list[DataFrame]:
    of_type = lambda c: t.where((F.col("p") == RDF.type) & (F.col("o.lex") == c)).select(F.col("s.lex").alias("q"))
    flip = lambda rows, p: rows.where(f"o.kind <> {LITERAL}").select(F.col("o").alias("s"), p.alias("p"), F.col("s").alias("o"))
    out = []
    inverse = _links(t, OWL.inverseOf).select(F.col("a.lex").alias("q"), F.col("b.lex").alias("r"))
    both = _few(inverse.union(inverse.select("r", "q")))
    out.append(flip(t.join(both, F.col("p") == F.col("q")), F.col("r")))
    symmetric = _few(of_type(OWL.SymmetricProperty).union(t.sparkSession.createDataFrame([(OWL.sameAs,)], "q string")))
    out.append(flip(t.join(symmetric, F.col("p") == F.col("q")), F.col("p")))
    closed = t.join(_few(of_type(OWL.TransitiveProperty).union(t.sparkSession.createDataFrame([(OWL.sameAs,)], "q string"))), F.col("p") == F.col("q")).select("s", "p", "o")
    out.append(closed.join(closed.select(F.col("s").alias("m"), F.col("p").alias("q"), F.col("o").alias("z")), (F.col("o") == F.col("m")) & (F.col("p") == F.col("q"))).select("s", "p", F.col("z").alias("o")))
    for eq, sub in ((OWL.equivalentClass, RDFS.subClassOf), (OWL.equivalentProperty, RDFS.subPropertyOf)):
        e = _links(t, eq)
        out.append(e.union(e.select("b", "a")).select(F.col("a").alias("s"), F.lit(sub).alias("p"), F.col("b").alias("o")))
    same = _few(_links(t, OWL.sameAs))
    out.append(t.join(same, F.col("s") == F.col("a")).select(F.col("b").alias("s"), "p", "o"))
    out.append(t.join(same, F.col("o") == F.col("a")).select("s", "p", F.col("b").alias("o")))
    return out


def classification(triples: DataFrame, p: str = RDFS.subClassOf) -> DataFrame:
    """(node, targets): direct superclasses, types (rdf:type) or superproperties, IRIs only."""
    rows = triples.where((F.col("p") == p) & (F.col("o.kind") == IRI))
    return rows.groupBy(F.col("s.lex").alias("node")).agg(F.array_sort(F.collect_set("o.lex")).alias("targets"))


def inconsistencies(triples: DataFrame) -> DataFrame:
    """(node, one, other): resources of two classes that are disjoint."""
    types = triples.where(F.col("p") == RDF.type).select(F.col("s").alias("node"), F.col("o").alias("c"))
    d = _links(triples, OWL.disjointWith)
    first = types.join(d, F.col("c") == F.col("a")).select("node", F.col("a").alias("one"), F.col("b").alias("other"))
    return first.join(types, ["node"]).where("c = other").select("node", "one", "other").distinct()


class Imported(NamedTuple):
    triples: DataFrame
    #: Ontologies loaded, and how many steps away each is.
    depths: dict[str, int]
    #: Those that could not be had.
    missing: list[str]


def imported(triples: DataFrame, ontology: str, load: Callable[[str], DataFrame | None], most: int = 50) -> Imported:
    """The graph with what it imports, to any depth up to most steps; load gives the triples of an ontology or None. An ontology is loaded once, so circles end."""
    depths, missing = {ontology: 0}, []
    whole, now = triples.select("s", "p", "o"), [triples]
    for depth in range(1, most + 1):
        names = sorted({r[0] for t in now for r in t.where(F.col("p") == OWL.imports).select("o.lex").distinct().collect()} - depths.keys() - set(missing))
        now = []
        for name in names:
            got = load(name)
            if got is None:
                missing.append(name)
                continue
            depths[name] = depth
            now.append(got)
            whole = whole.unionByName(got.select("s", "p", "o"))
        if not now:
            break
    return Imported(whole.distinct(), depths, missing)


# lists, resources
def lists(triples: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, items) of each head (head); items is null where a cell has not one first and one rest, or the list runs in a circle."""
    firsts = triples.where(F.col("p") == RDF.first).groupBy("s").agg(F.count("o").alias("n1"), F.min("o").alias("first"))
    rests = triples.where(F.col("p") == RDF.rest).groupBy("s").agg(F.count("o").alias("n2"), F.min("o").alias("rest"))
    cells = settled(firsts.join(rests, "s", "full").select(F.col("s").alias("cell"), "first", "rest", F.coalesce((F.col("n1") == 1) & (F.col("n2") == 1), F.lit(False)).alias("good")), "cells")
    nil = F.struct(F.lit(IRI).cast("tinyint").alias("kind"), F.lit(RDF.nil).alias("lex"), F.lit("").alias("dt"), F.lit("").alias("lang"), F.lit("").alias("dir"))
    now = heads.select("head", F.col("head").alias("at"), F.array().cast(f"array<{TERM}>").alias("items"), F.array().cast(f"array<{TERM}>").alias("seen"), F.lit(True).alias("good")).distinct()
    done: list[DataFrame] = []
    while True:
        now = settled(now, "lists")
        done.append(now.where((F.col("at") == nil) | ~F.col("good")).select("head", F.when(F.col("good"), F.col("items")).alias("items")))
        left = now.where((F.col("at") != nil) & F.col("good"))
        if left.isEmpty():
            return reduce(DataFrame.union, done)
        step = left.drop("good").join(cells, F.col("at") == F.col("cell"), "left")
        good = F.coalesce("good", F.lit(False)) & ~F.array_contains("seen", F.col("at"))
        now = step.select("head", F.coalesce("rest", nil).alias("at"), F.when(good, F.array_append("items", F.col("first"))).otherwise(F.col("items")).alias("items"), F.array_append("seen", F.col("at")).alias("seen"), good.alias("good"))


def instances(triples: DataFrame, cls: str) -> DataFrame:
    """(node) of a class or its subclasses."""
    from .paths import closed_from

    sub = _links(triples, RDFS.subClassOf).select(F.col("b").alias("x"), F.col("a").alias("y"))
    edges = settled(sub.distinct(), "edges")
    root = make(IRI, F.lit(cls))
    below = closed_from(edges, edges.where(F.col("x") == root)).select(F.col("y").alias("o"))
    classes = below.union(triples.sparkSession.range(1).select(root.alias("o"))).distinct()
    return triples.where(F.col("p") == RDF.type).join(classes, "o").select(F.col("s").alias("node")).distinct()


def reifiers(triples: DataFrame, s: Term | None = None, p: str | None = None, o: Term | None = None) -> DataFrame:
    """(reifier, triple): who states or denies which quoted triple; of the claims with this subject, predicate or object only, where given."""
    rows = triples.where(F.col("p") == RDF.reifies).select(F.col("s").alias("reifier"), F.col("o").alias("triple"))
    for n, text in ((1, s and nt_text(s)), (2, p), (3, o and nt_text(o))):
        if text is not None:
            rows = rows.where((F.col("triple.kind") == TRIPLE) & (F.regexp_extract("triple.lex", QUOTED, n) == text))
    return rows


def property_bag(triples: DataFrame) -> DataFrame:
    """(node, p, values, n_literals) of each resource and predicate."""
    return triples.groupBy(F.col("s").alias("node"), "p").agg(F.array_sort(F.collect_list(nt(F.col("o")))).alias("values"), F.count_if(F.col("o.kind") == LITERAL).alias("n_literals"))


def materialise(triples: DataFrame, shape: dict[str, tuple[str, str, bool]], nodes: DataFrame | None = None) -> DataFrame:
    """Resources as rows: column -> (predicate, Spark type, whether it is a list). Only the predicates named are read; texts that don't cast are null."""
    preds = {p for p, _, _ in shape.values()}
    rows = triples.where(F.col("p").isin(*preds))
    if nodes is not None:
        rows = rows.join(nodes.select(F.col("node").alias("s")), "s", "left_semi")
    made = []
    for name, (p, kind, many) in shape.items():
        v = F.when(F.col("p") == p, F.col("o.lex")).try_cast(kind)
        made.append((F.array_sort(F.collect_list(v)) if many else F.min(v)).alias(name))
    return rows.groupBy(F.col("s.lex").alias("node")).agg(*made)


def struct_type(shape: dict[str, tuple[str, str, bool]]) -> str:
    return "node string, " + ", ".join(f"`{n}` " + (f"array<{t}>" if many else t) for n, (_, t, many) in shape.items())


def replaced(triples: DataFrame, node: str, p: str, values: DataFrame, only: int | None = None) -> DataFrame:
    """The graph with what node says by p (of one kind, if given) replaced by values (o)."""
    old = (F.col("s.lex") == node) & (F.col("p") == p) & (F.col("o.kind") == only if only is not None else F.lit(True))
    new = values.select(make(IRI, F.lit(node)).alias("s"), F.lit(p).alias("p"), "o")
    return triples.where(~old).unionByName(new).distinct()


def same_values(a: Column, b: Column) -> Column:
    return equivalent(a, b)


# similarity
def cosine_pairs(vectors: DataFrame, least: float, key: str = "id", vec: str = "vec") -> DataFrame:
    """(a, b, similarity), a < b, of unit vectors whose dot product is at least that much. Blocks of BLOCK vectors meet pairwise as matrices, so no task holds more than two blocks."""
    import numpy as np
    import pandas as pd

    block = 2048
    n = vectors.count()
    k = max(1, -(-n // block))
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).cast("array<float>").alias("v"), F.pmod(F.xxhash64(key), F.lit(k)).alias("h")).where("v IS NOT NULL")
    lo = rows.select("id", "v", "h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias("j"))
    met = lo.select("id", "v", F.least("h", "j").alias("x"), F.greatest("h", "j").alias("y"), "h")

    def rounded(x):
        """To 6 places as SQL does it: the double times 10^6, half away from zero."""
        m = x * 1e6
        whole = np.trunc(m)
        return (whole + np.copysign(np.abs(m - whole) >= 0.5, m)) / 1e6

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = int(g["x"].iloc[0]), int(g["y"].iloc[0])
        left, right = g[g["h"] == x], g[g["h"] == y]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        a, b = np.stack(left["v"].to_numpy()).astype(np.float64), np.stack(right["v"].to_numpy()).astype(np.float64)
        i, j = np.nonzero(a @ b.T >= least - 1e-6)
        sim = np.zeros(len(i))
        for x_, y_ in zip(a.T, b.T):  # one dimension after the other, as SQL sums: another order differs in the last bit, which rounding may show
            sim += x_[i] * y_[j]
        sim = rounded(sim)
        p, q = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = (sim >= least) & ((p < q) if x == y else True)
        return pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "similarity": sim[keep]})

    return met.groupBy("x", "y").applyInPandas(run, f"a {kind}, b {kind}, similarity double")


def drift(a: Column, b: Column, places: int = 6) -> Column:
    """1 - cosine of two unit vectors, within 0 and 1, rounded half up to that many places, once: rounding the rounded may lift it by a unit."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot)), places)


def labels(triples: DataFrame, predicates: tuple[str, ...], excluded: tuple[str, ...] = ()) -> DataFrame:
    """(node, label): a resource's labels together, in order, without those of excluded namespaces."""
    rows = triples.where(F.col("p").isin(*predicates) & (F.col("s.kind") == IRI) & (F.col("o.kind") == LITERAL))
    for ns in excluded:
        rows = rows.where(~F.startswith(F.col("s.lex"), F.lit(ns)))
    return rows.groupBy(F.col("s.lex").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("o.lex")), " ; ").alias("label"))
