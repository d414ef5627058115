"""Measures of ontologies and vocabularies over triples (s, p, o)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import settled
from ..terms import BNODE, IRI, LITERAL
from ..vocab import OWL, RDF, RDFS, SKOS
from .paths import closed

_SYSTEM = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#")
_PROPERTIES = (OWL.ObjectProperty, OWL.DatatypeProperty, OWL.AnnotationProperty, RDF.Property)


def graph_counts(t: DataFrame) -> DataFrame:
    """One row: triples, distinct subjects, predicates and objects, blank subjects, literal and IRI objects, classes used."""
    return t.agg(
        F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"), F.count_distinct("o.lex").alias("objects"),
        F.count_distinct(F.when(F.col("s.kind") == BNODE, F.col("s.lex"))).alias("blank_subjects"), F.count_if(F.col("o.kind") == LITERAL).alias("literal_objects"),
        F.count_if(F.col("o.kind") == IRI).alias("iri_objects"), F.count_distinct(F.when(F.col("p") == RDF.type, F.col("o.lex"))).alias("classes_used"),
    )


def entity_counts(t: DataFrame) -> DataFrame:
    """(type, n): resources of each type, without those of the system namespaces."""
    rows = t.where((F.col("p") == RDF.type) & (F.col("o.kind") == IRI))
    for ns in _SYSTEM:
        rows = rows.where(~F.startswith(F.col("s.lex"), F.lit(ns)))
    return rows.groupBy(F.col("o.lex").alias("type")).agg(F.count_distinct("s").alias("n"))


class Hierarchy:
    """Classes, direct edges (child, parent), cycle participants, depths and path counts of a graph."""

    def __init__(self, t: DataFrame, edge: str = RDFS.subClassOf) -> None:
        self.t = t
        self.edges = settled(t.where((F.col("p") == edge) & (F.col("s.kind") == IRI) & (F.col("o.kind") == IRI)).select(F.col("s.lex").alias("child"), F.col("o.lex").alias("parent")).distinct(), "edges")
        typed = t.where((F.col("p") == RDF.type) & F.col("o.lex").isin(OWL.Class, RDFS.Class) & (F.col("s.kind") == IRI)).select(F.col("s.lex").alias("c"))
        self.classes = settled(typed.union(self.edges.select("child")).union(self.edges.select("parent")).distinct(), "classes")
        self.above = closed(self.edges.select(F.col("child").alias("x"), F.col("parent").alias("y")))
        self.cycles = self.above.where("x = y").select(F.col("x").alias("c"))
        self.levels = settled(self._levels(), "levels")

    def _levels(self) -> DataFrame:
        """(c, depth, paths): the longest way to a root and the number of ways; nodes of cycles have depth 0. A round a level."""
        free = self.edges.join(self.cycles, F.col("child") == F.col("c"), "left_anti").join(self.cycles, F.col("parent") == F.col("c"), "left_anti")
        free = settled(free, "acyclic")
        now = self.classes.join(free.select(F.col("child").alias("c")), "c", "left_anti").select("c", F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("paths"))
        levels: list[DataFrame] = []
        while True:
            now = settled(now, "level")
            if now.isEmpty():
                break
            k = len(levels)
            levels.append(now)
            now = now.join(free, F.col("c") == F.col("parent")).groupBy("child").agg(F.sum("paths").alias("paths")).select(F.col("child").alias("c"), F.lit(k + 1).alias("depth"), "paths")
        every = reduce(DataFrame.union, levels) if levels else self.classes.select("c", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("paths")).limit(0)
        return every.groupBy("c").agg(F.max("depth").alias("depth"), F.sum("paths").alias("paths"))

    @property
    def leaves(self) -> DataFrame:
        return self.classes.join(self.edges.select(F.col("parent").alias("c")), "c", "left_anti")

    def fan_out(self) -> DataFrame:
        """(c, children)"""
        n = self.edges.groupBy(F.col("parent").alias("c")).agg(F.count("child").alias("children"))
        return self.classes.join(n, "c", "left").select("c", F.coalesce("children", F.lit(0)).alias("children"))

    def fan_out_summary(self) -> DataFrame:
        n = F.col("children")
        bucket = lambda a, b: F.count_if((n >= a) & (n <= b))
        some = self.fan_out().where("children > 0")
        return some.agg(F.max(n).alias("max"), F.avg(n).alias("mean"), F.expr("percentile(children, 0.5)").alias("median"), bucket(1, 1).alias("n_1"), bucket(2, 5).alias("n_2_5"), bucket(6, 20).alias("n_6_20"), bucket(21, 50).alias("n_21_50"), bucket(51, 1 << 30).alias("n_over_50"))

    def hot_spots(self, top: int = 10) -> DataFrame:
        return self.fan_out().where("children > 0").orderBy(F.desc("children"), "c").limit(top)

    def deepest_chain(self) -> list[str]:
        """From a class of the greatest depth up to a root, the least IRI first where several are as good."""
        first = self.levels.orderBy(F.desc("depth"), "c").first()
        chain = []
        while first is not None:
            chain.append(first["c"])
            if not first["depth"]:
                break
            up = self.edges.where(F.col("child") == first["c"]).select(F.col("parent").alias("c"))
            first = self.levels.join(up, "c").where(F.col("depth") == first["depth"] - 1).orderBy("c").first()
        return chain


def oquare(t: DataFrame) -> DataFrame:
    """One row of the OQuaRE metrics; null where there is nothing to divide by."""
    h = Hierarchy(t)
    n_classes = h.classes.count()
    n_edges, n_leaves = h.edges.count(), h.leaves.count()
    props = t.where((F.col("p") == RDF.type) & F.col("o.lex").isin(*_PROPERTIES)).select(F.col("s.lex").alias("q"), F.col("o.lex").alias("kind")).distinct()
    n_props = props.select("q").distinct().count()
    domains = t.where(F.col("p") == RDFS.domain).select(F.col("s.lex").alias("q"), F.col("o.lex").alias("c")).distinct().join(h.classes, "c", "left_semi")
    by_kind = domains.join(props, "q").groupBy("kind").count().collect()
    kinds = {r["kind"]: r["count"] for r in by_kind}
    n_domains = domains.count()
    n_attributes, n_object = kinds.get(OWL.DatatypeProperty, 0), kinds.get(OWL.ObjectProperty, 0)
    other = t.where((F.col("o.kind") == IRI) & (F.col("p") != RDFS.subClassOf) & (F.col("p") != RDF.type)).count()
    used = t.where(F.col("p") == RDF.type).select(F.col("o.lex").alias("c")).distinct().join(h.classes, "c", "left_semi").count()
    notes = t.where(F.col("p").isin(RDFS.label, RDFS.comment, RDFS.seeAlso, RDFS.isDefinedBy) | F.startswith(F.col("p"), F.lit(str(SKOS)))).select(F.col("s.lex").alias("c")).join(h.classes, "c", "left_semi").count()
    at_leaves = h.leaves.join(h.levels, "c", "left").join(h.edges.groupBy(F.col("child").alias("c")).agg(F.count("parent").alias("up")), "c", "left").agg(F.sum("depth"), F.sum("paths"), F.avg(F.coalesce("up", F.lit(0)))).first()
    depth = h.levels.agg(F.max("depth")).first()[0]
    over = lambda a, b: float(a) / b if a is not None and b else None
    values = {
        "dit": None if depth is None else float(depth), "nac": None if at_leaves[2] is None else float(at_leaves[2]), "noc": over(n_edges, n_classes - 1) if n_classes > 1 else None, "cbo": over(n_edges, n_classes - 1) if n_classes > 1 else None,
        "wmc": over(n_domains + n_edges, n_classes), "rfc": over(n_domains, n_classes), "nom": over(n_attributes + n_object, n_classes), "lcom": over(at_leaves[0], at_leaves[1]), "rr": over(other, other + n_edges), "inr": over(n_edges, other + n_edges),
        "ar": over(n_attributes, n_classes), "cr": over(used, n_classes), "an": over(notes, n_classes), "pr": over(n_props, n_props + n_edges), "tm": over(at_leaves[1], n_leaves), "cycle_participants": float(h.cycles.count()),
    }
    return t.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{n} double" for n in values))


def scored(value: Column, bounds: tuple[float, float, float, float], high_is_good: bool) -> Column:
    """1 to 5 by four ascending bounds."""
    steps = sum((F.when(value > b, 1).otherwise(0) for b in bounds), F.lit(1))
    return F.when(value.isNotNull(), steps if high_is_good else 6 - steps)


_LOW, _WIDE = (2.0, 4.0, 6.0, 8.0), (3.0, 6.0, 8.0, 12.0)
#: The bounds of each metric, and whether more is better.
BOUNDS = {
    **{m: (_LOW, False) for m in ("dit", "nac", "cbo", "lcom", "nom", "tm")}, **{m: (_WIDE, False) for m in ("noc", "rfc")}, "wmc": ((5.0, 8.0, 11.0, 15.0), False),
    **{m: ((0.2, 0.4, 0.6, 0.8), True) for m in ("rr", "inr", "ar", "cr", "an", "pr")},
}


def scores(row: DataFrame) -> DataFrame:
    """(metric, value, score) of the metrics of oquare(); null where there is no value."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), scored(F.col(m), bounds, good).alias("score")) for m, (bounds, good) in BOUNDS.items() if m in row.columns]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def imports(t: DataFrame) -> DataFrame:
    """(ontology, imports, versioned): versioned are those whose IRI has a version number."""
    rows = t.where(F.col("p") == OWL.imports)
    return rows.groupBy(F.col("s.lex").alias("ontology")).agg(F.count("o").alias("imports"), F.count_if(F.col("o.lex").rlike(r"\d+\.\d+")).alias("versioned"))


def skos_coverage(t: DataFrame) -> DataFrame:
    """One row: concepts, schemes, concepts with a preferred label, a definition, without any link; edges of each kind."""
    of = lambda c: t.where((F.col("p") == RDF.type) & (F.col("o.lex") == c)).select("s").distinct()
    concepts = of(SKOS.Concept)
    has = t.join(concepts, "s", "left_semi").groupBy("s").agg(
        F.count_if(F.col("p") == SKOS.prefLabel).alias("labels"), F.count_if(F.col("p") == SKOS.definition).alias("definitions"), F.count_if(F.col("p").isin(SKOS.broader, SKOS.narrower, SKOS.related, SKOS.topConceptOf)).alias("links")
    )
    linked = t.where(F.col("p").isin(SKOS.broader, SKOS.narrower, SKOS.related, SKOS.hasTopConcept)).select(F.col("o").alias("s")).distinct().withColumn("in", F.lit(True))
    edges = t.agg(*(F.count_if(F.col("p") == SKOS[n]).alias(n) for n in ("broader", "narrower", "related")))
    got = has.join(linked, "s", "left").agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("labels") > 0).alias("with_label"), F.count_if(F.col("definitions") > 0).alias("with_definition"), F.count_if((F.col("links") == 0) & F.col("in").isNull()).alias("orphans"))
    return got.crossJoin(edges).crossJoin(of(SKOS.ConceptScheme).agg(F.count(F.lit(1)).alias("schemes")))


def skos_languages(t: DataFrame) -> DataFrame:
    """(lang, labels)"""
    return t.where(F.col("p").isin(SKOS.prefLabel, SKOS.altLabel)).groupBy(F.col("o.lang").alias("lang")).agg(F.count(F.lit(1)).alias("labels"))


def skos_cohorts(t: DataFrame) -> DataFrame:
    """(parent, size, pairs, related): siblings of parents with two children at least; related counts pairs of siblings that are related."""
    down = t.where(F.col("p") == SKOS.broader).select(F.col("o").alias("parent"), F.col("s").alias("child")).union(t.where(F.col("p") == SKOS.narrower).select("s", "o")).distinct()
    sizes = down.groupBy("parent").agg(F.count("child").alias("size")).where("size > 1")
    r = t.where(F.col("p") == SKOS.related).select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).where("a <> b").distinct()
    both = r.join(down.select(F.col("child").alias("a"), F.col("parent").alias("pa")), "a").join(down.select(F.col("child").alias("b"), F.col("parent").alias("pb")), "b").where("pa = pb")
    n = both.groupBy(F.col("pa").alias("parent")).agg(F.count(F.lit(1)).alias("related"))
    return sizes.join(n, "parent", "left").select(F.col("parent.lex").alias("parent"), "size", (F.col("size") * (F.col("size") - 1) / 2).cast("bigint").alias("pairs"), F.coalesce("related", F.lit(0)).alias("related"))


def importance(t: DataFrame) -> DataFrame:
    """(c, importance): 0.4 descendants + 0.3 incoming links, both as logs and by the greatest, + 0.2 nearness to the root by the greatest + 0.1 if labelled."""
    h = Hierarchy(t)
    below = h.above.where("x <> y").groupBy(F.col("y").alias("c")).agg(F.count("x").alias("below"))
    incoming = t.where(F.col("o.kind") == IRI).groupBy(F.col("o.lex").alias("c")).agg(F.count(F.lit(1)).alias("incoming"))
    labelled = t.where(F.col("p").isin(RDFS.label, SKOS.prefLabel)).select(F.col("s.lex").alias("c")).distinct().withColumn("labelled", F.lit(1.0))
    rows = h.classes.join(below, "c", "left").join(incoming, "c", "left").join(h.levels, "c", "left").join(labelled, "c", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.select("c", F.log1p(zero("below")).alias("d"), F.log1p(zero("incoming")).alias("i"), (1 / (1 + zero("depth"))).alias("n"), F.coalesce("labelled", F.lit(0.0)).alias("l"))
    most = rows.agg(F.max("d").alias("md"), F.max("i").alias("mi"), F.max("n").alias("mn"))
    part = lambda c, m: F.coalesce(F.try_divide(F.col(c), F.col(m)), F.lit(0.0))
    return rows.crossJoin(F.broadcast(most)).select("c", (0.4 * part("d", "md") + 0.3 * part("i", "mi") + 0.2 * part("n", "mn") + 0.1 * F.col("l")).alias("importance"))


def prioritised(violations: DataFrame, weights: DataFrame, top: int | None = None) -> DataFrame:
    """Violations by importance of their focus (0.5 where unknown), then severity, then the focus."""
    rank = F.when(F.col("severity").isin("Violation", "Error"), 0).when(F.col("severity") == "Warning", 1).otherwise(2)
    rows = violations.join(weights.withColumnRenamed("importance", "w"), (F.col("focus.lex") == F.col("c")) & (F.col("focus.kind") == IRI), "left")
    rows = rows.withColumn("importance", F.coalesce("w", F.lit(0.5))).drop("w", "c").orderBy(F.desc("importance"), rank, "focus.lex")
    return rows.limit(top) if top else rows

