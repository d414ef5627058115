"""Inference by chosen rules: presets, single rules, and rules of one's own as CONSTRUCT queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..shared import once, settled
from ..terms import IRI, LITERAL
from ..vocab import OWL, RDF, RDFS
from .graph import _few, _links, _new, _transitive, _typed, lists


def _flipped(rows: DataFrame, p: str) -> DataFrame:
    return rows.where(f"o.kind <> {LITERAL}").select(F.col("o").alias("s"), F.col(p).alias("p"), F.col("s").alias("o"))


def _of_type(t: DataFrame, cls: str) -> DataFrame:
    return _few(t.where((F.col("p") == RDF.type) & (F.col("o.lex") == cls)).select(F.col("s.lex").alias("q")))


def _subclass(t: DataFrame) -> list[DataFrame]:
    up = _links(t, RDFS.subClassOf).select(F.col("a").alias("o"), F.col("b").alias("c"))
    return [_transitive(t, RDFS.subClassOf), t.where(F.col("p") == RDF.type).join(up, "o").select("s", "p", F.col("c").alias("o"))]


def _subproperty(t: DataFrame) -> list[DataFrame]:
    wider = _few(_links(t, RDFS.subPropertyOf).select(F.col("a.lex").alias("p"), F.col("b.lex").alias("q")))
    return [_transitive(t, RDFS.subPropertyOf), t.join(wider, "p").select("s", F.col("q").alias("p"), "o")]


def _equivalent(t: DataFrame) -> list[DataFrame]:
    out = []
    for eq, sub in ((OWL.equivalentClass, RDFS.subClassOf), (OWL.equivalentProperty, RDFS.subPropertyOf)):
        e = _links(t, eq)
        out.append(e.union(e.select("b", "a")).select(F.col("a").alias("s"), F.lit(sub).alias("p"), F.col("b").alias("o")))
    return out


def _symmetric(t: DataFrame) -> list[DataFrame]:
    return [_flipped(t.join(_of_type(t, OWL.SymmetricProperty), F.col("p") == F.col("q")), "p")]


def _transitive_properties(t: DataFrame) -> list[DataFrame]:
    rows = t.join(_of_type(t, OWL.TransitiveProperty), F.col("p") == F.col("q")).select("s", "p", "o")
    other = rows.select(F.col("s").alias("m"), F.col("p").alias("q"), F.col("o").alias("z"))
    return [rows.join(other, (F.col("o") == F.col("m")) & (F.col("p") == F.col("q"))).select("s", "p", F.col("z").alias("o"))]


def _inverse(t: DataFrame) -> list[DataFrame]:
    i = _links(t, OWL.inverseOf).select(F.col("a.lex").alias("q"), F.col("b.lex").alias("r"))
    return [_flipped(t.join(_few(i.union(i.select("r", "q"))), F.col("p") == F.col("q")), "r")]


def _same_as(t: DataFrame) -> list[DataFrame]:
    same = _links(t, OWL.sameAs)
    both = _few(same.union(same.select("b", "a")))
    moved = [t.join(both, F.col(c) == F.col("a")).select(*(F.col("b").alias(c) if x == c else x for x in ("s", "p", "o"))) for c in ("s", "o")]
    return [both.select(F.col("a").alias("s"), F.lit(OWL.sameAs).alias("p"), F.col("b").alias("o")), *moved]


def _functional(cls: str, key: str, value: str) -> Callable[[DataFrame], list[DataFrame]]:
    def run(t: DataFrame) -> list[DataFrame]:
        rows = t.join(_of_type(t, cls), F.col("p") == F.col("q")).where(f"{value}.kind <> {LITERAL}").select("p", key, value)
        least = rows.groupBy("p", key).agg(F.min(value).alias("least"))  # all are the same as the least: no pair of all with all
        return [rows.join(least, ["p", key]).where(F.col(value) != F.col("least")).select(F.col(value).alias("s"), F.lit(OWL.sameAs).alias("p"), F.col("least").alias("o"))]

    return run


def _members(p: str, below: bool) -> Callable[[DataFrame], list[DataFrame]]:
    def run(t: DataFrame) -> list[DataFrame]:
        heads = _links(t, p)
        found = lists(t, heads.select(F.col("b").alias("head")).distinct())
        pairs = heads.join(found, F.col("b") == F.col("head")).select("a", F.explode("items").alias("m")).where(f"m.kind = {IRI}")
        s, o = ("m", "a") if below else ("a", "m")
        return [pairs.select(F.col(s).alias("s"), F.lit(RDFS.subClassOf).alias("p"), F.col(o).alias("o"))]

    return run


RULES: dict[str, Callable[[DataFrame], list[DataFrame]]] = {
    "rdfs_subclass": _subclass, "rdfs_subproperty": _subproperty, "rdfs_domain": lambda t: [_typed(t, RDFS.domain, "s", False)], "rdfs_range": lambda t: [_typed(t, RDFS.range, "o", False)],
    "owl_equivalent_class": _equivalent, "owl_symmetric_property": _symmetric, "owl_transitive_property": _transitive_properties, "owl_inverse_of": _inverse, "owl_same_as": _same_as,
    "owl_functional_property": _functional(OWL.FunctionalProperty, "s", "o"), "owl_inverse_functional_property": _functional(OWL.InverseFunctionalProperty, "o", "s"),
    "owl_union_of": _members(OWL.unionOf, True), "owl_intersection_of": _members(OWL.intersectionOf, False),
}
#: Rules that conclude nothing but may find a contradiction; see graph.inconsistencies().
CHECKS = {"owl_disjoint_class", "owl_different_from"}
_RDFS = frozenset({"rdfs_subclass", "rdfs_subproperty", "rdfs_domain", "rdfs_range"})
PRESETS = {
    "rdfs": _RDFS, "owl_el": _RDFS | {"owl_equivalent_class", "owl_intersection_of", "owl_transitive_property"}, "owl_ql": _RDFS | {"owl_equivalent_class", "owl_inverse_of", "owl_symmetric_property"},
    "owl_rl": _RDFS | set(RULES) | CHECKS, "custom": frozenset(),
}


@dataclass(frozen=True)
class Reasoning:
    """rules: names of RULES or CHECKS; custom: CONSTRUCT queries; rounds: at most so many, all that are needed if None; axioms: whether the triples given are part of the result."""

    rules: frozenset[str]
    custom: tuple[str, ...] = ()
    rounds: int | None = None
    axioms: bool = False

    def __post_init__(self) -> None:
        if unknown := sorted(self.rules - RULES.keys() - CHECKS):
            raise UnsupportedError(f"no rule {', '.join(unknown)}")


def preset(name: str, **options) -> Reasoning:
    """Tableau reasoners (owl_dl and the like) aren't here: an UnsupportedError says so."""
    if name not in PRESETS:
        raise UnsupportedError(f"no reasoning {name}")
    return Reasoning(frozenset(PRESETS[name]), **options)


def reason(triples: DataFrame, how: Reasoning) -> DataFrame:
    """(s, p, o) that the rules add, round by round until nothing is new; every round is a table in the shared folder."""
    from ..plans.engine import Engine
    from ..sources.quads import QuadSource

    now, added, done = settled(once(triples.select("s", "p", "o")), "given"), [], 0
    while how.rounds is None or done < how.rounds:
        made = [d for r in sorted(how.rules & RULES.keys()) for d in RULES[r](now)]
        made += [Engine(now.sparkSession, QuadSource.of_triples(now)).run(q).select("s", "p", "o") for q in how.custom]
        new, done = _new(now, made or [now.limit(0)], "reasoned"), done + 1
        added.append(new)
        if new.isEmpty():
            break
        now = now.union(new)
    return now if how.axioms else reduce(DataFrame.union, added) if added else now.limit(0)
