"""Shapes are compiled on the driver; each constraint is one DataFrame of violations over all focus nodes at once.

Focus nodes and values are Solutions, so over tables they stay native columns. A
nested shape is evaluated from the bottom up, as the set of nodes that fail it.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ShapeError
from ..functions.values import Value, constant, less, matches
from ..operators.graph import instances, lists
from ..operators.paths import X, closed_from, pairs, sequence
from ..plans import ast as A
from ..plans.engine import Engine
from ..plans.parser import parse_query
from ..plans.solutions import Solutions, column, join, union
from ..shared import once, settled
from ..sources.quads import QuadSource
from ..sources.relational import TableSource
from ..sources.turtle import parse
from ..terms import BNODE, IRI, LITERAL, TERM, TRIPLE, Term, iri, make, nt, nt_text
from ..vocab import NUMERIC, OWL, RDF, RDFS, SH, XSD

VIOLATIONS = f"focus {TERM}, path string, value {TERM}, severity string, message string, shape string, constraint string"
_VALID = {
    XSD.boolean: r"^(true|false|0|1)$", XSD.integer: r"^[+-]?[0-9]+$", XSD.decimal: r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", XSD.date: r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$",
    XSD.dateTime: r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$", XSD.time: r"^[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
    XSD.gYear: r"^-?[0-9]{4,}(Z|[+-][0-9]{2}:[0-9]{2})?$", XSD.gYearMonth: r"^-?[0-9]{4,}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$", XSD.hexBinary: r"^([0-9A-Fa-f]{2})*$", XSD.double: r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
}
_VALID |= {dt: _VALID[XSD.integer] for dt in NUMERIC if dt not in (XSD.decimal, XSD.float, XSD.double)} | {XSD.float: _VALID[XSD.double]}
_KINDS = {"IRI": (IRI,), "BlankNode": (BNODE,), "Literal": (LITERAL,), "BlankNodeOrIRI": (IRI, BNODE), "BlankNodeOrLiteral": (BNODE, LITERAL), "IRIOrLiteral": (IRI, LITERAL), "TripleTerm": (TRIPLE,)}
_CACHE: dict[str, "Shapes"] = {}


class Shapes:
    """A shapes graph, indexed on the driver: shapes are few whatever the data."""

    def __init__(self, triples: list[tuple[Term, str, Term]]) -> None:
        self.by: dict[Term, list[tuple[str, Term]]] = {}
        for s, p, o in triples:
            self.by.setdefault(s, []).append((p, o))
        found = []
        for s, own in self.by.items():
            props = {p for p, _ in own}
            kinds = {o.lex for p, o in own if p == RDF.type}
            targeted = any(p.startswith(f"{SH}target") for p in props)
            if targeted or SH.NodeShape in kinds or SH.ShapeClass in kinds or SH.PropertyShape in kinds and targeted:
                found.append(s)
        self.roots = sorted(found)

    def all(self, s: Term, p: str) -> list[Term]:
        return [o for q, o in self.by.get(s, []) if q == p]

    def one(self, s: Term, p: str) -> Term | None:
        got = self.all(s, p)
        return got[0] if got else None

    def true(self, s: Term, p: str) -> bool:
        got = self.one(s, p)
        return got is not None and got.lex in ("true", "1")

    def items(self, head: Term) -> list[Term]:
        out, seen = [], set()
        while head.lex != RDF.nil:
            if head in seen or self.one(head, RDF.first) is None or self.one(head, RDF.rest) is None:
                raise ShapeError(f"a malformed list at {head}")
            seen.add(head)
            out.append(self.one(head, RDF.first))
            head = self.one(head, RDF.rest)
        return out

    def path(self, n: Term) -> A.Path:
        if n.kind == IRI:
            return A.Link(n.lex)
        if self.one(n, RDF.first) is not None:
            return A.Sequence(tuple(self.path(x) for x in self.items(n)))
        for p, make_ in ((SH.inversePath, A.Inverse), (SH.zeroOrMorePath, lambda x: A.Repeat(x, 0, None)), (SH.oneOrMorePath, lambda x: A.Repeat(x, 1, None)), (SH.zeroOrOnePath, lambda x: A.Repeat(x, 0, 1))):
            if (o := self.one(n, p)) is not None:
                return make_(self.path(o))
        if (o := self.one(n, SH.alternativePath)) is not None:
            return A.Alternative(tuple(self.path(x) for x in self.items(o)))
        raise ShapeError(f"no path at {n}")


def digest(triples: list[tuple[Term, str, Term]]) -> str:
    """SHA-256 of the sorted rows: the key under which compiled shapes are kept."""
    return hashlib.sha256("\0".join(sorted(f"{nt_text(s)} {p} {nt_text(o)}" for s, p, o in triples)).encode()).hexdigest()


def compiled(shapes: str | list) -> Shapes:
    triples = [q[1:] for q in parse(shapes)] if isinstance(shapes, str) else shapes
    key = digest(triples)
    if key not in _CACHE:
        _CACHE[key] = Shapes(triples)
    return _CACHE[key]


class Validator:
    def __init__(self, spark: SparkSession, source: Any, shapes: str | list, strict: bool = True) -> None:
        """strict: ranges compare numbers and dateTimes only; anything else is a violation. Otherwise strings, dates and booleans compare too."""
        self.spark, self.source, self.strict = spark, source, strict
        self.shapes = compiled(shapes)
        self.engine = Engine(spark, source)
        self.stack: list[Term] = []

    # sets of nodes, as Solutions of f
    def nodes(self, df: DataFrame, col: Column) -> Solutions:
        return Solutions.of(df, {"f": Value("term", col)})

    def constant_nodes(self, terms: list[Term]) -> Solutions:
        return self.nodes(self.spark.createDataFrame([(t.row,) for t in terms], f"t {TERM}"), F.col("t"))

    def of_class(self, cls: str) -> Solutions:
        if isinstance(self.source, TableSource):
            return self.source.stars([A.Triple(A.Var("f"), Term(IRI, RDF.type), iri(cls))])[0]
        return self.nodes(instances(self.source.triples(), cls), F.col("node"))

    def focus(self, s: Term) -> Solutions | None:
        sh, found = self.shapes, []
        classes = [o.lex for o in sh.all(s, SH.targetClass)]
        kinds = {o.lex for o in sh.all(s, RDF.type)}
        if SH.ShapeClass in kinds or kinds & {RDFS.Class, OWL.Class}:
            classes.append(s.lex)
        found += [self.of_class(c) for c in classes]
        if nodes := sh.all(s, SH.targetNode):
            found.append(self.constant_nodes(nodes))
        for p, at in ((SH.targetSubjectsOf, "s"), (SH.targetObjectsOf, "o")):
            for o in sh.all(s, p):
                a, b = (A.Var("f"), A.Var("x")) if at == "s" else (A.Var("x"), A.Var("f"))
                found.append(self.source.stars([A.Triple(a, Term(IRI, o.lex), b)])[0].project(["f"]).distinct())
        for o in sh.all(s, SH.targetWhere):
            t = self.source.triples()
            everything = self.nodes(once(t.select("s")), F.col("s"))
            found.append(join(everything, self.failing(o, everything), "anti"))
        if s.kind == IRI and isinstance(self.source, QuadSource):
            found.append(self.source.stars([A.Triple(A.Var("f"), Term(IRI, SH.shape), s)])[0])
        if not found:
            return None
        return found[0] if len(found) == 1 else union(found).distinct()

    # validation
    def validate(self, limit: int | None = None) -> DataFrame:
        """focus, path, value, severity, message, shape, constraint of each violation."""
        parts = []
        for s in self.shapes.roots:
            if self.shapes.true(s, SH.deactivated):
                continue
            f = self.focus(s)
            if f is not None:
                parts += self.check(s, f)
        made = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], VIOLATIONS)
        return made.limit(limit) if limit else made

    def conforms(self) -> bool:
        return self.validate().where(F.col("severity").isin("Violation", "Error")).isEmpty()

    def validate_resource(self, node: Term) -> DataFrame:
        """Of the triples that touch the resource only."""
        from ..terms import lit

        t = self.source.triples().where((F.col("s") == lit(node)) | (F.col("o") == lit(node)))
        own = Validator(self.spark, QuadSource.of_triples(t), [(s, p, o) for s, x in self.shapes.by.items() for p, o in x], self.strict)
        return own.validate().where(F.col("focus") == lit(node))

    def failing(self, s: Term, nodes: Solutions) -> Solutions:
        """Those of the nodes (f) that don't conform to the shape. A shape that calls itself doesn't conform."""
        if self.shapes.true(s, SH.deactivated):
            return nodes.none()
        if s in self.stack or len(self.stack) > 64:
            return nodes
        parts = self.check(s, nodes)
        if not parts:
            return nodes.none()
        bad = reduce(DataFrame.union, [p.select("focus") for p in parts]).distinct()
        return self.nodes(bad, F.col("focus"))

    def check(self, s: Term, focus: Solutions) -> list[DataFrame]:
        if s in self.stack:
            return [self.row(s, focus, None, "", "node", "the shape calls itself")]
        self.stack.append(s)
        try:
            focus = focus.project(["f"])
            path_node = self.shapes.one(s, SH.path)
            if path_node is None:
                values = Solutions.of(focus.df, {"f": focus.values["f"], "v": focus.values["f"]})
                return self.constraints(s, focus, values, "")
            path = self.shapes.path(path_node)
            if isinstance(path, A.Sequence):  # from the focus nodes on, not from all nodes
                first = join(Solutions.of(focus.df, {X: focus.values["f"]}), pairs(self.source, path.steps[0]))
                found = sequence(self.source, path, first)
                values = Solutions.of(found.df, {"f": found.values["_x"], "v": found.values["_y"]})
            else:
                found = pairs(self.source, path)
                values = join(focus, Solutions.of(found.df, {"f": found.values["_x"], "v": found.values["_y"]}))
            return self.constraints(s, focus, values, path_node.lex if path_node.kind == IRI else str(path), path)
        finally:
            self.stack.pop()

    def row(self, s: Term, sols: Solutions, value: str | None, path: str, what: str, message: str) -> DataFrame:
        severity = self.shapes.one(s, SH.severity)
        text = self.shapes.one(s, SH.message)
        v = sols.values[value].term() if value else F.lit(None).cast(TERM)
        level = severity.lex.removeprefix(SH) if severity else "Violation"
        return sols.df.select(
            sols.values["f"].term().alias("focus"), F.lit(path or None).cast("string").alias("path"), v.alias("value"), F.lit(level).alias("severity"),
            F.lit(text.lex if text else message).alias("message"), F.lit(s.lex).alias("shape"), F.lit(what).alias("constraint"),
        )

    def without(self, focus: Solutions, ok: Solutions) -> Solutions:
        return join(focus, ok.project(["f"]), "anti")

    def related(self, prop: Term, name: str = "w") -> Solutions:
        found = pairs(self.source, self.shapes.path(prop))
        return Solutions.of(found.df, {"f": found.values["_x"], name: found.values["_y"]})

    def unmatched(self, a: Solutions, b: Solutions) -> tuple[Solutions, Solutions]:
        """Of two bags of (f, v) what each has more often than the other, as often as that."""
        a, b = (x.project(["f", "v"]).cast({"f", "v"}) for x in (a, b))
        f, v = column("f"), column("v")
        both = a.df.select(f, v, F.lit(1).alias("n")).unionByName(b.df.select(f, v, F.lit(-1).alias("n"))).groupBy(f, v).agg(F.sum("n").alias("n"))
        more = lambda n: Solutions(both.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), n.cast("bigint")))).select(f, v), a.values)
        return more(F.col("n")), more(-F.col("n"))

    def bad_values(self, s: Term, values: Solutions, shape: Term) -> Solutions:
        """(f, v) whose value fails a shape."""
        if not self.shapes.true(shape, SH.deactivated) and (shape in self.stack or len(self.stack) > 64):
            return values  # as in failing(): all of them
        v = values.project(["v"]).distinct()
        bad = self.failing(shape, Solutions.of(v.df, {"f": v.values["v"]}))
        return join(values, Solutions.of(bad.df, {"v": bad.values["f"]}), "semi")

    def counted(self, focus: Solutions, values: Solutions) -> tuple[DataFrame, Column]:
        """Each focus node with the number n of its distinct values."""
        left, right = focus, values
        if not left.values["f"].like(right.values["f"]):
            left, right = left.cast({"f"}), right.cast({"f"})
        n = right.df.groupBy(right.values["f"].col.alias("k")).agg(F.count_distinct(right.values["v"].col).alias("n"))
        return left.df.join(n, F.col(column("f")) == F.col("k"), "left"), F.coalesce("n", F.lit(0))

    def constraints(self, s: Term, focus: Solutions, values: Solutions, path: str, at: A.Path | None = None) -> list[DataFrame]:
        sh, out = self.shapes, []
        v, f = values.values["v"], values.values["f"]
        get = lambda name: sh.all(s, SH[name])
        number = lambda name: [int(o.lex) for o in get(name)]

        def say(sols: Solutions, what: str, message: str, value: str | None = "v") -> None:
            out.append(self.row(s, sols, value, path, what, message))

        def where(condition: Column, what: str, message: str) -> None:
            say(values.where(condition), what, message)

        def focus_of(df: DataFrame) -> Solutions:
            cast = not focus.values["f"].like(f)
            return Solutions(df, (focus.cast({"f"}) if cast else focus).values)

        for n in number("minCount"):
            df, count = self.counted(focus, values)
            say(focus_of(df.where(count < n)), "minCount", f"fewer than {n} values", None)
        for n in number("maxCount"):
            df, count = self.counted(focus, values)
            say(focus_of(df.where(count > n)), "maxCount", f"more than {n} values", None)
        for o in get("datatype"):
            types = [o.lex] if sh.one(o, RDF.first) is None else [x.lex for x in sh.items(o)]
            fine = F.lit(False)
            for dt in types:
                own = v.datatype() == dt
                fine = fine | (own & v.text().rlike(_VALID[dt]) if dt in _VALID and v.form in ("term", "str") else own)
            where(~F.coalesce(fine, F.lit(False)), "datatype", f"not of {' or '.join(types)}")
        for o in get("class"):
            classes = [o.lex] if sh.one(o, RDF.first) is None else [x.lex for x in sh.items(o)]
            members = union([self.of_class(c) for c in classes]) if len(classes) > 1 else self.of_class(classes[0])
            say(join(values, Solutions.of(members.df, {"v": members.values["f"]}), "anti"), "class", f"not in {' or '.join(classes)}")
        for o in get("nodeKind"):
            where(~v.kind().isin(*_KINDS[o.lex.removeprefix(SH)]), "nodeKind", f"not {o.lex.removeprefix(SH)}")
        for o in get("pattern"):
            flags = "".join(x for x in (sh.one(s, SH.flags).lex if sh.one(s, SH.flags) else "") if x in "ims")
            where((v.kind() == BNODE) | ~F.coalesce(v.text().rlike(f"(?{flags}){o.lex}" if flags else o.lex), F.lit(False)), "pattern", f"doesn't match {o.lex}")
        for n in number("minLength"):
            where((v.kind() == BNODE) | (F.length(v.text()) < n), "minLength", f"shorter than {n}")
        for n in number("maxLength"):
            where((v.kind() == BNODE) | (F.length(v.text()) > n), "maxLength", f"longer than {n}")
        if sh.true(s, SH.singleLine):
            where(v.text().rlike(r"[\f\r\n\x0B]"), "singleLine", "more than one line")
        for o in get("in"):
            where(~F.coalesce(reduce(lambda a, b: a | b, [matches(v, t) for t in sh.items(o)], F.lit(False)), F.lit(False)), "in", "not one of the values")
        for o in get("hasValue"):
            say(self.without(focus, values.where(matches(v, o))), "hasValue", f"lacks {o.lex}", None)
        for o in get("languageIn"):
            lang = F.lower(v.term()["lang"])
            ok = F.lit(False)
            for r in sh.items(o):
                tag = r.lex.lower().removesuffix("-*")
                ok = ok | (lang != "" if tag == "*" else (lang == tag) | F.startswith(lang, F.lit(f"{tag}-")))
            where(~F.coalesce(ok, F.lit(False)), "languageIn", "in another language")
        if sh.true(s, SH.uniqueLang):
            t = v.term()
            twice = values.df.where(t["lang"] != "").groupBy(f.col.alias(column("f")), F.lower(t["lang"]), t["dir"]).count().where("count > 1")
            say(Solutions(twice, {"f": f.at(column("f"))}), "uniqueLang", "more than one value in a language", None)
        for o in get("equals"):
            other = self.related(o, "v")
            left, right = self.unmatched(values, join(focus, other))
            say(left, "equals", f"not a value of {o.lex}")
            say(right, "equals", f"lacks a value of {o.lex}")
        for o in get("subsetOf"):
            say(join(values, self.related(o, "v"), "anti"), "subsetOf", f"not a value of {o.lex}")
        for o in get("disjoint"):
            hit = join(values, self.related(o, "v"), "semi")
            first = hit.df.groupBy(hit.values["f"].col.alias(column("f"))).agg(F.min(hit.values["v"].col).alias(column("v")))
            say(Solutions(first, {"f": hit.values["f"].at(column("f")), "v": hit.values["v"].at(column("v"))}), "disjoint", f"a value of {o.lex} too")
        for name, strict in (("lessThan", True), ("lessThanOrEquals", False)):
            for o in get(name):
                both = join(values, self.related(o, "w"))
                ok = less(both.values["v"], both.values["w"], strict)
                say(both.where(~F.coalesce(ok, F.lit(False))), name, f"not {'less than' if strict else 'at most'} {o.lex}")
        for name, flip, strict in (("minInclusive", True, False), ("maxInclusive", False, False), ("minExclusive", True, True), ("maxExclusive", False, True)):
            for o in get(name):
                c = constant(o)
                ok = less(c, v, strict) if flip else less(v, c, strict)
                if self.strict and c.form not in ("num", "time"):
                    ok = F.lit(False)
                where(~F.coalesce(ok, F.lit(False)), name, f"out of range {o.lex}")
        # shapes of values
        for o in get("node"):
            say(self.bad_values(s, values, o), "node", f"doesn't conform to {o.lex}")
        for o in get("nodeByExpression"):
            say(self.bad_values(s, values, o), "nodeByExpression", f"doesn't conform to {o.lex}")
        for o in get("shape"):
            say(self.bad_values(s, values, o), "shape", f"doesn't conform to {o.lex}")
        for o in get("not"):
            say(join(values, self.bad_values(s, values, o), "anti"), "not", f"conforms to {o.lex}")
        for name in ("and", "or", "xone"):
            for o in get(name):
                operands = sh.items(o)
                marked = [self.bad_values(s, values, x).project(["f", "v"]).distinct() for x in operands]
                marked = [m.cast({"f", "v"}).df.select(F.col(column("f")).alias("bf"), F.col(column("v")).alias("bv")) for m in marked]
                failed = reduce(DataFrame.union, marked).groupBy("bf", "bv").agg(F.count(F.lit(1)).alias("failed"))
                terms = values.cast({"f", "v"})
                df = terms.df.join(failed, (F.col(column("f")) == F.col("bf")) & (F.col(column("v")) == F.col("bv")), "left")
                fine = len(operands) - F.coalesce("failed", F.lit(0))
                ok = {"and": fine == len(operands), "or": fine > 0, "xone": fine == 1}[name]
                say(Solutions(df.where(~ok), terms.values), name, f"doesn't conform to {name}")
        for o in get("property"):
            v2 = values.project(["v"]).distinct()
            if not sh.true(o, SH.deactivated):
                out.extend(self.check(o, Solutions.of(v2.df, {"f": v2.values["v"]})))
        for o in get("someValue"):
            say(self.without(focus, join(values.where(v.kind() != LITERAL), self.bad_values(s, values, o), "anti")), "someValue", f"no value conforms to {o.lex}", None)
        for o in get("qualifiedValueShape"):
            nodes = values.where(v.kind() != LITERAL)
            ok = join(nodes, self.bad_values(s, nodes, o), "anti")
            if sh.true(s, SH.qualifiedValueShapesDisjoint):
                for parent in [x for x, own in sh.by.items() if (SH.property, s) in own]:
                    for other in sh.all(parent, SH.property):
                        for q in sh.all(other, SH.qualifiedValueShape):
                            if other != s:
                                ok = join(ok, self.bad_values(s, ok, q), "semi")
            df, count = self.counted(focus, ok)
            for n in number("qualifiedMinCount"):
                say(focus_of(df.where(count < n)), "qualifiedMinCount", f"fewer than {n} values conform", None)
            for n in number("qualifiedMaxCount"):
                say(focus_of(df.where(count > n)), "qualifiedMaxCount", f"more than {n} values conform", None)
        for o in get("rootClass"):
            t = self.source.triples()
            edges = settled(t.where(F.col("p") == RDFS.subClassOf).select(F.col("o").alias("x"), F.col("s").alias("y")).distinct(), "edges")
            root = make(IRI, F.lit(o.lex))
            below = closed_from(edges, edges.where(F.col("x") == root)).select("y").union(self.spark.range(1).select(root.alias("y"))).distinct()
            say(join(values, Solutions.of(below, {"v": Value("term", F.col("y"))}), "anti"), "rootClass", f"no subclass of {o.lex}")
        if any(get(n) for n in ("minListLength", "maxListLength", "memberShape", "uniqueMembers")):
            self.list_constraints(s, values, get, say)
        if sh.one(s, SH.closed) is not None and sh.one(s, SH.closed).lex not in ("false", "0"):
            self.closed(s, focus, say)
        for o in get("uniqueValuesFor"):
            self.unique_values(s, focus, sh.items(o) if sh.one(o, RDF.first) is not None else [o], say)
        for o in get("sparql"):
            self.sparql(s, o, focus, say)
        if at is not None and isinstance(at, A.Link) and (get("reifierShape") or sh.true(s, SH.reificationRequired)):
            self.reified(s, values, at.iri, get("reifierShape"), say)
        return out

    def list_constraints(self, s: Term, values: Solutions, get: Any, say: Any) -> None:
        terms = values.cast({"f", "v"})
        heads = settled(terms.df.select(F.col(column("v")).alias("head")).distinct(), "heads")
        found = settled(lists(self.source.triples(), heads), "lists")
        df = terms.df.join(found, F.col(column("v")) == F.col("head"), "left")
        sols = lambda c: Solutions(df.where(c), terms.values)
        broken = F.col("items").isNull()
        for o in get("minListLength"):
            say(sols(broken | (F.size("items") < int(o.lex))), "minListLength", f"a list of fewer than {o.lex}")
        for o in get("maxListLength"):
            say(sols(broken | (F.size("items") > int(o.lex))), "maxListLength", f"a list of more than {o.lex}")
        if self.shapes.true(s, SH.uniqueMembers):
            say(sols(broken | (F.size("items") != F.size(F.array_distinct("items")))), "uniqueMembers", "a member comes twice")
        for o in get("memberShape"):
            members = Solutions.of(df.select(column("f"), column("v"), F.explode("items").alias("m")), {"f": Value("term", F.col(column("f"))), "w": Value("term", F.col(column("v"))), "v": Value("term", F.col("m"))})
            bad = self.bad_values(s, members.where(members.values["v"].kind() != LITERAL), o)
            hit = bad.df.groupBy(F.col(column("f")), F.col(column("w"))).count()
            say(Solutions(hit.withColumnRenamed(column("w"), column("v")), {"f": Value("term", F.col(column("f"))), "v": Value("term", F.col(column("v")))}), "memberShape", f"a member doesn't conform to {o.lex}")
            say(sols(broken), "memberShape", "no list")

    def closed(self, s: Term, focus: Solutions, say: Any) -> None:
        sh = self.shapes

        def named(p: Any) -> set[str]:
            if isinstance(p, A.Link):
                return {p.iri}
            parts = getattr(p, "steps", None) or getattr(p, "options", None) or ([p.path] if isinstance(p, A.Repeat) else [])
            return set().union(*map(named, parts)) if parts else set()

        shapes = [s]
        if sh.one(s, SH.closed).lex == SH.ByTypes:
            shapes += [x for x in sh.roots if x != s and sh.all(x, SH.property)]
        allowed = {RDF.type} if len(shapes) > 1 else set()
        for x in shapes:
            for p in sh.all(x, SH.property):
                if sh.one(p, SH.path) is not None:
                    allowed |= named(sh.path(sh.one(p, SH.path)))
        for o in sh.all(s, SH.ignoredProperties):
            allowed |= {x.lex for x in sh.items(o)}
        if isinstance(self.source, TableSource):  # only the tables of the focus nodes, and of them the columns that aren't allowed
            t = self.source.quads(self.source.of_resources(focus.values["f"]) or [*self.source.maps][:1], allowed).select("s", "p", "o")
        else:
            t = self.source.triples().where(~F.col("p").isin(*allowed))
        extra = Solutions.of(t, {"f": Value("term", F.col("s")), "v": Value("term", F.col("o"))})
        say(join(focus, extra), "closed", "a predicate that the shape lacks")

    def unique_values(self, s: Term, focus: Solutions, props: list[Term], say: Any) -> None:
        terms = focus.cast({"f"})
        df = terms.df.select(F.col(column("f")).alias("f"))
        names = []
        for i, p in enumerate(props):
            found = self.related(p, "w").cast({"f", "w"})
            key = found.df.groupBy(F.col(column("f")).alias("kf")).agg(F.array_sort(F.collect_list(nt(F.col(column("w"))))).alias(f"k{i}"))
            df = df.join(key, F.col("f") == F.col("kf"), "left").drop("kf")
            names.append(f"k{i}")
        whole = df.where(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])).select("f", F.to_json(F.struct(*names)).alias("key")).distinct()
        # nodes of one key meet by a join, so none of them is gathered
        pairs_ = whole.join(whole.select("key", F.col("f").alias("o")), "key").where("f <> o").select("f", "o")
        say(Solutions.of(pairs_, {"f": Value("term", F.col("f")), "v": Value("term", F.col("o"))}), "uniqueValuesFor", "the values are another node's too")

    def sparql(self, s: Term, o: Term, focus: Solutions, say: Any) -> None:
        """The query is solved once for all focus nodes: $this is a column."""
        prefixes = {}
        for decl in [x for p in self.shapes.all(o, SH.prefixes) for x in self.shapes.all(p, SH.declare)]:
            prefixes[self.shapes.one(decl, SH.prefix).lex] = self.shapes.one(decl, SH.namespace).lex
        from ..vocab import PREFIXES

        q = parse_query(self.shapes.one(o, SH.select).lex, {**PREFIXES, **prefixes})
        names = [("f", A.Ref("this"))] + [("v", A.Ref("value"))] * any(n == "value" for n, _ in q.items or ())
        group = (("this", A.Ref("this")),) if not q.group_by else q.group_by
        rows = self.engine.solve(q)
        if "this" not in rows.values:
            rows = self.engine.solve(A.Select((("this", A.Ref("this")), *(q.items or ())), q.where, group_by=group if q.having else (), having=q.having))
        hit = Solutions.of(rows.df, {n: rows.values[e.var] for n, e in names if e.var in rows.values})
        value = hit.values.get("v")
        once = hit.project(["f"]).distinct() if value is None else hit
        message = self.shapes.one(o, SH.message)
        made = join(focus, once)
        if value is None or "v" not in made.values:
            say(made, "sparql", message.lex if message else "the query has a row", None)
        else:
            say(made, "sparql", message.lex if message else "the query has a row")

    def reified(self, s: Term, values: Solutions, p: str, shapes: list[Term], say: Any) -> None:
        terms = values.cast({"f", "v"})
        text = F.concat(F.lit("<<( "), nt(F.col(column("f"))), F.lit(f" <{p}> "), nt(F.col(column("v"))), F.lit(" )>>"))
        t = self.source.triples().where(F.col("p") == RDF.reifies).select(F.col("s").alias("r"), F.col("o.lex").alias("claim"))
        df = terms.df.withColumn("text", text).join(t, F.col("text") == F.col("claim"), "left")
        if self.shapes.true(s, SH.reificationRequired):
            say(Solutions(df.where("r IS NULL"), terms.values), "reificationRequired", "no reifier")
        for o in shapes:
            known = Solutions.of(df.where("r IS NOT NULL"), {"f": Value("term", F.col(column("f"))), "w": Value("term", F.col(column("v"))), "v": Value("term", F.col("r"))})
            say(self.bad_values(s, known, o), "reifierShape", f"a reifier doesn't conform to {o.lex}")


def report(violations: DataFrame) -> DataFrame:
    """(severity, shape, constraint, n)."""
    return violations.groupBy("severity", "shape", "constraint").agg(F.count(F.lit(1)).alias("n"))


def as_triples(violations: DataFrame) -> DataFrame:
    """The report as (s, p, o): a report node that says whether the data conform and names its results, and the results. Results that are equal in all columns are numbered, so each has a node."""
    spark = violations.sparkSession
    columns = [F.coalesce(F.to_json(F.struct(c)), F.lit("-")) for c in violations.columns]
    copy = F.row_number().over(Window.partitionBy(*violations.columns).orderBy(F.lit(1)))
    numbered = violations.withColumn("copy", copy)
    node = make(BNODE, F.concat(F.lit("r"), F.substring(F.sha2(F.concat_ws("\x1f", *columns, F.col("copy").cast("string")), 256), 1, 24)))
    text = lambda c: make(LITERAL, F.col(c), XSD.string)
    path = F.when(F.col("path").rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^ ]*$"), make(IRI, F.col("path"))).otherwise(text("path"))  # other than a predicate: as it is written
    source = make(F.when(F.col("shape").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(IRI)).otherwise(F.lit(BNODE)), F.col("shape"))
    severity = F.when(F.col("severity").contains(":"), F.col("severity")).otherwise(F.concat(F.lit(SH), "severity"))
    report_node = make(BNODE, F.lit("report"))
    cells = [
        (RDF.type, make(IRI, F.lit(SH.ValidationResult))), (SH.focusNode, F.col("focus")), (SH.resultPath, F.when(F.col("path").isNotNull(), path)), (SH.value, F.col("value")), (SH.resultSeverity, make(IRI, severity)),
        (SH.resultMessage, text("message")), (SH.sourceShape, source), (SH.sourceConstraintComponent, make(IRI, F.concat(F.lit(SH), F.upper(F.substring("constraint", 1, 1)), F.expr("substr(constraint, 2)"), F.lit("ConstraintComponent")))),
    ]
    own = [F.struct(node.alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in cells]
    rows = numbered.select(F.explode(F.array(*own, F.struct(report_node.alias("s"), F.lit(SH.result).alias("p"), node.alias("o")))).alias("x")).select("x.*").where("o IS NOT NULL")
    bad = violations.agg(F.count_if(F.col("severity").isin("Violation", "Error")).alias("n"))
    head = bad.select(F.explode(F.array(F.struct(F.lit(RDF.type).alias("p"), make(IRI, F.lit(SH.ValidationReport)).alias("o")), F.struct(F.lit(SH.conforms).alias("p"), make(LITERAL, (F.col("n") == 0).cast("string"), XSD.boolean).alias("o")))).alias("x"))
    return head.select(report_node.alias("s"), "x.p", "x.o").unionByName(rows)
