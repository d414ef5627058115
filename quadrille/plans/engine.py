"""From syntax trees to DataFrames.

Groups are folded from left to right; consecutive triple patterns form one basic
pattern, whose parts are joined in an order that avoids cross products. Filters
apply to the whole group. Catalyst picks the physical joins.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError, UnsupportedError
from ..functions.builtins import AGGREGATES, arithmetic, call, parts
from ..functions.values import Value, constant, equal, less, matches, order_key
from ..operators.graph import describe
from ..operators.paths import path_solutions
from ..terms import IRI, LITERAL, TERM, Term, lit, make, nt
from ..vocab import RDF, XSD
from . import ast as A
from .parser import parse_query
from .solutions import Solutions, column, join, minus, union


def variables(x: Any) -> set[str]:
    """The variables that a node, pattern or expression names, those of nested groups too."""
    if isinstance(x, A.Var):
        return {x.name}
    if isinstance(x, A.Ref):
        return {x.var}
    if isinstance(x, (A.Triple, A.Quoted)):
        return variables(x.s) | variables(x.p) | variables(x.o)
    if isinstance(x, (A.Call,)):
        return set().union(*map(variables, x.args))
    if isinstance(x, A.Aggregate):
        return variables(x.arg)
    if isinstance(x, A.Exists):
        return set()
    return set()


def with_aggregates(x: Any) -> Any:
    """The expression, calls of registered aggregates as aggregates."""
    if not isinstance(x, A.Call):
        return x
    if x.name.lower() in AGGREGATES and len(x.args) == 1:
        return A.Aggregate(x.name, x.args[0])
    return A.Call(x.name, tuple(map(with_aggregates, x.args)))


def aggregates(x: Any) -> list[A.Aggregate]:
    if isinstance(x, A.Aggregate):
        return [x]
    return [y for a in x.args for y in aggregates(a)] if isinstance(x, A.Call) else []


def conjuncts(x: Any) -> list[Any]:
    return [y for a in x.args for y in conjuncts(a)] if isinstance(x, A.Call) and x.name == "&&" else [x]


class Engine:
    """Runs queries over a source (see quadrille.sources). services: IRI -> source, for SERVICE."""

    def __init__(self, spark: SparkSession, source: Any, services: dict[str, Any] | None = None) -> None:
        self.spark, self.source, self.services = spark, source, services or {}

    # queries
    def parsed(self, query: str | Any) -> Any:
        return parse_query(query) if isinstance(query, str) else query

    def run(self, query: str | Any) -> DataFrame:
        """Solutions as term columns; (s, p, o) for CONSTRUCT and DESCRIBE; one boolean for ASK."""
        q = self.parsed(query)
        if isinstance(q, A.Select):
            return self.solve(q).terms()
        return {A.Ask: self.ask, A.Construct: self.construct, A.Describe: self.describe}[type(q)](q)

    def select(self, query: str | A.Select) -> DataFrame:
        """Solutions as plain columns: values of literals of known types, otherwise the text of the term."""
        return self.solve(self.parsed(query)).native()

    def over(self, q: Any) -> "Engine":
        return Engine(self.spark, self.source.dataset(q.froms, q.from_named), self.services) if q.froms or q.from_named else self

    def ask(self, query: str | A.Ask) -> DataFrame:
        q = self.parsed(query)
        found = self.over(q).group(q.where).df.limit(1)
        return found.agg((F.count(F.lit(1)) > 0).alias("answer"))

    def construct(self, query: str | A.Construct) -> DataFrame:
        q = self.parsed(query)
        sols = self.over(q).modified(self.over(q).group(q.where), q.order_by, q.limit, q.offset)
        return self.instantiate(q.template, sols).distinct()

    def describe(self, query: str | A.Describe) -> DataFrame:
        q = self.parsed(query)
        engine = self.over(q)
        sols = engine.group(q.where)
        wanted = [A.Var(n) for n in sols.values] if q.terms is None else q.terms
        picked = []
        for t in wanted:
            if isinstance(t, A.Var):
                picked.append(sols.df.select(sols.values[t.name].term().alias("node")))
            else:
                picked.append(self.spark.range(1).select(lit(t).alias("node")))
        if not picked:
            return self.spark.createDataFrame([], f"s {TERM}, p string, o {TERM}")
        constants = [t for t in wanted if isinstance(t, Term)]
        triples = engine.source.around(constants) if len(constants) == len(wanted) else engine.source.triples()
        return describe(triples, reduce(DataFrame.union, picked).where("node IS NOT NULL").distinct())

    def instantiate(self, template: tuple[A.Triple, ...], sols: Solutions, g: Column | None = None) -> DataFrame:
        """(s, p, o) of the template for each solution, with a graph name if g is given; incomplete and illegal triples are left out. Blank nodes are fresh for each solution."""
        rows = sols.df
        if any(isinstance(n, A.Var) and n.name not in sols.values for t in template for n in (t.s, t.o)):
            rows = rows.withColumn("row_hash", F.sha2(F.to_json(F.struct(*(F.coalesce(v.text(), F.lit("")).alias(n) for n, v in sols.values.items()), F.lit(0).alias("_"))), 256))

        def value(n: A.Node) -> Value:
            if isinstance(n, A.Quoted):
                return call("triple", [value(n.s), value(n.p), value(n.o)])
            if not isinstance(n, A.Var):
                return constant(n)
            if n.name in sols.values:
                return sols.values[n.name]
            if n.name.startswith("_b"):
                return Value("bnode", F.concat(F.lit(f"{n.name}x"), F.substring("row_hash", 1, 24)))
            return constant(None)

        made = []
        for t in template:
            s, p, o = value(t.s), value(t.p), value(t.o)
            made.append(rows.select(*([] if g is None else [g.alias("g")]), s.term().alias("s"), F.when(p.kind() == IRI, p.text()).alias("p"), o.term().alias("o")).where(f"s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND s.kind <> {LITERAL}"))
        return reduce(DataFrame.union, made) if made else self.spark.createDataFrame([], f"s {TERM}, p string, o {TERM}")

    def solve(self, q: A.Select) -> Solutions:
        engine = self.over(q)
        sols = engine.group(q.where)
        items = q.items
        having, order = [with_aggregates(e) for e in q.having], [(with_aggregates(e), d) for e, d in q.order_by]
        if items is None:
            items = tuple((n, A.Ref(n)) for n in sols.values if not n.startswith("_b"))
        items = tuple((n, with_aggregates(e)) for n, e in items)
        used = [a for x in [e for _, e in items] + having + [e for e, _ in order] for a in aggregates(x)]
        if used or q.group_by:
            sols, named = engine.aggregate(sols, q.group_by, list(dict.fromkeys(used)))
            swap = lambda x: A.Ref(named[x]) if isinstance(x, A.Aggregate) else A.Call(x.name, tuple(map(swap, x.args))) if isinstance(x, A.Call) else x
            items, having, order = tuple((n, swap(e)) for n, e in items), [swap(e) for e in having], [(swap(e), d) for e, d in order]
        # aliases can be used by HAVING, ORDER BY and later items
        values = dict(sols.values)
        for n, e in items:
            values[n] = engine.expression(e, values)
        maybe = set(sols.maybe) | {n for n, e in items if not isinstance(e, A.Ref)}
        for e in having:
            sols = Solutions(sols.df.where(engine.expression(e, values).ebv()), sols.values, sols.maybe)
        names = [n for n, _ in items]
        # an optional variable that is selected under another name stays optional
        maybe |= {n for n, e in items if isinstance(e, A.Ref) and (e.var in sols.maybe or e.var not in sols.values)}
        whole = Solutions.of(sols.df, values, maybe)
        if q.distinct:
            plain = whole.project(names).distinct()
            return engine.modified(plain, tuple(order), q.limit, q.offset)
        return engine.modified(whole, tuple(order), q.limit, q.offset).project(names)

    def modified(self, sols: Solutions, order: tuple, limit: int | None, offset: int | None) -> Solutions:
        df = sols.df
        if order:
            keys = []
            for e, down in order:
                keys += [k.desc_nulls_last() if down else k.asc_nulls_first() for k in order_key(self.expression(e, sols.values))]
            df = df.orderBy(*keys)
        if offset:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
        return Solutions(df, sols.values, sols.maybe)

    def aggregate(self, sols: Solutions, group_by: tuple, wanted: list[A.Aggregate]) -> tuple[Solutions, dict[A.Aggregate, str]]:
        keys = {n: self.expression(e, sols.values) for n, e in group_by}
        named, made, forms = {}, [], {}
        for i, a in enumerate(wanted):
            named[a] = f"_a{i}"
            value = self.one_aggregate(a, sols)
            made.append(value.col.alias(column(f"_a{i}")))
            forms[f"_a{i}"] = value
        cols = [v.col.alias(column(n)) for n, v in keys.items()]
        df = sols.df.groupBy(*cols).agg(*made) if made else sols.df.select(*cols).distinct()
        values = {n: v.at(column(n)) for n, v in {**keys, **forms}.items()}
        return Solutions(df, values, frozenset({n for n in keys if n in sols.maybe} | set(forms))), named

    def one_aggregate(self, a: A.Aggregate, sols: Solutions) -> Value:
        if a.arg is None:
            if a.distinct:
                return Value("num", F.count_distinct(F.struct(*(F.coalesce(nt(v.term()), F.lit("")) for v in sols.values.values()))), XSD.integer)
            return Value("num", F.count(F.lit(1)), XSD.integer)
        v = self.expression(a.arg, sols.values)
        if a.name.lower() in AGGREGATES:
            return AGGREGATES[a.name.lower()](v)
        if a.name == "count":
            return Value("num", F.count_distinct(v.col) if a.distinct else F.count(v.col), XSD.integer)
        if a.name in ("sum", "avg"):
            n = v.num()
            f = {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg}.get((a.name, a.distinct))
            got = f(n) if f else F.sum_distinct(n) / F.count_distinct(n)
            got = F.coalesce(got, F.lit(0).cast("double" if v.form == "term" else "int"))
            if v.form == "num" and isinstance(v.dt, str):
                return Value("num", got, XSD.decimal if a.name == "avg" and v.dt in (XSD.integer,) else v.dt)
            rank = F.coalesce(F.max(F.when(n.isNotNull(), v.rank())), F.lit(1))
            dt = F.when(rank == 1, XSD.decimal if a.name == "avg" else XSD.integer).when(rank == 2, XSD.decimal).when(rank == 3, XSD.float).otherwise(XSD.double)
            got = F.when(F.count(n) == F.count(v.col), got)  # a value that is no number is an error
            return Value("term", make(LITERAL, F.when(dt == XSD.integer, got.cast("bigint").cast("string")).otherwise(got.cast("string")), dt))
        if a.name == "group_concat":
            texts = F.collect_set(v.text()) if a.distinct else F.collect_list(v.text())
            return Value("str", F.array_join(F.array_sort(texts), a.separator))
        if a.name in ("min", "max", "sample"):
            pick, by = (F.max, F.max_by) if a.name == "max" else (F.min, F.min_by)
            if v.form == "term":
                return Value("term", by(v.col, F.when(v.col.isNotNull(), F.struct(*order_key(v)))))
            return Value(v.form, pick(v.col), v.dt, v.prefix)
        raise UnsupportedError(f"aggregate {a.name}")

    # patterns
    def group(self, g: A.Group, graph: Any = None) -> Solutions:
        sols, filters = self.unfiltered(g, graph)
        return self.filtered(sols, filters, graph)

    def unfiltered(self, g: A.Group, graph: Any = None) -> tuple[Solutions, list[Any]]:
        sols: Solutions | None = None
        waiting: list[Any] = []
        filters: list[Any] = []

        def add(other: Solutions) -> Solutions:
            return other if sols is None else join(sols, other)

        def flush() -> Solutions | None:
            nonlocal waiting
            made = sols
            for part in self.ordered(self.basic(waiting, graph), set(sols.values) if sols else set()):
                made = part if made is None else join(made, part)
            waiting = []
            return made

        for x in g.parts:
            if isinstance(x, (A.Triple, A.Reifier)):
                waiting.append(x)
                continue
            if isinstance(x, A.Filter):
                filters += conjuncts(x.expr)
                continue
            sols = flush()
            if isinstance(x, A.Optional_):
                left = sols or Solutions.unit(self.spark)
                right, own = self.unfiltered(x.group, graph)
                exists = [e for e in own if isinstance(e, A.Exists)]
                right = self.filtered(right, exists, graph)
                own = [e for e in own if e not in exists]
                sols = join(left, right, "left", self.condition(own) if own else None)
            elif isinstance(x, A.Union_):
                sols = add(union([self.group(b, graph) for b in x.branches]))
            elif isinstance(x, A.Minus):
                if sols is not None:
                    sols = minus(sols, self.group(x.group, graph))
            elif isinstance(x, A.Bind):
                left = sols or Solutions.unit(self.spark)
                if x.var in left.values:
                    raise QueryError(f"?{x.var} is bound already")
                value = self.expression(x.expr, left.values)
                sols = Solutions.of(left.df, {**left.values, x.var: value}, left.maybe | {x.var})
            elif isinstance(x, A.Graph):
                sols = add(self.group(x.group, x.name if isinstance(x.name, A.Var) else x.name.lex))
            elif isinstance(x, A.Service):
                if isinstance(x.name, A.Var) or x.name.lex not in self.services:
                    if x.silent:
                        continue
                    raise QueryError("unknown service")
                sols = add(Engine(self.spark, self.services[x.name.lex], self.services).group(x.group))
            elif isinstance(x, A.Values):
                sols = add(self.inline(x))
            elif isinstance(x, A.SubSelect):
                sols = add(self.solve(x.query))
            elif isinstance(x, A.Group):
                sols = add(self.group(x, graph))
            else:
                raise UnsupportedError(type(x).__name__)
        sols = flush()
        return sols or Solutions.unit(self.spark), filters

    def condition(self, exprs: list[Any]):
        return lambda values: reduce(lambda a, b: a & b, [self.expression(e, values).ebv() for e in exprs])

    def filtered(self, sols: Solutions, filters: list[Any], graph: Any = None) -> Solutions:
        for e in filters:
            if isinstance(e, A.Call) and e.name == "!" and isinstance(e.args[0], A.Exists):
                e = A.Exists(e.args[0].group, not e.args[0].negated)
            if isinstance(e, A.Exists):
                inner, own = self.unfiltered(e.group, graph)
                inner = self.filtered(inner, [f for f in own if isinstance(f, A.Exists)], graph)
                own = [f for f in own if not isinstance(f, A.Exists)]
                needed = [n for n in inner.values if n in sols.values or n in set().union(*map(variables, own))]
                sols = join(sols, inner.project(needed).distinct() if not own else inner.project(needed), "anti" if e.negated else "semi", self.condition(own) if own else None)
            elif nested := self.exists_in(e):
                sols = self.marked(sols, e, nested, graph)
            else:
                sols = sols.where(self.expression(e, sols.values).ebv())
        return sols

    def exists_in(self, e: Any) -> list[A.Exists]:
        return [e] if isinstance(e, A.Exists) else [y for a in e.args for y in self.exists_in(a)] if isinstance(e, A.Call) else []

    def marked(self, sols: Solutions, e: Any, nested: list[A.Exists], graph: Any) -> Solutions:
        """EXISTS inside an expression: each becomes a column."""
        values = dict(sols.values)
        swaps: dict[A.Exists, str] = {}
        df = sols.df
        for i, x in enumerate(nested):
            keyed = Solutions(df, sols.values, sols.maybe)
            hit = self.filtered(keyed, [A.Exists(x.group)], graph).df.distinct().withColumn(f"m_{i}", F.lit(True))
            same = reduce(lambda a, b: a & b, [F.col(column(n)).eqNullSafe(F.col(f"h_{n}")) for n in sols.values], F.lit(True))
            df = df.join(hit.select(*(F.col(column(n)).alias(f"h_{n}") for n in sols.values), f"m_{i}"), same, "left").drop(*(f"h_{n}" for n in sols.values))
            values[f"_m{i}"] = Value("bool", F.col(f"m_{i}").isNotNull() != F.lit(x.negated))
            swaps[x] = f"_m{i}"
        swap = lambda y: A.Ref(swaps[y]) if isinstance(y, A.Exists) else A.Call(y.name, tuple(map(swap, y.args))) if isinstance(y, A.Call) else y
        return Solutions.of(df.where(self.expression(swap(e), values).ebv()), sols.values, sols.maybe)

    def inline(self, x: A.Values) -> Solutions:
        schema = ", ".join(f"`{column(n)}` {TERM}" for n in x.vars)
        df = self.spark.createDataFrame([tuple(None if t is None else t.row for t in row) for row in x.rows], schema)
        maybe = {n for i, n in enumerate(x.vars) if any(row[i] is None for row in x.rows)}
        values = {n: Value("term", F.col(column(n))) for n in x.vars}
        for i, n in enumerate(x.vars):  # strings stay native, so that joins with string columns do
            if x.rows and all(r[i] is None or (r[i].kind == LITERAL and r[i].dt == XSD.string and not r[i].lang) for r in x.rows):
                values[n] = Value("str", F.col(column(n))["lex"])
        return Solutions.of(df, values, maybe)

    def basic(self, patterns: list[Any], graph: Any) -> list[Solutions]:
        plain: list[A.Triple] = []
        out: list[Solutions] = []
        for x in patterns:
            if isinstance(x, A.Reifier):
                x = A.Triple(x.reifier, A.Link(RDF.reifies), x.triple)
            p = x.p
            if isinstance(p, A.Path) and not isinstance(p, A.Link):
                out.append(path_solutions(self.source, x.s, p, x.o, graph))
                continue
            p = Term(IRI, p.iri) if isinstance(p, A.Link) else p
            if isinstance(x.s, A.Quoted) or isinstance(x.o, A.Quoted):
                out.append(self.quoted(A.Triple(x.s, p, x.o), graph))
            else:
                plain.append(A.Triple(x.s, p, x.o))
        return self.source.stars(plain, graph) + out if plain else out

    def quoted(self, t: A.Triple, graph: Any) -> Solutions:
        """A triple with quoted triples in it: they are taken apart and matched."""
        swaps = {}
        nodes = []
        for i, n in enumerate((t.s, t.o)):
            if isinstance(n, A.Quoted):
                swaps[f"_q{i}"] = n
                n = A.Var(f"_q{i}")
            nodes.append(n)
        sols = self.source.stars([A.Triple(nodes[0], t.p, nodes[1])], graph)[0]
        for name, q in swaps.items():
            values = dict(sols.values)
            conditions: list[Column] = [values[name].kind() == 3]
            self.take_apart(values.pop(name), q, values, conditions)
            sols = Solutions.of(sols.df.where(reduce(lambda a, b: a & b, conditions)), values, sols.maybe)
        return sols

    def take_apart(self, v: Value, q: A.Quoted, values: dict[str, Value], conditions: list[Column]) -> None:
        for part, n in zip(parts(v), (q.s, q.p, q.o)):
            if isinstance(n, A.Quoted):
                conditions.append(part.kind() == 3)
                self.take_apart(part, n, values, conditions)
            elif isinstance(n, A.Var):
                if n.name in values:
                    conditions.append(part.term() == values[n.name].term())
                else:
                    values[n.name] = part
            else:
                conditions.append(matches(part, n))

    @staticmethod
    def ordered(sols: list[Solutions], bound: set[str]) -> list[Solutions]:
        """As given, but each joined to what is there before where that can be."""
        left, out = list(sols), []
        while left:
            at = next((i for i, s in enumerate(left) if bound & set(s.values)), 0)
            out.append(left.pop(at))
            bound = bound | set(out[-1].values)
        return out

    # expressions
    def expression(self, e: Any, values: dict[str, Value]) -> Value:
        if isinstance(e, A.Const):
            return constant(e.term)
        if isinstance(e, A.Ref):
            return values.get(e.var) or constant(None)
        if isinstance(e, A.Call):
            if e.name == "bound":
                return call("bound", [self.expression(e.args[0], values)])
            args = [self.expression(a, values) for a in e.args]
            if e.name in ("+", "-", "*", "/"):
                return arithmetic(e.name, *args)
            if e.name == "&&":
                return Value("bool", args[0].ebv() & args[1].ebv())
            if e.name == "||":
                return Value("bool", args[0].ebv() | args[1].ebv())
            if e.name == "!":
                return Value("bool", ~args[0].ebv())
            if e.name == "=":
                return Value("bool", equal(*args))
            if e.name == "!=":
                return Value("bool", ~equal(*args))
            if e.name in ("<", "<="):
                return Value("bool", less(*args, strict=e.name == "<"))
            if e.name in (">", ">="):
                return Value("bool", less(args[1], args[0], strict=e.name == ">"))
            return call(e.name, args)
        if isinstance(e, A.Exists):
            raise UnsupportedError("EXISTS outside FILTER")
        raise QueryError(f"{type(e).__name__} can't be here")

