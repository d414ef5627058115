"""Tables as a virtual graph.

A row is a resource whose IRI is made of its key, a column is a predicate, a
foreign key is a link, the column's type gives the datatype; null cells make no
triple. The patterns that share a subject become one scan of its table with IS
NOT NULL filters, so k patterns cost one scan and no self-join, and what links
two resources is an equality of native keys. Each table is a named graph too.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Value, matches
from ..plans import ast as A
from ..plans.solutions import Solutions, union
from ..terms import IRI, TERM, Term
from ..vocab import RDF, XSD
from .quads import QuadSource

_TYPES = {T.StringType: ("str", ""), T.BooleanType: ("bool", ""), T.DateType: ("time", XSD.date), T.TimestampType: ("time", XSD.dateTime), T.TimestampNTZType: ("time", XSD.dateTime), T.FloatType: ("num", XSD.float), T.DoubleType: ("num", XSD.double), T.DecimalType: ("num", XSD.decimal)}
for _t in (T.ByteType, T.ShortType, T.IntegerType, T.LongType):
    _TYPES[_t] = ("num", XSD.integer)


@dataclass(frozen=True)
class TableMap:
    """key: the columns whose values make the subject's IRI; without any, subjects are blank nodes named by a hash of the row. links: column -> table whose single key it holds."""

    name: str
    key: tuple[str, ...] = ()
    links: dict[str, str] = field(default_factory=dict)
    skip: tuple[str, ...] = ()


class TableSource:
    def __init__(self, spark: SparkSession, base: str, maps: list[TableMap], tables: dict[str, DataFrame]) -> None:
        self.spark, self.base, self.tables = spark, base, tables
        self.maps = {m.name: m for m in maps if m.name in tables}
        self.columns: dict[str, tuple[str, str]] = {}
        for m in self.maps.values():
            for f in tables[m.name].schema:
                if type(f.dataType) in _TYPES and f.name not in m.skip:
                    self.columns[f"{base}{f.name}" if f.name.startswith(f"{m.name[0]}_") or f"{base}{f.name}" not in self.columns else f"{base}{m.name}_{f.name}"] = (m.name, f.name)

    def resource(self, table: str) -> str:
        """The IRI of a row is this and its key."""
        return f"{self.base}{table}/"

    def subject(self, m: TableMap) -> Value:
        if not m.key:
            # nulls are told from empty strings and cells from one another
            cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in self.tables[m.name].columns if type(self.tables[m.name].schema[c].dataType) in _TYPES]
            return Value("bnode", F.concat(F.lit(m.name[0]), F.sha2(F.concat_ws("\x1f", *cells), 256)))
        if len(m.key) == 1:
            return Value("iri", F.col(m.key[0]), "key" if not isinstance(self.tables[m.name].schema[m.key[0]].dataType, T.StringType) else "", self.resource(m.name))
        return Value("iri", F.concat_ws("/", *(F.col(c).cast("string") for c in m.key)), "", self.resource(m.name))

    def cell(self, m: TableMap, c: str) -> Value:
        kind = self.tables[m.name].schema[c].dataType
        if c in m.links and m.links[c] in self.maps:
            return Value("iri", F.col(c), "key" if not isinstance(kind, T.StringType) else "", self.resource(m.links[c]))
        return Value(_TYPES[type(kind)][0], F.col(c), _TYPES[type(kind)][1])

    def quads(self, tables: list[str] | None = None, without: set[str] | frozenset[str] = frozenset()) -> DataFrame:
        """(g, s, p, o) of every cell and of every row's type, but those of some predicates, whose columns aren't read."""
        out = []
        for name in tables or self.maps:
            m = self.maps[name]
            cells = [F.struct(F.lit(p).alias("p"), self.cell(m, c).term().alias("o")) for p, (t, c) in self.columns.items() if t == name and p not in without]
            if RDF.type not in without:
                cells.append(F.struct(F.lit(RDF.type).alias("p"), Value("iri", F.lit(f"{self.base}{name}")).term().alias("o")))
            if not cells:
                cells.append(F.struct(F.lit(RDF.type).alias("p"), F.lit(None).cast(TERM).alias("o")))
            rows = self.tables[name].select(self.subject(m).term().alias("s"), F.explode(F.array(*cells)).alias("x"))
            out.append(rows.where("x.o IS NOT NULL AND s IS NOT NULL").select(F.lit(f"{self.base}graph/{name}").alias("g"), "s", "x.p", "x.o"))
        return reduce(DataFrame.union, out)

    def materialised(self) -> QuadSource:
        return QuadSource(self.quads(), mixed_default=True)

    def dataset(self, froms: tuple[str, ...], named: tuple[str, ...]) -> Any:
        tables = {n: self.tables[n] for n in self.maps if f"{self.base}graph/{n}" in froms}
        if not named and tables:
            return TableSource(self.spark, self.base, [self.maps[n] for n in tables], tables)
        return QuadSource(self.quads(), froms, named)

    def graph_tables(self, graph: Any) -> list[str]:
        return [*self.maps] if graph is None or isinstance(graph, A.Var) else [n for n in self.maps if f"{self.base}graph/{n}" == graph]

    def triples(self, graph: Any = None) -> DataFrame:
        names = self.graph_tables(graph)
        q = self.quads(names) if names else self.spark.createDataFrame([], f"g string, s {TERM}, p string, o {TERM}")
        return q.select("s", "p", "o", *(["g"] if isinstance(graph, A.Var) else []))

    def around(self, terms: list[Term]) -> DataFrame:
        """The triples that a description of these resources needs. No cell is a blank node, so their own tables have all of it."""
        names = [n for n in self.maps if any(t.lex.startswith(self.resource(n)) for t in terms)]
        return self.quads(names or [*self.maps][:1]).select("s", "p", "o").where(F.col("s.lex").isin([t.lex for t in terms]))

    def of_resources(self, v: Value) -> list[str]:
        """The tables that can hold the resources of a value."""
        if v.form != "iri" or not v.prefix:
            return [*self.maps]
        return [n for n in self.maps if v.prefix.startswith(self.resource(n))]

    def table_of(self, t: A.Triple) -> str | None:
        """The table whose rows alone can match; None if several can."""
        if isinstance(t.p, Term) and t.p.lex in self.columns:
            return self.columns[t.p.lex][0]
        if isinstance(t.p, Term) and t.p.lex == RDF.type and isinstance(t.o, Term):
            return t.o.lex.removeprefix(self.base) if t.o.lex.removeprefix(self.base) in self.maps else ""
        return "" if isinstance(t.p, Term) and t.p.lex != RDF.type else None

    def stars(self, patterns: list[A.Triple], graph: Any = None) -> list[Solutions]:
        """One scan for each subject and table; patterns that no single table has are matched against all cells."""
        groups: dict[tuple[Any, str], list[A.Triple]] = {}
        out = []
        for t in patterns:
            name = self.table_of(t)
            if name is None and isinstance(t.p, Term):  # a type that isn't known: each table has its own
                typed = [self.star(t.s, n, [t], graph) for n in self.graph_tables(graph)]
                out.append(union(typed) if typed else self.anywhere(t, graph))
            elif name is None:
                out.append(self.anywhere(t, graph))
            else:
                groups.setdefault((t.s, name), []).append(t)
        return [self.star(s, name, ts, graph) for (s, name), ts in groups.items()] + out

    def anywhere(self, t: A.Triple, graph: Any) -> Solutions:
        if isinstance(t.s, Term) and t.s.kind == IRI:  # the subject's IRI names its table
            own = [n for n in self.graph_tables(graph) if t.s.lex.startswith(self.resource(n))]
            if own and not isinstance(graph, A.Var):
                graph = f"{self.base}graph/{own[0]}"
        names = self.graph_tables(graph)
        cells = self.quads(names) if names else self.quads([*self.maps][:1]).where(F.lit(False))
        if isinstance(graph, A.Var):
            return QuadSource(cells).pattern(t, graph)
        return QuadSource(cells, mixed_default=True).pattern(t)

    def star(self, s: Any, name: str, patterns: list[A.Triple], graph: Any) -> Solutions:
        values: dict[str, Value] = {}
        conditions = []

        def bind(node: Any, v: Value) -> None:
            if isinstance(node, Term):
                conditions.append(matches(v, node))
            elif node.name in values:
                other = values[node.name]
                conditions.append(other.col == v.col if other.like(v) else other.term() == v.term())
            else:
                values[node.name] = v
                if v.form != "bnode":  # made of the row, never null: testing it would read and hash all its columns
                    conditions.append(v.col.isNotNull())

        known = name if name in self.graph_tables(graph) else None
        m = self.maps[known or [*self.maps][0]]
        if known is None:  # nothing has this predicate: no rows, with the variables it names
            for t in patterns:
                for n in (s, t.o):
                    if isinstance(n, A.Var):
                        values.setdefault(n.name, Value("term", F.lit(None).cast(TERM)))
            conditions.append(F.lit(False))
        else:
            bind(s, self.subject(m))
            for t in patterns:
                bind(t.o, Value("iri", F.lit(f"{self.base}{name}")) if t.p.lex == RDF.type else self.cell(m, self.columns[t.p.lex][1]))
        if isinstance(graph, A.Var):
            values[graph.name] = Value("iri", F.lit(f"{self.base}graph/{name}"))
        return Solutions.of(self.tables[m.name].where(reduce(lambda a, b: a & b, conditions, F.lit(True))), values)


BASE = "http://tables.example/"
#: The benchmark tables.
MAPS = [
    TableMap("region", ("r_regionkey",)), TableMap("nation", ("n_nationkey",), {"n_regionkey": "region"}),
    TableMap("customer", ("c_custkey",), {"c_nationkey": "nation"}), TableMap("supplier", ("s_suppkey",), {"s_nationkey": "nation"}),
    TableMap("part", ("p_partkey",)), TableMap("orders", ("o_orderkey",), {"o_custkey": "customer"}),
    TableMap("lineitem", (), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}), TableMap("events", ("event_id",)),
    TableMap("conversations", ("conv_id", "turn")), TableMap("documents", ("doc_id",)), TableMap("pages", ("page_id",)), TableMap("benchmark", ("item_id",)),
    TableMap("labels", ("doc_id",), {"doc_id": "documents"}), TableMap("embeddings", ("vec_id",)),
]


def benchmark_tables(spark: SparkSession, sf_dir: str) -> TableSource:
    return TableSource(spark, BASE, MAPS, {m.name: spark.read.parquet(f"{sf_dir}/{m.name}.parquet") for m in MAPS})
