"""More registered queries: query forms, terms, updates, formats, whole-graph operators, shapes of all kinds and measures, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import Repository
from .errors import GraphError
from .functions import builtins
from .functions.values import Value
from .operators import graph, metrics
from .operators.authoring import GraphBuilder
from .operators.paths import closed_from
from .operators.reasoning import Reasoning, reason
from .plans.engine import Engine
from .queries import _P, _SHAPES, _triples, engine, operator, query
from .shacl.dataquality import DataQuality
from .shacl.rules import check
from .shacl.validate import Validator, as_triples, compiled, digest, report
from .shared import once, settled, shared_folder
from .sources.quads import QuadSource
from .sources.relational import BASE, benchmark_tables
from .sources.turtle import format_of, parse, quads, read, write
from .streaming.ingest import append, read_stream
from .terms import BNODE, IRI, LITERAL, bnode, iri, make
from .vocab import OWL, RDF, RDFS, SKOS, XSD, resolve

_C, _O, _N, _S = (f"'{BASE}{t}/' || {k}" for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey")))

# forms
query("select_star", "SELECT * WHERE { ?s :s_name ?n ; :s_acctbal ?b FILTER(?b > 5000) }", f"SELECT {_S} AS s, s_name AS n, s_acctbal AS b FROM supplier WHERE s_acctbal > 5000")
query("reduced_priorities", "SELECT REDUCED ?p WHERE { ?o :o_orderpriority ?p }", "SELECT o_orderpriority AS p FROM orders")  # REDUCED may leave repeats: it costs nothing here
query("from_named", f"SELECT ?g (COUNT(*) AS ?n) FROM NAMED <{BASE}graph/orders> FROM NAMED <{BASE}graph/customer> WHERE {{ GRAPH ?g {{ ?s a ?t }} }} GROUP BY ?g", f"SELECT '{BASE}graph/orders' AS g, count(*) AS n FROM orders UNION ALL SELECT '{BASE}graph/customer', count(*) FROM customer")
query("bound_filter", "SELECT ?n WHERE { ?c :c_name ?n OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > 250000) } FILTER(!BOUND(?o)) }", "SELECT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
query("blank_subjects", "SELECT ?blank (COUNT(*) AS ?n) WHERE { ?l :l_quantity ?q } GROUP BY (isBLANK(?l) AS ?blank)", "SELECT true AS blank, count(*) AS n FROM lineitem")
query("minus_of_unbound", "SELECT ?n ?o WHERE { ?c :c_name ?n OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > 300000) } MINUS { ?o :o_orderstatus 'F' } }", f"SELECT c_name AS n, {_O} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL OR o_orderstatus <> 'F'")
query("group_concat_distinct", "SELECT ?s (GROUP_CONCAT(DISTINCT ?p ; SEPARATOR='|') AS ?all) WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p } GROUP BY ?s", "SELECT o_orderstatus AS s, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS \"all\" FROM orders GROUP BY o_orderstatus")
query("sum_avg_distinct", "SELECT ?s (SUM(DISTINCT ?k) AS ?total) (AVG(DISTINCT ?k) AS ?mean) (COUNT(DISTINCT *) AS ?n) WHERE { ?c :c_mktsegment ?s ; :c_nationkey ?x . ?x :n_nationkey ?k } GROUP BY ?s", "SELECT c_mktsegment AS s, CAST(sum(DISTINCT c_nationkey) AS BIGINT) AS total, round(avg(DISTINCT c_nationkey), 6) AS mean, count(*) AS n FROM customer GROUP BY c_mktsegment", mean=6)
# terms
query(
    "triple_terms",
    f"SELECT ?n (isTRIPLE(?t) AS ?is) (STR(SUBJECT(?t)) AS ?s) (STR(PREDICATE(?t)) AS ?p) (STR(OBJECT(?t)) AS ?o) WHERE {{ ?x :s_name ?n BIND(TRIPLE(?x, <{BASE}s_name>, ?n) AS ?t) }}",
    f"SELECT s_name AS n, true AS \"is\", {_S} AS s, '{BASE}s_name' AS p, s_name AS o FROM supplier",
)
query(
    "directed_strings",
    "SELECT ?n (LANG(?d) AS ?l) (LANGDIR(?d) AS ?w) (hasLANG(?d, 'AR') AS ?a) (hasLANG(?d, 'en') AS ?b) (hasLANGDIR(?d, 'rtl') AS ?c) (hasLANGDIR(?n) AS ?e) (LANG(STRLANG(?n, 'fr')) AS ?f) WHERE { ?x :c_name ?n BIND(STRLANGDIR(?n, 'ar', 'rtl') AS ?d) }",
    "SELECT c_name AS n, 'ar' AS l, 'rtl' AS w, true AS a, false AS b, true AS c, false AS e, 'fr' AS f FROM customer",
)
query("replace_all_decode", "SELECT ?n (REPLACE_ALL(?n, '[0-9]+', '#') AS ?r) (replaceAll(?n, 'u', '(u)') AS ?q) (DECODE_FOR_URI(ENCODE_FOR_URI(CONCAT(?n, ' +%/é'))) AS ?d) WHERE { ?x :c_name ?n }", "SELECT c_name AS n, regexp_replace(c_name, '[0-9]+', '#', 'g') AS r, replace(c_name, 'u', '(u)') AS q, c_name || ' +%/é' AS d FROM customer")
query("random_and_now", "SELECT (COUNT(*) AS ?n) WHERE { ?o :o_orderstatus ?s BIND(RAND() AS ?r) BIND(RANDOM() AS ?i) FILTER(?r >= 0 && ?r < 1 && ?i >= 0 && NOW() > '2020-01-01T00:00:00Z'^^xsd:dateTime) }", "SELECT count(*) AS n FROM orders")
query(
    "date_and_time_parts",
    """SELECT ?k (STR(DATE(?t)) AS ?d) (STR(TIME(?t)) AS ?c) (STR(DATETIME(DATE(?t), '10:20:30'^^xsd:time)) AS ?dt) (TZ(?z) AS ?tz) (STR(TIMEZONE(?z)) AS ?zone) (HOURS(?z) AS ?h) (MINUTES(?z) AS ?mi)
    WHERE { ?o :o_orderdate ?t ; :o_orderpriority ?k BIND(STRDT(CONCAT(STR(DATE(?t)), 'T07:45:00+02:30'), xsd:dateTime) AS ?z) }""",
    "SELECT o_orderpriority AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, '00:00:00' AS c, strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30' AS dt, '+02:30' AS tz, 'PT2H30M' AS zone, CAST(5 AS BIGINT) AS h, CAST(15 AS BIGINT) AS mi FROM orders",
)


@operator("registered_function", "SELECT s_name AS n, round(s_acctbal * 2, 6) AS d FROM supplier")
def _function(spark: SparkSession, d: str) -> DataFrame:
    builtins.register(f"{BASE}twice", lambda v: Value("num", v.num() * 2, XSD.double), "twice a number")
    return engine(spark, d).select(_P + "SELECT ?n (:twice(?b) AS ?d) WHERE { ?s :s_name ?n ; :s_acctbal ?b }").withColumn("d", F.round("d", 6))


@operator("registered_aggregate", "SELECT c_mktsegment AS s, round(stddev_pop(c_acctbal), 4) AS spread, CAST(sum(c_nationkey % 5) AS BIGINT) AS rest FROM customer GROUP BY c_mktsegment")
def _aggregate(spark: SparkSession, d: str) -> DataFrame:
    builtins.register_aggregate(f"{BASE}spread", lambda v: Value("num", F.stddev_pop(v.num()), XSD.double), "the standard deviation")
    builtins.register_aggregate(f"{BASE}restSum", lambda v: Value("num", F.sum(F.pmod(v.num().cast("bigint"), F.lit(5))), XSD.integer), "the sum of what five leaves")
    got = engine(spark, d).select(_P + "SELECT ?s (:spread(?b) AS ?spread) (:restSum(?k) AS ?rest) WHERE { ?c :c_mktsegment ?s ; :c_acctbal ?b ; :c_nationkey ?x . ?x :n_nationkey ?k } GROUP BY ?s")
    return got.withColumn("spread", F.round("spread", 4))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Who states that a customer is of a nation: a reifier with a year for each."""
    return engine(spark, d).run(
        _P + f"""CONSTRUCT {{ ?r rdf:reifies ?t . ?r :since ?k . ?x :c_nationkey ?n }} WHERE {{ ?x :c_nationkey ?n ; :c_custkey ?k BIND(TRIPLE(?x, <{BASE}c_nationkey>, ?n) AS ?t) BIND(IRI(CONCAT('{BASE}claim/', STR(?k))) AS ?r) }}"""
    )


for _name, _pattern in (
    ("triple_term_pattern", "?r rdf:reifies <<( ?x :c_nationkey ?n )>> . ?r :since ?k"), ("reifier_pattern", "<< ?x :c_nationkey ?n ~ ?r >> :since ?k"), ("legacy_quoted_triple", "?r rdf:reifies <<( ?x ?p ?n )>> . << ?x :c_nationkey ?n >> :since ?k"),
):

    def _quoted(spark: SparkSession, d: str, pattern: str = _pattern) -> DataFrame:
        return Engine(spark, QuadSource.of_triples(_claims(spark, d))).select(_P + f"SELECT ?x ?n ?k WHERE {{ {pattern} }}").withColumn("k", F.col("k").cast("bigint"))

    operator(_name, f"SELECT {_C} AS x, '{BASE}nation/' || c_nationkey AS n, CAST(c_custkey AS BIGINT) AS k FROM customer")(_quoted)


@operator("reifiers", f"SELECT '{BASE}claim/' || c_custkey AS reifier, '<<( <' || {_C} || '> <{BASE}c_nationkey> <{BASE}nation/' || c_nationkey || '> )>>' AS triple FROM customer")
def _reifiers(spark: SparkSession, d: str) -> DataFrame:
    return graph.reifiers(_claims(spark, d)).select(F.col("reifier.lex").alias("reifier"), F.col("triple.lex").alias("triple"))


@operator("reifiers_of_a_claim", f"SELECT '{BASE}claim/' || c_custkey AS reifier FROM customer WHERE c_nationkey = 7")
def _claim(spark: SparkSession, d: str) -> DataFrame:
    return graph.reifiers(settled(_claims(spark, d), "claims"), o=iri(f"{BASE}nation/7")).select(F.col("reifier.lex").alias("reifier"))


@operator("path_zero_or_more", "WITH t AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT DISTINCT conv_id, turn FROM conversations)), r AS (SELECT conv_id, run, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 1) SELECT CAST(sum(n * (n + 1) / 2) AS BIGINT) AS pairs FROM r")
def _stars(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn").distinct()
    turn = lambda n: make(IRI, F.concat(F.lit(f"{BASE}turn/"), F.col("conv_id").cast("string"), F.lit("/"), n.cast("string")))
    links = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).select(turn(F.col("turn")).alias("s"), F.lit(f"{BASE}next").alias("p"), turn(F.col("turn") + 1).alias("o"))
    return Engine(spark, QuadSource.of_triples(links)).select(_P + "SELECT ?a ?b WHERE { ?a :next* ?b }").agg(F.count(F.lit(1)).alias("pairs"))


# updates: (graph or '', subject, object) of what is left
def update(name: str, requests: str, sql: str) -> None:
    """Over the nation keys of customers in the default graph and those of suppliers in g:s."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        own = lambda t, p, g: _triples(spark, d, t).where(F.col("p") == f"{BASE}{p}").select(F.lit(g).cast("string").alias("g"), "s", "p", "o")
        repo = Repository(spark, own("customer", "c_nationkey", None).unionByName(own("supplier", "s_nationkey", f"{BASE}graph/s")))
        repo.update(_P + requests)
        return repo.quads.select(F.coalesce("g", F.lit("")).alias("g"), F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))

    operator(name, f"WITH c AS (SELECT '' AS g, {_C} AS s, '{BASE}nation/' || c_nationkey AS o FROM customer), s AS (SELECT '{BASE}graph/s' AS g, {_S} AS s, '{BASE}nation/' || s_nationkey AS o FROM supplier) {sql}")(run)


_ALL = "SELECT * FROM c UNION ALL SELECT * FROM s"
_G = f"'{BASE}graph/"
update("update_insert_data", "INSERT DATA { :x :p :y GRAPH g:s { :x :p 1 } GRAPH g:t { :x :p 'z' } }", f"{_ALL} UNION ALL SELECT '', '{BASE}x', '{BASE}y' UNION ALL SELECT {_G}s', '{BASE}x', '1' UNION ALL SELECT {_G}t', '{BASE}x', 'z'")
update("update_delete_data", f"DELETE DATA {{ GRAPH g:s {{ <{BASE}supplier/1> :s_nationkey <{BASE}nation/0> , <{BASE}nation/1> , <{BASE}nation/2> , <{BASE}nation/3> , <{BASE}nation/4> , <{BASE}nation/5> , <{BASE}nation/6> , <{BASE}nation/7> , <{BASE}nation/8> , <{BASE}nation/9> , <{BASE}nation/10> , <{BASE}nation/11> , <{BASE}nation/12> , <{BASE}nation/13> , <{BASE}nation/14> , <{BASE}nation/15> , <{BASE}nation/16> , <{BASE}nation/17> , <{BASE}nation/18> , <{BASE}nation/19> , <{BASE}nation/20> , <{BASE}nation/21> , <{BASE}nation/22> , <{BASE}nation/23> , <{BASE}nation/24> }} }}", f"SELECT * FROM c UNION ALL SELECT * FROM s WHERE s <> '{BASE}supplier/1'")
update("update_delete_where", f"DELETE WHERE {{ ?c :c_nationkey <{BASE}nation/3> }}", f"SELECT * FROM c WHERE o <> '{BASE}nation/3' UNION ALL SELECT * FROM s")
update("update_with", f"WITH g:s DELETE {{ ?s :s_nationkey ?n }} INSERT {{ ?s :of ?n }} WHERE {{ ?s :s_nationkey ?n FILTER(?n = <{BASE}nation/4>) }}", _ALL)
update("update_using", f"INSERT {{ GRAPH g:u {{ ?s :of ?n }} }} USING g:s WHERE {{ ?s :s_nationkey ?n }}", f"{_ALL} UNION ALL SELECT {_G}u', s, o FROM s")
update("update_using_named", f"INSERT {{ GRAPH g:u {{ ?s :of ?n }} }} USING NAMED g:s WHERE {{ GRAPH ?g {{ ?s :s_nationkey ?n }} }}", f"{_ALL} UNION ALL SELECT {_G}u', s, o FROM s")
update("update_clear", "CLEAR GRAPH g:s", "SELECT * FROM c")
update("update_clear_default", "CLEAR DEFAULT ; CLEAR SILENT GRAPH g:none", "SELECT * FROM s")
update("update_create_drop", "CREATE GRAPH g:new ; INSERT DATA { GRAPH g:new { :a :b :c } } ; DROP GRAPH g:s", f"SELECT * FROM c UNION ALL SELECT {_G}new', '{BASE}a', '{BASE}c'")
update("update_copy", "COPY GRAPH g:s TO GRAPH g:t ; COPY DEFAULT TO g:s", f"SELECT * FROM c UNION ALL SELECT {_G}t', s, o FROM s UNION ALL SELECT {_G}s', s, o FROM c")
update("update_move", "MOVE GRAPH g:s TO GRAPH g:t", f"SELECT * FROM c UNION ALL SELECT {_G}t', s, o FROM s")
update("update_add", "ADD GRAPH g:s TO DEFAULT", f"{_ALL} UNION ALL SELECT '', s, o FROM s")
update("update_sequence", "INSERT { ?c :seen ?n } WHERE { ?c :c_nationkey ?n } ; DELETE { ?c :c_nationkey ?n } WHERE { ?c :seen ?n } ; DELETE DATA { :nothing :is :here }", _ALL)


@operator("update_load", f"SELECT '{BASE}graph/loaded' AS g, {_C} AS s, c_name AS o FROM customer UNION ALL SELECT '', {_C}, c_name FROM customer")
def _load(spark: SparkSession, d: str) -> DataFrame:
    at = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}.nt"
    write(_triples(spark, d, "customer").where(F.col("p") == f"{BASE}c_name"), at)
    repo = Repository(spark)
    repo.update(_P + f"LOAD <{at}> ; LOAD <{at}> INTO GRAPH g:loaded ; LOAD SILENT <{at}.none>")
    return repo.quads.select(F.coalesce("g", F.lit("")).alias("g"), F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


@operator("failed_request_leaves_all", f"SELECT {_C} AS s FROM customer")
def _rollback(spark: SparkSession, d: str) -> DataFrame:
    repo = Repository(spark, _triples(spark, d, "customer").where(F.col("p") == RDF.type).withColumn("g", F.lit(None).cast("string")).select("g", "s", "p", "o"))
    try:
        repo.update(_P + "DELETE WHERE { ?c a :customer } ; DROP GRAPH g:none")
    except GraphError:
        return repo.quads.select(F.col("s.lex").alias("s"))
    raise AssertionError("the second operation must fail")


@operator("repository_statistics", f"SELECT '' AS g, count(*) AS triples, count(*) AS subjects, CAST(1 AS BIGINT) AS predicates FROM customer UNION ALL SELECT '{BASE}graph/o', 2 * count(*), count(*), 2 FROM orders")
def _statistics(spark: SparkSession, d: str) -> DataFrame:
    repo = Repository(spark)
    repo.add(_triples(spark, d, "customer").where(F.col("p") == RDF.type).select(F.lit(None).cast("string").alias("g"), "s", "p", "o"))
    orders = _triples(spark, d, "orders").select(F.lit(f"{BASE}graph/o").alias("g"), "s", "p", "o")
    repo.add(orders.where(F.col("p").isin(RDF.type, f"{BASE}o_custkey", f"{BASE}o_orderstatus")))
    repo.remove(orders.where(F.col("p") == f"{BASE}o_orderstatus"))
    return repo.statistics().withColumn("g", F.coalesce("g", F.lit("")))


@operator("has_triple", f"SELECT 'there' AS which, true AS answer UNION ALL SELECT 'not there', false")
def _lookup(spark: SparkSession, d: str) -> DataFrame:
    q = benchmark_tables(spark, d).quads(["customer", "nation", "orders"]).withColumn("g", F.lit(None).cast("string"))
    repo = Repository(spark, q)
    rows = [(w, repo.has_triple(iri(f"{BASE}customer/1"), RDF.type, iri(f"{BASE}{t}"))) for w, t in (("there", "customer"), ("not there", "orders"))]
    return spark.createDataFrame(rows, "which string, answer boolean")


@operator("versioned_store", f"SELECT CAST(0 AS BIGINT) AS version, count(*) AS n FROM customer UNION ALL SELECT 1, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) UNION ALL SELECT 2, (SELECT count(*) FROM orders)")
def _versions(spark: SparkSession, d: str) -> DataFrame:
    from .store import QuadStore

    store = QuadStore(spark, f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    named = lambda t, p: _triples(spark, d, t).where(F.col("p") == f"{BASE}{p}").select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
    store.commit(named("customer", "c_name"))
    store.commit(store.quads().unionByName(named("orders", "o_orderstatus")))
    repo = store.repository()
    repo.update(_P + "DELETE WHERE { ?c :c_name ?n }")
    store.save(repo)
    return reduce(DataFrame.unionByName, [store.quads(v).agg(F.lit(v).cast("bigint").alias("version"), F.count(F.lit(1)).alias("n")) for v in store.versions()])


# formats
def _names(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d, "customer").where(F.col("p").isin(f"{BASE}c_name", f"{BASE}c_acctbal", f"{BASE}c_nationkey"))


_NAMES_SQL = f"SELECT {_C} AS s, '{BASE}c_name' AS p, c_name AS o FROM customer UNION ALL SELECT {_C}, '{BASE}c_nationkey', '{BASE}nation/' || c_nationkey FROM customer"


def _flat(q: DataFrame) -> DataFrame:
    return q.where(F.col("p") != f"{BASE}c_acctbal").select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


for _fmt in ("turtle", "trig", "json-ld", "rdf-xml"):

    def _round_trip(spark: SparkSession, d: str, fmt: str = _fmt) -> DataFrame:
        at = f"{shared_folder(spark).rstrip('/')}/{fmt}-{uuid.uuid4().hex}"
        t = _names(spark, d)
        write(t.withColumn("g", F.lit(f"{BASE}graph/c")) if fmt == "trig" else t, at, fmt, {"x": BASE} if fmt == "turtle" else None)
        return _flat(read(spark, at, fmt, parts=True))

    operator(f"format_{_fmt.replace('-', '_')}", _NAMES_SQL)(_round_trip)


@operator("format_n_quads", f"SELECT g || '' AS g, s, p, o FROM (SELECT '{BASE}graph/c' AS g, * FROM ({_NAMES_SQL}))")
def _n_quads(spark: SparkSession, d: str) -> DataFrame:
    at = f"{shared_folder(spark).rstrip('/')}/quads-{uuid.uuid4().hex}"
    write(_names(spark, d).withColumn("g", F.lit(f"{BASE}graph/c")), at)
    back = read(spark, at, "n-quads").where(F.col("p") != f"{BASE}c_acctbal")
    return back.select("g", F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


@operator("stream_of_statements", _NAMES_SQL)
def _stream(spark: SparkSession, d: str) -> DataFrame:
    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    write(_names(spark, d), f"{at}/in")
    append(read_stream(spark, f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return _flat(spark.read.parquet(f"{at}/out"))


@operator("parse_with_base", f"SELECT '{BASE}nation/' || i AS s, '{BASE}part/of' AS p, CAST(i AS VARCHAR) AS o, 'turtle' AS fmt FROM range(3) t(i)")
def _base(spark: SparkSession, d: str) -> DataFrame:
    text = " ".join(f"<nation/{i}> <part/of> {i} ." for i in range(3))
    got = quads(spark, parse(text, "turtle", BASE))
    return got.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"), F.lit(format_of("a/b.TTL")).alias("fmt"))


@operator("resolved_names", f"SELECT '{RDF.type}' AS a, '{SKOS.broader}' AS b, 'urn:x:y' AS c")
def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(resolve("rdf:type"), resolve("skos:broader"), resolve("urn:x:y"))], "a string, b string, c string")


# whole graphs
@operator("graph_union", "SELECT (SELECT count(*) FROM customer) * 6 + (SELECT count(*) FROM supplier) AS n")
def _union(spark: SparkSession, d: str) -> DataFrame:
    c, s = _triples(spark, d, "customer"), _triples(spark, d, "supplier").where(F.col("p") == RDF.type)
    return graph.union_graphs(c, c.where(F.col("p") == RDF.type), s, c).agg(F.count(F.lit(1)).alias("n"))


@operator("graph_isomorphism", "SELECT true AS same, false AS other, count(*) AS n FROM customer")
def _isomorphic(spark: SparkSession, d: str) -> DataFrame:
    """Customers as blank nodes, once under other labels and once with two names exchanged."""
    t = _triples(spark, d, "customer").where(F.col("p").isin(f"{BASE}c_name", f"{BASE}c_mktsegment"))
    blank = lambda tag: t.select(make(BNODE, F.concat(F.lit(tag), F.xxhash64(F.lit(tag), "s.lex").cast("string"))).alias("s"), "p", "o")
    a, b = settled(blank("a"), "a"), settled(blank("b"), "b")
    changed = b.withColumn("o", F.when(F.col("o.lex") == "BUILDING", make(LITERAL, F.lit("MACHINERY"), XSD.string)).otherwise(F.col("o")))
    rows = [(graph.isomorphic(a, b), graph.isomorphic(a, changed), a.select("s").distinct().count())]
    return spark.createDataFrame(rows, "same boolean, other boolean, n bigint")


@operator("exact_isomorphism", "SELECT false AS circles, true AS turned")
def _circles(spark: SparkSession, d: str) -> DataFrame:
    """A circle of six blank nodes against two of three: no colour tells them apart. And against itself, turned."""
    ring = lambda ends: quads(spark, [(None, bnode(f"n{a}"), f"{BASE}next", bnode(f"n{b}")) for a, b in ends]).select("s", "p", "o")
    six = ring([(i, (i + 1) % 6) for i in range(6)])
    three = ring([(i, (i + 1) % 3) for i in range(3)] + [(3 + i, 3 + (i + 1) % 3) for i in range(3)])
    turned = ring([((5 * i + 2) % 6, (5 * (i + 1) + 2) % 6) for i in range(6)])
    return spark.createDataFrame([(graph.isomorphic(six, three), graph.isomorphic(six, turned))], "circles boolean, turned boolean")


def _tree(spark: SparkSession, d: str, p: str = RDFS.subClassOf, cls: str = OWL.Class) -> DataFrame:
    """Customers and suppliers below their nations, nations below their regions, all of them classes."""
    t = benchmark_tables(spark, d).quads(["customer", "supplier", "nation"]).where(F.col("p").isin(f"{BASE}c_nationkey", f"{BASE}s_nationkey", f"{BASE}n_regionkey"))
    up = t.select("s", F.lit(p).alias("p"), "o")
    every = up.select("s").union(up.select("o")).distinct()
    return settled(up.union(every.select("s", F.lit(RDF.type).alias("p"), make(IRI, F.lit(cls)).alias("o"))), "tree")


_TREE = f"""WITH e AS (SELECT {_C} AS child, '{BASE}nation/' || c_nationkey AS parent FROM customer UNION ALL SELECT {_S}, '{BASE}nation/' || s_nationkey FROM supplier UNION ALL SELECT {_N}, '{BASE}region/' || n_regionkey FROM nation),
k AS (SELECT child AS c FROM e UNION SELECT parent FROM e),
d AS (SELECT c, CASE WHEN c LIKE '%/region/%' THEN 0 WHEN c LIKE '%/nation/%' THEN 1 ELSE 2 END AS depth, c NOT IN (SELECT parent FROM e) AS leaf, (SELECT count(*) FROM e WHERE parent = c) AS children FROM k)"""
_UP = f"{_TREE} SELECT a.child AS s, b.parent AS o FROM e a JOIN e b ON a.parent = b.child"


@operator("rdfs_subclass_transitivity", _UP)
def _subclasses(spark: SparkSession, d: str) -> DataFrame:
    return graph.infer(_tree(spark, d)).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


@operator("rdfs_subproperty_transitivity", _UP)
def _subproperties(spark: SparkSession, d: str) -> DataFrame:
    return graph.infer(_tree(spark, d, RDFS.subPropertyOf, RDF.Property)).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


@operator("rdfs_fixpoint", f"{_TREE}, r AS (SELECT n.parent AS region, c.parent AS nation, c.child FROM e c JOIN e n ON c.parent = n.child) SELECT o_orderkey AS k, count(*) AS types FROM orders JOIN (SELECT child FROM r UNION ALL SELECT child FROM r) ON child = '{BASE}customer/' || o_custkey GROUP BY o_orderkey")
def _fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Orders typed by their customer are handed up to nation and region."""
    orders = _triples(spark, d, "orders").where(F.col("p") == f"{BASE}o_custkey").select("s", F.lit(RDF.type).alias("p"), "o")
    found = graph.infer(orders.union(_tree(spark, d).where(F.col("p") == RDFS.subClassOf)), "fixpoint").where((F.col("p") == RDF.type) & F.contains(F.col("s.lex"), F.lit("/orders/")))
    return found.groupBy(F.element_at(F.split("s.lex", "/"), -1).cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("types"))


@operator("owl_rules", f"SELECT '{BASE}inverse' AS p, count(*) AS n FROM orders UNION ALL SELECT '{BASE}near', count(*) FROM nation UNION ALL SELECT '{OWL.sameAs}', 2 * count(*) FROM region")
def _owl_rules(spark: SparkSession, d: str) -> DataFrame:
    t = benchmark_tables(spark, d).quads(["orders", "nation", "region"]).select("s", "p", "o")
    data = t.where(F.col("p") == f"{BASE}o_custkey").union(t.where(F.col("p") == f"{BASE}n_regionkey").select("s", F.lit(f"{BASE}near").alias("p"), "o"))
    same = t.where((F.col("p") == RDF.type) & (F.col("o.lex") == f"{BASE}region")).select("s", F.lit(OWL.sameAs).alias("p"), make(IRI, F.concat(F.lit("urn:r:"), F.element_at(F.split("s.lex", "/"), -1))).alias("o"))
    rules = quads(spark, parse(f"@prefix owl: <http://www.w3.org/2002/07/owl#> . <{BASE}inverse> owl:inverseOf <{BASE}o_custkey> . <{BASE}near> a owl:SymmetricProperty .")).select("s", "p", "o")
    got = graph.infer(data.union(same).union(rules), "fixpoint", owl=True)
    got = got.where(F.col("p").isin(f"{BASE}inverse", f"{BASE}near", OWL.sameAs) & ~(F.startswith(F.col("s.lex"), F.lit("urn:")) & F.col("p").isin(f"{BASE}near")) & ~F.startswith(F.col("o.lex"), F.lit("urn:")) | (F.col("p") == OWL.sameAs))
    kept = got.where((F.col("p") != OWL.sameAs) | (F.col("s.lex") != F.col("o.lex")) | F.startswith(F.col("s.lex"), F.lit(BASE)))
    return kept.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@operator("reasoning_by_rules", f"SELECT 'inverse' AS what, count(*) AS n FROM orders UNION ALL SELECT 'rich', count(*) FROM customer WHERE c_acctbal > 9000")
def _reasoned(spark: SparkSession, d: str) -> DataFrame:
    t = benchmark_tables(spark, d).quads(["orders", "customer"]).where(F.col("p").isin(f"{BASE}o_custkey", f"{BASE}c_acctbal")).select("s", "p", "o")
    rules = quads(spark, parse(f"<{BASE}placed> <{OWL.inverseOf}> <{BASE}o_custkey> .")).select("s", "p", "o")
    how = Reasoning(frozenset({"owl_inverse_of"}), (_P + "CONSTRUCT { ?c a :Rich } WHERE { ?c :c_acctbal ?b FILTER(?b > 9000) }",))
    got = reason(t.union(rules), how)
    return got.select(F.when(F.col("p") == f"{BASE}placed", "inverse").otherwise("rich").alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@operator("classification", f"{_TREE} SELECT child AS node, string_agg(parent, ' ') AS targets FROM e GROUP BY child")
def _classes(spark: SparkSession, d: str) -> DataFrame:
    return graph.classification(_tree(spark, d)).withColumn("targets", F.array_join("targets", " "))


@operator("inconsistencies", f"SELECT {_C} AS node FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
def _inconsistent(spark: SparkSession, d: str) -> DataFrame:
    made = engine(spark, d).run(_P + "CONSTRUCT { ?c a ?k } WHERE { { ?c :c_mktsegment ?s BIND(IRI(CONCAT('urn:', ?s)) AS ?k) } UNION { ?c :c_acctbal ?b FILTER(?b < 0) BIND(IRI('urn:debt') AS ?k) } }")
    rules = quads(spark, parse("@prefix owl: <http://www.w3.org/2002/07/owl#> . <urn:BUILDING> owl:disjointWith <urn:debt> .")).select("s", "p", "o")
    return graph.inconsistencies(made.union(rules)).select(F.col("node.lex").alias("node"))


@operator("rdf_lists", "SELECT conv_id AS k, count(*) AS n, min(turn) AS first FROM conversations GROUP BY conv_id")
def _lists(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation as a list."""
    t = spark.read.parquet(f"{d}/conversations.parquet").selectExpr("conv_id", "turn", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i", "count(*) OVER (PARTITION BY conv_id) AS n")
    cell = lambda i: make(BNODE, F.concat_ws("x", F.lit("l"), F.col("conv_id").cast("string"), i.cast("string")))
    firsts = t.select(cell(F.col("i")).alias("s"), F.lit(RDF.first).alias("p"), make(LITERAL, F.col("turn").cast("string"), XSD.integer).alias("o"))
    rests = t.select(cell(F.col("i")).alias("s"), F.lit(RDF.rest).alias("p"), F.when(F.col("i") == F.col("n"), make(IRI, F.lit(RDF.nil))).otherwise(cell(F.col("i") + 1)).alias("o"))
    heads = t.where("i = 1").select(cell(F.col("i")).alias("head"))
    got = graph.lists(settled(firsts.union(rests), "cells"), heads)
    return got.select(F.split("head.lex", "x")[1].cast("bigint").alias("k"), F.size("items").cast("bigint").alias("n"), F.get("items", F.lit(0))["lex"].cast("bigint").alias("first"))


@operator("superclass_cone", f"SELECT '{BASE}nation/' || c_nationkey AS above FROM customer WHERE c_custkey = 5 UNION ALL SELECT '{BASE}region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5")
def _cone(spark: SparkSession, d: str) -> DataFrame:
    edges = _tree(spark, d).where(F.col("p") == RDFS.subClassOf).select(F.col("s.lex").alias("x"), F.col("o.lex").alias("y"))
    return closed_from(edges, edges.where(F.col("x") == f"{BASE}customer/5")).select(F.col("y").alias("above"))


@operator("instances_below", f"SELECT {_O} AS node FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def _instances(spark: SparkSession, d: str) -> DataFrame:
    orders = _triples(spark, d, "orders").where(F.col("p") == f"{BASE}o_custkey").select("s", F.lit(RDF.type).alias("p"), "o")
    return graph.instances(orders.union(_tree(spark, d).where(F.col("p") == RDFS.subClassOf)), f"{BASE}region/2").select(F.col("node.lex").alias("node"))


@operator("property_bag", "SELECT o_custkey AS k, count(*) AS n, CAST(0 AS BIGINT) AS n_literals FROM orders GROUP BY o_custkey")
def _bag(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d, "orders").where(F.col("p") == f"{BASE}o_custkey").select(F.col("o").alias("s"), F.lit(f"{BASE}ordered").alias("p"), F.col("s").alias("o"))
    return graph.property_bag(t).select(F.element_at(F.split("node.lex", "/"), -1).cast("bigint").alias("k"), F.size("values").cast("bigint").alias("n"), "n_literals")


@operator("replaced_values", f"SELECT {_C} AS s, CASE WHEN c_custkey = 3 THEN 'New Name' ELSE c_name END AS name FROM customer")
def _replaced(spark: SparkSession, d: str) -> DataFrame:
    new = spark.range(1).select(make(LITERAL, F.lit("New Name"), XSD.string).alias("o"))
    got = graph.replaced(_names(spark, d), f"{BASE}customer/3", f"{BASE}c_name", new, LITERAL)
    return got.where(F.col("p") == f"{BASE}c_name").select(F.col("s.lex").alias("s"), F.col("o.lex").alias("name"))


@operator("label_extraction", f"SELECT {_C} AS node, CASE WHEN c_name < c_mktsegment THEN c_name || ' ; ' || c_mktsegment ELSE c_mktsegment || ' ; ' || c_name END AS label FROM customer UNION ALL SELECT {_S}, s_name FROM supplier")
def _labels(spark: SparkSession, d: str) -> DataFrame:
    t = benchmark_tables(spark, d).quads(["customer", "supplier", "nation"]).select("s", "p", "o")
    return graph.labels(t, (f"{BASE}c_name", f"{BASE}c_mktsegment", f"{BASE}s_name", f"{BASE}n_name"), (f"{BASE}nation/",))


@operator("embedding_drift", "SELECT a.vec_id AS id, round(greatest(0, least(1, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4) AS drift FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _drift(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("id"), graph.drift(F.col("embedding"), F.col("other"), 4).alias("drift"))


@operator("shape_digest", "SELECT true AS same, false AS other, true AS cached")
def _digests(spark: SparkSession, d: str) -> DataFrame:
    text = [_SHAPES + f":S a sh:NodeShape ; sh:targetClass :customer ; sh:property <urn:p> . <urn:p> sh:path :c_name ; sh:minCount {n} ." for n in (1, 2)]
    keys = [digest([q[1:] for q in parse(t)]) for t in (*text, text[0].replace(" ; ", "\n;\n"))]
    return spark.createDataFrame([(keys[0] == keys[2], keys[0] == keys[1], compiled(text[0]) is compiled(text[0]))], "same boolean, other boolean, cached boolean")


@operator("imports_closure", "SELECT 'urn:o:' || i AS ontology, CAST(i AS INTEGER) AS depth FROM range(4) t(i)")
def _imports(spark: SparkSession, d: str) -> DataFrame:
    """Ontologies that import one another in a circle, looked up by IRI."""
    known = {f"urn:o:{i}": f"<urn:o:{i}> <{OWL.imports}> <urn:o:{(i + 1) % 4}> , <urn:none> ." for i in range(4)}
    load = lambda name: quads(spark, parse(known[name])).select("s", "p", "o") if name in known else None
    got = graph.imported(load("urn:o:0"), "urn:o:0", load)
    return spark.createDataFrame(list(got.depths.items()), "ontology string, depth int")


# shapes, in full
def shapes(name: str, text: str, sql: str, data=None) -> None:
    """(node, value, what) of the violations of shapes over the tables, or over triples that data makes."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        source = benchmark_tables(spark, d) if data is None else QuadSource.of_triples(settled(once(data(spark, d)), "data"))
        found = Validator(spark, source, _SHAPES + text).validate()
        return found.select(F.col("focus.lex").alias("node"), F.col("value.lex").alias("value"), F.col("constraint").alias("what"))

    operator(name, sql)(run)


def _bad(node: str, value: str, what: str, rest: str) -> str:
    return f"SELECT {node} AS node, {value} AS value, '{what}' AS what FROM {rest}"


_NONE = "CAST(NULL AS VARCHAR)"
_T = ":S a sh:NodeShape ; sh:targetClass"
shapes("shacl_target_node", f":S a sh:NodeShape ; sh:targetNode <{BASE}customer/1> , <{BASE}customer/2> , <{BASE}customer/999999999> , 'x' ; sh:property [ sh:path :c_name ; sh:minCount 1 ] .", f"SELECT '{BASE}customer/999999999' AS node, {_NONE} AS value, 'minCount' AS what UNION ALL SELECT 'x', {_NONE}, 'minCount'")
shapes("shacl_target_subjects_of", ":S a sh:NodeShape ; sh:targetSubjectsOf :o_totalprice ; sh:property [ sh:path :o_totalprice ; sh:minExclusive 1000 ] .", _bad(_O, "CAST(o_totalprice AS VARCHAR)", "minExclusive", "orders WHERE NOT o_totalprice > 1000"))
shapes("shacl_target_objects_of", ":S a sh:NodeShape ; sh:targetObjectsOf :o_custkey ; sh:property [ sh:path :c_acctbal ; sh:maxExclusive 9000 ] .", _bad(_C, "CAST(c_acctbal AS VARCHAR)", "maxExclusive", "customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND NOT c_acctbal < 9000"))
shapes("shacl_target_where", ":S a sh:NodeShape ; sh:targetWhere [ sh:property [ sh:path :c_mktsegment ; sh:hasValue 'BUILDING' ] ] ; sh:property [ sh:path :c_acctbal ; sh:minInclusive 0 ] .", _bad(_C, "CAST(c_acctbal AS VARCHAR)", "minInclusive", "customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0"), lambda s, d: _triples(s, d, "customer", "supplier"))
shapes("shacl_shape_link", ":S a sh:NodeShape ; sh:property [ sh:path :c_acctbal ; sh:minInclusive 0 ] .", _bad(_C, "CAST(c_acctbal AS VARCHAR)", "minInclusive", "customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 0"), lambda s, d: _triples(s, d, "customer").union(_triples(s, d, "customer").where("o.lex = 'MACHINERY'").select("s", F.lit("http://www.w3.org/ns/shacl#shape").alias("p"), make(IRI, F.lit(f"{BASE}S")).alias("o"))))
shapes("shacl_class_of_some", f"{_T} :orders ; sh:property [ sh:path ( :o_custkey :c_nationkey ) ; sh:class :nation ] ; sh:property [ sh:path :o_custkey ; sh:not [ sh:class :customer ] ] .", _bad(_O, f"'{BASE}customer/' || o_custkey", "not", "orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"))
shapes("shacl_class_in_graph", ":S a sh:NodeShape ; sh:targetSubjectsOf :of ; sh:property [ sh:path :of ; sh:class <urn:big> ] .", _bad(_O, f"'{BASE}customer/' || o_custkey", "class", "orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal <= 5000"), lambda s, d: engine(s, d).run(_P + "CONSTRUCT { ?o :of ?c . ?c a ?k } WHERE { { ?o :o_custkey ?c } UNION { ?c :c_acctbal ?b FILTER(?b > 5000) BIND(IRI('urn:big') AS ?k) } }"))
shapes("shacl_datatype_mixed", ":S a sh:NodeShape ; sh:targetSubjectsOf :v ; sh:property [ sh:path :v ; sh:datatype xsd:integer ] .", _bad(_O, "CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE '' END", "datatype", "orders WHERE o_orderstatus IN ('P', 'F')"), lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(make(IRI, F.concat(F.lit(f"{BASE}orders/"), F.col("o_orderkey").cast("string"))).alias("s"), F.lit(f"{BASE}v").alias("p"), make(LITERAL, F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "x").otherwise("")), F.when(F.col("o_orderstatus") == "F", XSD.string).otherwise(XSD.integer)).alias("o")))
shapes("shacl_node_kind", f"{_T} :orders ; sh:property [ sh:path :o_custkey ; sh:nodeKind sh:IRI ] ; sh:property [ sh:path :o_orderstatus ; sh:nodeKind sh:IRIOrLiteral ; sh:not [ sh:nodeKind sh:BlankNodeOrIRI ] ] ; sh:property [ sh:path :o_totalprice ; sh:nodeKind sh:BlankNode ] .", _bad(_O, "CAST(o_totalprice AS VARCHAR)", "nodeKind", "orders"))
shapes("shacl_lengths", f"{_T} :part ; sh:property [ sh:path :p_brand ; sh:minLength 9 ; sh:singleLine true ; sh:pattern 'BRAND#[1-4]' ; sh:flags 'i' ] .", _bad(f"'{BASE}part/' || p_partkey", "p_brand", "minLength", "part WHERE length(p_brand) < 9") + " UNION ALL " + _bad(f"'{BASE}part/' || p_partkey", "p_brand", "pattern", "part WHERE NOT regexp_matches(p_brand, 'BRAND#[1-4]', 'i')"))
shapes("shacl_and_xone", f"{_T} :customer ; sh:and ( [ sh:path :c_acctbal ; sh:minInclusive 0 ] [ sh:path :c_mktsegment ; sh:in ( 'BUILDING' 'MACHINERY' ) ] ) ; sh:xone ( [ sh:path :c_acctbal ; sh:minInclusive 0 ] [ sh:path :c_mktsegment ; sh:hasValue 'BUILDING' ] ) .", _bad(_C, _C, "and", "customer WHERE NOT (c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY'))") + " UNION ALL " + _bad(_C, _C, "xone", "customer WHERE (c_acctbal >= 0) = (c_mktsegment = 'BUILDING')"))
shapes("shacl_node_and_property", f"{_T} :orders ; sh:property [ sh:path :o_custkey ; sh:node :K ; sh:property [ sh:path :c_acctbal ; sh:minInclusive -500 ] ] . :K sh:property [ sh:path :c_mktsegment ; sh:in ( 'BUILDING' 'MACHINERY' 'AUTOMOBILE' 'FURNITURE' ) ] .", _bad(_O, f"'{BASE}customer/' || o_custkey", "node", "orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'FURNITURE')") + " UNION ALL " + _bad(_C, "CAST(c_acctbal AS VARCHAR)", "minInclusive", "customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_acctbal < -500"))
shapes("shacl_shape_forms", f"{_T} :supplier ; sh:property [ sh:path :s_nationkey ; sh:nodeByExpression :K ; sh:shape :K ; sh:someValue :K ] . :K sh:property [ sh:path :n_regionkey ; sh:hasValue <{BASE}region/1> ] .", " UNION ALL ".join(_bad(_S, v, w, "supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1") for w, v in (("nodeByExpression", f"'{BASE}nation/' || s_nationkey"), ("shape", f"'{BASE}nation/' || s_nationkey"), ("someValue", _NONE))))
shapes("shacl_property_pairs", f"{_T} :customer ; sh:property [ sh:path :c_custkey ; sh:lessThanOrEquals :c_acctbal ] ; sh:property [ sh:path :c_name ; sh:disjoint :c_mktsegment ; sh:subsetOf :c_name ] ; sh:property [ sh:path :c_mktsegment ; sh:disjoint :c_mktsegment ] .", _bad(_C, "CAST(c_custkey AS VARCHAR)", "lessThanOrEquals", "customer WHERE NOT c_custkey <= c_acctbal") + " UNION ALL " + _bad(_C, "c_mktsegment", "disjoint", "customer"))
shapes("shacl_equals", f"{_T} :nation ; sh:property [ sh:path ( [ sh:inversePath :s_nationkey ] :s_nationkey ) ; sh:equals [ sh:inversePath [ sh:inversePath :n_nationkey ] ] ] .", "SELECT node, value, 'equals' AS what FROM (" + f"SELECT {_N} AS node, {_N} AS value, unnest(range(n)) FROM nation JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey UNION ALL SELECT {_N}, CAST(n_nationkey AS VARCHAR), 0 FROM nation)")
shapes("shacl_qualified_max", f"{_T} :customer ; sh:property [ sh:path [ sh:inversePath :o_custkey ] ; sh:qualifiedValueShape [ sh:path :o_totalprice ; sh:minInclusive 200000 ] ; sh:qualifiedMaxCount 4 ] .", _bad(_C, _NONE, "qualifiedMaxCount", "customer JOIN orders ON o_custkey = c_custkey AND o_totalprice >= 200000 GROUP BY c_custkey HAVING count(*) > 4"))
shapes("shacl_closed_orders", f"{_T} :orders ; sh:closed true ; sh:property [ sh:path :o_orderkey ] ; sh:property [ sh:path :o_custkey ] ; sh:property [ sh:path :o_totalprice ] ; sh:property [ sh:path :o_orderdate ] ; sh:property [ sh:path :o_orderpriority ] ; sh:ignoredProperties ( <{RDF.type}> ) .", _bad(_O, "o_orderstatus", "closed", "orders"))
shapes("shacl_unique_keys", f"{_T} :orders ; sh:uniqueValuesFor ( :o_custkey :o_orderdate ) .", _bad(f"'{BASE}orders/' || a.o_orderkey", f"'{BASE}orders/' || b.o_orderkey", "uniqueValuesFor", "orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey <> b.o_orderkey"))
shapes("shacl_recursion", f"{_T} :supplier ; sh:property [ sh:path ( :s_nationkey [ sh:inversePath :s_nationkey ] ) ; sh:node :S ] .", f"SELECT '{BASE}supplier/' || a.s_suppkey AS node, '{BASE}supplier/' || b.s_suppkey AS value, 'node' AS what FROM supplier a JOIN supplier b USING (s_nationkey)")
shapes("shacl_implicit_target", f":customer a <{RDFS.Class}> , sh:NodeShape ; sh:property [ sh:path :c_acctbal ; sh:minInclusive 0 ; sh:deactivated true ] ; sh:property [ sh:path :c_name ; sh:maxCount 0 ] . :P a sh:PropertyShape ; sh:targetClass :supplier ; sh:path :s_acctbal ; sh:minInclusive 0 .", _bad(_C, _NONE, "maxCount", "customer") + " UNION ALL " + _bad(_S, "CAST(s_acctbal AS VARCHAR)", "minInclusive", "supplier WHERE s_acctbal < 0"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Names in English, suppliers' also in German and twice in French."""
    t = _names(spark, d).where(F.col("p") == f"{BASE}c_name").union(_triples(spark, d, "supplier").where(F.col("p") == f"{BASE}s_name"))
    tag = lambda rows, lang, more="": rows.select("s", F.lit(f"{BASE}n").alias("p"), make(LITERAL, F.concat(F.col("o.lex"), F.lit(more)), RDF.langString, F.lit(lang)).alias("o"))
    s = t.where(F.col("p") == f"{BASE}s_name")
    return reduce(DataFrame.union, [tag(t, "en-GB"), tag(s, "de"), tag(s, "fr"), tag(s, "FR", "!")])


shapes("shacl_languages", ":S a sh:NodeShape ; sh:targetSubjectsOf :n ; sh:property [ sh:path :n ; sh:uniqueLang true ; sh:languageIn ( 'en' 'fr' ) ] .", _bad(_S, _NONE, "uniqueLang", "supplier") + " UNION ALL " + _bad(_S, "s_name", "languageIn", "supplier"), _tagged)


def _with_lists(spark: SparkSession, d: str) -> DataFrame:
    """Each customer has a list of nation, region (and the nation again if the customer's number is even)."""
    c = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey").cast("string")
    nation, region = (make(IRI, F.concat(F.lit(f"{BASE}{t}/"), F.col(k).cast("string"))) for t, k in (("nation", "n_nationkey"), ("region", "n_regionkey")))
    even = F.col("c_custkey") % 2 == 0
    cell = lambda i: make(BNODE, F.concat(F.lit(f"l{i}x"), key))
    nil = make(IRI, F.lit(RDF.nil))
    row = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    own = make(IRI, F.concat(F.lit(f"{BASE}customer/"), key))
    cells = [row(own, f"{BASE}l", cell(1)), row(cell(1), RDF.first, nation), row(cell(1), RDF.rest, cell(2)), row(cell(2), RDF.first, region), row(cell(2), RDF.rest, F.when(even, cell(3)).otherwise(nil))]
    third = [row(cell(3), RDF.first, nation), row(cell(3), RDF.rest, nil)]
    return c.select(F.explode(F.concat(F.array(*cells), F.when(even, F.array(*third)).otherwise(F.array(*third[:0]).cast(c.select(F.array(*third)).schema[0].dataType)))).alias("x")).select("x.*")


shapes("shacl_lists", f":S a sh:NodeShape ; sh:targetSubjectsOf :l ; sh:property [ sh:path :l ; sh:minListLength 3 ; sh:maxListLength 2 ; sh:uniqueMembers true ; sh:memberShape [ sh:not [ sh:in ( <{BASE}region/1> ) ] ] ] .", " UNION ALL ".join(f"SELECT {_C} AS node, 'l1x' || c_custkey AS value, '{w}' AS what FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {x}" for w, x in (("minListLength", "c_custkey % 2 = 1"), ("maxListLength", "c_custkey % 2 = 0"), ("uniqueMembers", "c_custkey % 2 = 0"), ("memberShape", "n_regionkey = 1"))), _with_lists)
shapes("shacl_root_class", ":S a sh:NodeShape ; sh:targetSubjectsOf :of ; sh:property [ sh:path :of ; sh:rootClass <http://tables.example/region/2> ] .", _bad(_O, f"'{BASE}customer/' || o_custkey", "rootClass", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2"), lambda s, d: _triples(s, d, "orders").where(F.col("p") == f"{BASE}o_custkey").select("s", F.lit(f"{BASE}of").alias("p"), "o").union(_tree(s, d)))
shapes("shacl_reifier_shape", ":S a sh:NodeShape ; sh:targetSubjectsOf :c_nationkey ; sh:property [ sh:path :c_nationkey ; sh:reificationRequired true ; sh:reifierShape [ sh:path :since ; sh:maxInclusive 100 ] ] .", _bad(_C, f"'{BASE}claim/' || c_custkey", "reifierShape", "customer WHERE c_custkey > 100") + " UNION ALL " + _bad(_C, f"'{BASE}nation/0'", "reificationRequired", "customer WHERE c_nationkey <> 0"), lambda s, d: _claims(s, d).union(_claims(s, d).where(F.col("p") == f"{BASE}c_nationkey").select("s", "p", make(IRI, F.lit(f"{BASE}nation/0")).alias("o"))))


# reports
def _violations(spark: SparkSession, d: str) -> tuple[Validator, DataFrame]:
    text = _SHAPES + ":S a sh:NodeShape ; sh:targetClass :customer ; sh:property [ sh:path :c_acctbal ; sh:minInclusive 0 ; sh:severity sh:Warning ; sh:message 'in debt' ] ; sh:property [ sh:path :c_mktsegment ; sh:pattern '^[A-H]' ] ."
    v = Validator(spark, benchmark_tables(spark, d), text)
    return v, v.validate()


@operator("report_counts", "SELECT 'Warning' AS severity, 'minInclusive' AS \"constraint\", count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'Violation', 'pattern', count(*) FROM customer WHERE NOT regexp_matches(c_mktsegment, '^[A-H]')")
def _report(spark: SparkSession, d: str) -> DataFrame:
    return report(_violations(spark, d)[1]).select("severity", "constraint", "n")


_SH = "http://www.w3.org/ns/shacl#"
_BOTH = "(SELECT (SELECT count(*) FROM customer WHERE c_acctbal < 0) + (SELECT count(*) FROM customer WHERE NOT regexp_matches(c_mktsegment, '^[A-H]')))"


@operator("report_graph", " UNION ALL ".join(f"SELECT '{_SH}{p}' AS p, {_BOTH} AS n" for p in ("result", "focusNode", "resultPath", "value", "resultSeverity", "resultMessage", "sourceShape", "sourceConstraintComponent")) + f" UNION ALL SELECT '{RDF.type}', {_BOTH} + 1 UNION ALL SELECT '{_SH}conforms', 1")
def _report_graph(spark: SparkSession, d: str) -> DataFrame:
    return as_triples(_violations(spark, d)[1]).distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@operator("report_as_json", "SELECT 'in debt' AS message, count(*) AS n, false AS conforms FROM customer WHERE c_acctbal < 0")
def _report_json(spark: SparkSession, d: str) -> DataFrame:
    from .shacl.reports import to_json

    made = json.loads(to_json(_violations(spark, d)[1]))
    return spark.createDataFrame([("in debt", sum(r["message"] == "in debt" for r in made["results"]), made["conforms"])], "message string, n bigint, conforms boolean")


# data quality
def quality(name: str, make_, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = make_(DataQuality(spark, benchmark_tables(spark, d)))
        return found.select(F.col("focus.lex").alias("node"), F.col("value.lex").alias("value"))

    operator(name, sql)(run)


quality("dq_ean13", lambda q: q.ean13(f"{BASE}o_orderkey"), f"SELECT {_O} AS node, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE length(CAST(o_orderkey AS VARCHAR)) <> 13")
quality("dq_unique", lambda q: q.unique(f"{BASE}p_name"), f"SELECT '{BASE}part/' || p_partkey AS node, p_name AS value FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)")
quality("dq_unique_in_class", lambda q: q.unique(f"{BASE}o_custkey", f"{BASE}orders"), f"SELECT {_O} AS node, '{BASE}customer/' || o_custkey AS value FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
quality("dq_legal", lambda q: q.legal(f"{BASE}o_orderkey", f"{BASE}customer", f"{BASE}c_custkey"), f"SELECT {_O} AS node, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
quality("dq_legal_in_class", lambda q: q.legal(f"{BASE}p_size", f"{BASE}nation", f"{BASE}n_nationkey", f"{BASE}part"), f"SELECT '{BASE}part/' || p_partkey AS node, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)")
quality("dq_legal_via", lambda q: q.legal(f"{BASE}c_custkey", f"{BASE}supplier", f"{BASE}s_suppkey", f"{BASE}orders", f"{BASE}o_custkey"), f"SELECT {_O} AS node, CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
quality("dq_illegal", lambda q: q.illegal(f"{BASE}p_size", f"{BASE}nation", f"{BASE}n_nationkey"), f"SELECT '{BASE}part/' || p_partkey AS node, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size IN (SELECT n_nationkey FROM nation)")
quality("dq_illegal_in_class", lambda q: q.illegal(f"{BASE}o_orderkey", f"{BASE}supplier", f"{BASE}s_suppkey", f"{BASE}orders"), f"SELECT {_O} AS node, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderkey IN (SELECT s_suppkey FROM supplier)")
quality("dq_implies", lambda q: q.implies(f"{BASE}o_orderstatus", "P", f"{BASE}o_orderpriority", "1-URGENT"), f"SELECT {_O} AS node, CAST(NULL AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'")
quality("dq_implies_in_class", lambda q: q.implies(f"{BASE}c_mktsegment", "BUILDING", f"{BASE}c_nationkey", f"{BASE}nation/3", f"{BASE}customer"), f"SELECT {_C} AS node, CAST(NULL AS VARCHAR) AS value FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3")
quality("dq_empty_when", lambda q: q.empty_when(f"{BASE}lang", "de", f"{BASE}documents_text"), f"SELECT '{BASE}documents/' || doc_id AS node, CAST(NULL AS VARCHAR) AS value FROM documents WHERE lang = 'de' AND coalesce(text, 'x') <> ''")
quality("dq_trusted_pair", lambda q: q.trusted_pair(f"{BASE}c_custkey", f"{BASE}c_nationkey", f"{BASE}supplier", f"{BASE}s_suppkey", f"{BASE}s_nationkey"), f"SELECT {_C} AS node, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_nationkey = c_nationkey)")
quality("dq_trusted_pair_in_class", lambda q: q.trusted_pair(f"{BASE}p_size", f"{BASE}p_brand", f"{BASE}part", f"{BASE}p_partkey", f"{BASE}p_brand", f"{BASE}part"), f"SELECT '{BASE}part/' || a.p_partkey AS node, CAST(a.p_size AS VARCHAR) AS value FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = a.p_size AND b.p_brand = a.p_brand)")
quality("dq_trusted_pair_via", lambda q: q.trusted_pair(f"{BASE}c_nationkey", f"{BASE}o_orderkey", f"{BASE}supplier", f"{BASE}s_nationkey", f"{BASE}s_suppkey", f"{BASE}orders", f"{BASE}o_custkey"), f"SELECT {_O} AS node, '{BASE}nation/' || c_nationkey AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_orderkey AND s_nationkey = c_nationkey)")


# rules
@operator("owl_rule_catalogue", f"{_TREE} SELECT 'class-label' AS rule, count(*) AS n FROM k UNION ALL SELECT 'single-child', count(*) FROM d WHERE children = 1 HAVING count(*) > 0")
def _rules(spark: SparkSession, d: str) -> DataFrame:
    got = check(spark, _tree(spark, d), "owl")
    rule = F.when(F.col("constraint") == "minCount", "class-label").otherwise(F.element_at(F.split("shape", ":"), -1))
    return got.groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n")).where("rule IN ('class-label', 'single-child')")


# measures of the tree of customers, suppliers, nations and regions
@operator("oquare_metrics", f"""{_TREE}, x AS (SELECT (SELECT count(*) FROM k) AS classes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM d WHERE leaf) AS leaves, (SELECT sum(depth) FROM d WHERE leaf) AS down)
SELECT CAST((SELECT max(depth) FROM d) AS DOUBLE) AS dit, CAST(1 AS DOUBLE) AS nac, round(edges / (classes - 1), 6) AS noc, round(edges / (classes - 1), 6) AS cbo, round(edges / classes, 6) AS wmc, CAST(0 AS DOUBLE) AS rfc, CAST(0 AS DOUBLE) AS nom, round(down / leaves, 6) AS lcom, CAST(0 AS DOUBLE) AS rr, CAST(1 AS DOUBLE) AS inr, CAST(0 AS DOUBLE) AS ar, CAST(0 AS DOUBLE) AS cr, CAST(0 AS DOUBLE) AS an, CAST(0 AS DOUBLE) AS pr, CAST(1 AS DOUBLE) AS tm, CAST(0 AS DOUBLE) AS cycle_participants FROM x""")
def _oquare(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.oquare(_tree(spark, d).withColumn("o", F.when(F.col("p") == RDF.type, make(IRI, F.lit(OWL.Class))).otherwise(F.col("o"))))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@operator("oquare_of_properties", f"""{_TREE}, x AS (SELECT (SELECT count(*) FROM k) AS classes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM customer) AS c)
SELECT round((n + r + edges) / classes, 6) AS wmc, round((n + r) / classes, 6) AS rfc, round((n + r) / classes, 6) AS nom, round(n / classes, 6) AS ar, round((n + r) / (n + r + edges), 6) AS rr, round(edges / (n + r + edges), 6) AS inr, round(c / classes, 6) AS an, round((n + r) / (n + r + edges), 6) AS pr FROM x""")
def _properties(spark: SparkSession, d: str) -> DataFrame:
    """A datatype property on each nation, an object property on each region, a label on each customer."""
    t = _tree(spark, d)
    every = t.where(F.col("p") == RDF.type).select("s")
    extra = []
    for table, kind in (("nation", OWL.DatatypeProperty), ("region", OWL.ObjectProperty)):
        own = every.where(F.contains(F.col("s.lex"), F.lit(f"/{table}/")))
        prop = make(IRI, F.concat(F.lit("urn:p:"), F.col("s.lex")))
        extra += [own.select(prop.alias("s"), F.lit(RDF.type).alias("p"), make(IRI, F.lit(kind)).alias("o")), own.select(prop.alias("s"), F.lit(RDFS.domain).alias("p"), F.col("s").alias("o"))]
    extra.append(every.where(F.contains(F.col("s.lex"), F.lit("/customer/"))).select("s", F.lit(RDFS.label).alias("p"), make(LITERAL, F.col("s.lex"), XSD.string).alias("o")))
    got = metrics.oquare(reduce(DataFrame.union, [t, *extra]))
    return got.select(*(F.round(c, 6).alias(c) for c in ("wmc", "rfc", "nom", "ar", "rr", "inr", "an", "pr")))


@operator("class_use_ratio", f"{_TREE} SELECT round((SELECT count(DISTINCT o_custkey) FROM orders) / (SELECT count(*) FROM k), 6) AS cr")
def _use(spark: SparkSession, d: str) -> DataFrame:
    orders = _triples(spark, d, "orders").where(F.col("p") == f"{BASE}o_custkey").select("s", F.lit(RDF.type).alias("p"), "o")
    return metrics.oquare(_tree(spark, d).where(F.col("p") == RDFS.subClassOf).union(orders)).select(F.round("cr", 6).alias("cr"))


@operator("oquare_scores", "SELECT 'anonto' AS metric, 1 AS score UNION ALL SELECT 'ditonto', 5 UNION ALL SELECT 'tmonto', 5")
def _scores(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.scores(metrics.oquare(_tree(spark, d)))
    return got.where("metric IN ('an', 'dit', 'tm')").select(F.concat("metric", F.lit("onto")).alias("metric"), "score")


@operator("hierarchy_levels", f"{_TREE} SELECT c, depth, CAST(1 AS BIGINT) AS paths FROM d")
def _levels(spark: SparkSession, d: str) -> DataFrame:
    return metrics.Hierarchy(_tree(spark, d)).levels


@operator("hierarchy_fan_out", f"{_TREE} SELECT CAST(max(children) AS BIGINT) AS max, round(avg(children), 6) AS mean, round(median(children), 6) AS median, count(*) FILTER (children = 1) AS n_1, count(*) FILTER (children BETWEEN 2 AND 5) AS n_2_5, count(*) FILTER (children BETWEEN 6 AND 20) AS n_6_20, count(*) FILTER (children BETWEEN 21 AND 50) AS n_21_50, count(*) FILTER (children > 50) AS n_over_50 FROM d WHERE children > 0")
def _fan_out(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.Hierarchy(_tree(spark, d)).fan_out_summary()
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@operator("hierarchy_hot_spots", f"{_TREE} SELECT c, children FROM d WHERE children > 0 ORDER BY children DESC, c LIMIT 10")
def _hot(spark: SparkSession, d: str) -> DataFrame:
    return metrics.Hierarchy(_tree(spark, d)).hot_spots()


@operator("hierarchy_deepest_chain", f"{_TREE}, f AS (SELECT min(c) AS c FROM d WHERE depth = 2), g AS (SELECT parent AS c FROM e JOIN f ON child = c) SELECT 0 AS at, c FROM f UNION ALL SELECT 1, c FROM g UNION ALL SELECT 2, parent FROM e JOIN g ON child = c")
def _chain(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(metrics.Hierarchy(_tree(spark, d)).deepest_chain())), "at int, c string")


@operator("cycle_participants", "SELECT conv_id AS k, count(*) AS n FROM conversations GROUP BY conv_id")
def _cycles(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each conversation in a circle."""
    t = spark.read.parquet(f"{d}/conversations.parquet").selectExpr("conv_id", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i", "count(*) OVER (PARTITION BY conv_id) AS n")
    turn = lambda i: make(IRI, F.concat(F.lit(f"{BASE}turn/"), F.col("conv_id").cast("string"), F.lit("/"), i.cast("string")))
    ring = t.select(turn(F.col("i")).alias("s"), F.lit(RDFS.subClassOf).alias("p"), turn(F.col("i") % F.col("n") + 1).alias("o"))
    return metrics.Hierarchy(settled(ring, "ring")).cycles.groupBy(F.split("c", "/")[4].cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@operator("class_importance", f"{_TREE}, b AS (SELECT c, CASE depth WHEN 0 THEN children + (SELECT count(*) FROM e x JOIN e y ON x.parent = y.child WHERE y.parent = c) ELSE children END AS below, children AS incoming, 1 / (1 + depth) AS near FROM d) SELECT c, round(0.4 * ln(1 + below) / (SELECT max(ln(1 + below)) FROM b) + 0.3 * ln(1 + incoming) / (SELECT max(ln(1 + incoming)) FROM b) + 0.2 * near, 6) AS importance FROM b")
def _importance(spark: SparkSession, d: str) -> DataFrame:
    return metrics.importance(_tree(spark, d).where(F.col("p") == RDFS.subClassOf)).withColumn("importance", F.round("importance", 6))


@operator("prioritised_findings", f"{_TREE}, b AS (SELECT c, CASE depth WHEN 0 THEN children + (SELECT count(*) FROM e x JOIN e y ON x.parent = y.child WHERE y.parent = c) ELSE children END AS below, children AS incoming, 1 / (1 + depth) AS near FROM d), w AS (SELECT c, 0.4 * ln(1 + below) / (SELECT max(ln(1 + below)) FROM b) + 0.3 * ln(1 + incoming) / (SELECT max(ln(1 + incoming)) FROM b) + 0.2 * near AS i FROM b) SELECT c AS node FROM w ORDER BY i DESC, c LIMIT 20")
def _prioritised(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    found = Validator(spark, QuadSource.of_triples(t), _SHAPES + f"@prefix owl: <http://www.w3.org/2002/07/owl#> . :S a sh:NodeShape ; sh:targetClass owl:Class ; sh:property [ sh:path <{RDFS.label}> ; sh:minCount 1 ] .").validate()
    weights = metrics.importance(t.where(F.col("p") == RDFS.subClassOf))
    return metrics.prioritised(found, weights, 20).select(F.col("focus.lex").alias("node"))


@operator("imports_measure", "SELECT 'urn:o' AS ontology, count(*) AS imports, count(*) FILTER (i % 3 = 0) AS versioned FROM range(30) t(i)")
def _imports_measure(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(30).select(make(IRI, F.lit("urn:o")).alias("s"), F.lit(OWL.imports).alias("p"), make(IRI, F.concat(F.lit("urn:x/"), F.when(F.col("id") % 3 == 0, "1.2/").otherwise(""), F.col("id").cast("string"))).alias("o"))
    return metrics.imports(rows)


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    """The tree as SKOS: broader instead of subclass, customers' names as labels, customers of one nation related to their successor."""
    t = _tree(spark, d, SKOS.broader, SKOS.Concept)
    names = _names(spark, d).where(F.col("p") == f"{BASE}c_name").select("s", F.lit(SKOS.prefLabel).alias("p"), make(LITERAL, F.col("o.lex"), RDF.langString, F.lit("en")).alias("o"))
    c = spark.read.parquet(f"{d}/customer.parquet")
    at = lambda k: make(IRI, F.concat(F.lit(f"{BASE}customer/"), k.cast("string")))
    related = c.alias("a").join(c.alias("b"), (F.col("b.c_custkey") == F.col("a.c_custkey") + 1) & (F.col("a.c_nationkey") == F.col("b.c_nationkey"))).select(at(F.col("a.c_custkey")).alias("s"), F.lit(SKOS.related).alias("p"), at(F.col("b.c_custkey")).alias("o"))
    scheme = spark.range(1).select(make(IRI, F.lit("urn:scheme")).alias("s"), F.lit(RDF.type).alias("p"), make(IRI, F.lit(SKOS.ConceptScheme)).alias("o"))
    return settled(reduce(DataFrame.union, [t, names, related, scheme]), "concepts")


@operator("skos_coverage", f"{_TREE}, r AS (SELECT count(*) AS n FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 AND a.c_nationkey = b.c_nationkey) SELECT (SELECT count(*) FROM k) AS concepts, CAST(1 AS BIGINT) AS schemes, (SELECT count(*) FROM customer) AS with_label, CAST(0 AS BIGINT) AS with_definition, CAST(0 AS BIGINT) AS orphans, (SELECT count(*) FROM e) AS broader, CAST(0 AS BIGINT) AS narrower, n AS related FROM r")
def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.skos_coverage(_concepts(spark, d))


@operator("skos_cohorts", f"{_TREE}, r AS (SELECT a.c_nationkey AS k, count(*) AS n FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 AND a.c_nationkey = b.c_nationkey GROUP BY ALL) SELECT c AS parent, children AS size, CAST(children * (children - 1) / 2 AS BIGINT) AS pairs, coalesce(n, 0) AS related FROM d LEFT JOIN r ON c = '{BASE}nation/' || k WHERE children > 1")
def _cohorts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.skos_cohorts(_concepts(spark, d))


@operator("skos_languages", "SELECT 'en' AS lang, count(*) AS labels FROM customer")
def _languages(spark: SparkSession, d: str) -> DataFrame:
    return metrics.skos_languages(_concepts(spark, d))


@operator("authored_graph", f"SELECT 'class' AS what, '{BASE}A' AS node UNION ALL SELECT 'below', '{BASE}B' UNION ALL SELECT 'domain', '{BASE}p' UNION ALL SELECT 'violation', 'urn:i'")
def _authored(spark: SparkSession, d: str) -> DataFrame:
    b = GraphBuilder({"x": BASE})
    b.class_("x:A", "x:B", label="A").property("x:p", domain="x:A")
    b.shape("x:S", "x:A")
    b.shape_property("x:S", "x:p", minCount=1)
    t = b.triples(spark)
    data = quads(spark, parse(f"<urn:i> a <{BASE}A> .")).select("s", "p", "o")
    bad = Validator(spark, QuadSource.of_triples(data), b.rows).validate().select(F.lit("violation").alias("what"), F.col("focus.lex").alias("node"))
    of = lambda what, c, col: t.where(c).select(F.lit(what).alias("what"), F.col(col).alias("node"))
    return reduce(DataFrame.union, [of("class", (F.col("p") == RDF.type) & (F.col("o.lex") == OWL.Class) & (F.col("s.lex") == f"{BASE}A"), "s.lex"), of("below", F.col("p") == RDFS.subClassOf, "o.lex"), of("domain", F.col("p") == RDFS.domain, "s.lex"), bad])
