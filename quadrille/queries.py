"""The registered queries over the benchmark tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import Repository
from .operators import graph, metrics
from .plans.engine import Engine
from .shacl.validate import Validator
from .sources.quads import QuadSource
from .sources.relational import BASE, benchmark_tables
from .sources.turtle import parsed_lines
from .terms import IRI, make
from .vocab import RDF, RDFS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_P = f"PREFIX : <{BASE}> PREFIX g: <{BASE}graph/> "


#: The columns of each table that are mapped to predicates.
_COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"), "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "conversations": ("conv_id", "turn", "role", "text"), "documents": ("doc_id", "text", "lang", "source", "n_chars"), "pages": ("page_id", "url", "html"), "benchmark": ("item_id", "text"), "labels": ("doc_id", "quality", "toxic"), "embeddings": ("vec_id", "label"),
}


def engine(spark: SparkSession, d: str) -> Engine:
    return Engine(spark, benchmark_tables(spark, d))


def query(name: str, text: str, sql: str, **rounded: int) -> None:
    """A query in the query language; rounded: decimals of its float columns, which depend on the order of sums."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = engine(spark, d).select(_P + text)
        return df.withColumns({c: F.round(c, n) for c, n in rounded.items()}) if rounded else df

    QUERIES[name], SQL[name] = run, sql


def operator(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# basic patterns, joins, filters, aggregates
query(
    "bgp_nation_revenue",
    "SELECT ?name (SUM(?p) AS ?revenue) WHERE { ?l :l_orderkey ?o ; :l_extendedprice ?p . ?o :o_custkey ?c . ?c :c_nationkey ?n . ?n :n_name ?name } GROUP BY ?name ORDER BY DESC(?revenue) ?name",
    "SELECT n_name AS name, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    revenue=2,
)
query(
    "bgp_pricing_summary",
    """SELECT ?flag ?status (SUM(?q) AS ?sum_qty) (SUM(?p) AS ?sum_price) (SUM(?p * (1 - ?d)) AS ?sum_disc) (AVG(?q) AS ?avg_qty) (COUNT(*) AS ?n)
    WHERE { ?l :l_returnflag ?flag ; :l_linestatus ?status ; :l_quantity ?q ; :l_extendedprice ?p ; :l_discount ?d ; :l_shipdate ?s FILTER(?s <= "1998-09-02"^^xsd:date) } GROUP BY ?flag ?status ORDER BY ?flag ?status""",
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 3) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    sum_qty=2, sum_price=2, sum_disc=3, avg_qty=6,
)
query(
    "filter_numeric_range",
    "SELECT ?q ?d ?p WHERE { ?l :l_discount ?d ; :l_quantity ?q ; :l_extendedprice ?p FILTER(?d >= 0.05 && ?d <= 0.07 && ?q < 24) }",
    "SELECT l_quantity AS q, l_discount AS d, l_extendedprice AS p FROM lineitem WHERE l_discount >= 0.05::DOUBLE AND l_discount <= 0.07::DOUBLE AND l_quantity < 24",
)
query(
    "optional_customer_orders",
    "SELECT ?c ?o WHERE { ?c :c_name ?name OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > 200000) } }",
    f"SELECT '{BASE}customer/' || c_custkey AS c, '{BASE}orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000",
)
query(
    "optional_join_on_unbound",
    "SELECT ?c ?o ?s WHERE { ?c :c_mktsegment 'BUILDING' OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus ?s FILTER(?s = 'P') } OPTIONAL { ?o :o_totalprice ?t FILTER(?t > 400000) } }",
    f"""WITH a AS (SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING'),
    big AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 400000)
    SELECT '{BASE}customer/' || c_custkey AS c, '{BASE}orders/' || coalesce(o_orderkey, k) AS o, o_orderstatus AS s FROM a LEFT JOIN big ON (o_orderkey = k OR o_orderkey IS NULL)""",
)
query("union_customer_supplier_names", "SELECT ?name WHERE { { ?c :c_name ?name } UNION { ?s :s_name ?name } }", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
query("minus_customers_pending_orders", "SELECT ?name WHERE { ?c :c_name ?name MINUS { ?o :o_custkey ?c ; :o_orderstatus 'P' } }", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
query("not_exists_orders", "SELECT ?name WHERE { ?c :c_name ?name FILTER NOT EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > 100000) } }", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
query("exists_correlated_filter", "SELECT ?name WHERE { ?c :c_name ?name ; :c_acctbal ?b FILTER EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t < ?b * 20) } }", "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal * 20)")
query("exists_in_expression", "SELECT ?name WHERE { ?c :c_name ?name ; :c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > 400000) }) }", "SELECT c_name AS name FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
query("values_market_segment", "SELECT ?name ?s WHERE { VALUES ?s { 'BUILDING' 'MACHINERY' } ?c :c_mktsegment ?s ; :c_name ?name }", "SELECT c_name AS name, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
query("values_undef", "SELECT ?name ?s WHERE { ?c :c_mktsegment ?s ; :c_name ?name VALUES (?s ?name) { ('BUILDING' UNDEF) (UNDEF 'Customer#000000002') } }", "SELECT c_name AS name, c_mktsegment AS s FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000002'")
query("bind_discounted_price", "SELECT ?k ?net WHERE { ?o :o_orderstatus ?k . ?l :l_orderkey ?o ; :l_extendedprice ?p ; :l_discount ?d BIND(?p * (1 - ?d) AS ?net) FILTER(?net > 50000) }", "SELECT o_orderstatus AS k, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice * (1 - l_discount) > 50000", net=6)
query("subselect_top_customers", "SELECT ?name ?b ?n WHERE { { SELECT ?c ?b WHERE { ?c :c_acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 10 } ?c :c_name ?name ; :c_nationkey ?k . ?k :n_name ?n }", f"SELECT c_name AS name, c_acctbal AS b, n_name AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, '{BASE}customer/' || c_custkey LIMIT 10) JOIN nation ON c_nationkey = n_nationkey")
query("agg_distinct_having", "SELECT ?n (COUNT(DISTINCT ?s) AS ?segments) (COUNT(?c) AS ?customers) WHERE { ?c :c_nationkey ?n ; :c_mktsegment ?s } GROUP BY ?n HAVING (COUNT(?c) > 50)", f"SELECT '{BASE}nation/' || c_nationkey AS n, count(DISTINCT c_mktsegment) AS segments, count(*) AS customers FROM customer GROUP BY c_nationkey HAVING count(*) > 50")
query("agg_min_max_avg", "SELECT ?s (MIN(?b) AS ?low) (MAX(?b) AS ?high) (AVG(?b) AS ?mean) (SAMPLE(?s2) AS ?one) WHERE { ?c :c_mktsegment ?s ; :c_mktsegment ?s2 ; :c_acctbal ?b } GROUP BY ?s", "SELECT c_mktsegment AS s, min(c_acctbal) AS low, max(c_acctbal) AS high, round(avg(c_acctbal), 6) AS mean, min(c_mktsegment) AS one FROM customer GROUP BY c_mktsegment", mean=6)
query("agg_empty_group", "SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?s) WHERE { ?c :c_acctbal ?b FILTER(?b > 1e9) }", "SELECT count(*) AS n, CAST(coalesce(sum(c_acctbal), 0) AS DOUBLE) AS s FROM customer WHERE c_acctbal > 1e9")
query("group_concat_nations", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=', ') AS ?names) WHERE { ?x :n_regionkey ?k ; :n_name ?n . ?k :r_name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
query("distinct_offset_limit", "SELECT DISTINCT ?b WHERE { ?p :p_brand ?b } ORDER BY ?b LIMIT 5 OFFSET 3", "SELECT DISTINCT p_brand AS b FROM part ORDER BY b LIMIT 5 OFFSET 3")
query("order_by_top", "SELECT ?k ?t WHERE { ?o :o_totalprice ?t ; :o_orderpriority ?k } ORDER BY DESC(?t) ?k LIMIT 20", "SELECT o_orderpriority AS k, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderpriority LIMIT 20")
query("constant_subject", f"SELECT ?n ?b WHERE {{ <{BASE}customer/7> :c_name ?n ; :c_acctbal ?b }}", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 7")
query("variable_predicate", f"SELECT ?p ?v WHERE {{ <{BASE}nation/3> ?p ?o BIND(STR(?o) AS ?v) }}", f"SELECT '{BASE}n_nationkey' AS p, '3' AS v UNION ALL SELECT '{BASE}n_name', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '{BASE}n_regionkey', '{BASE}region/' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '{RDF.type}', '{BASE}nation'")
query("type_pattern", "SELECT (COUNT(*) AS ?n) WHERE { ?x a :supplier ; :s_acctbal ?b FILTER(?b > 0) }", "SELECT count(*) AS n FROM supplier WHERE s_acctbal > 0")
query("five_way_join", "SELECT ?r (SUM(?p * (1 - ?d)) AS ?revenue) WHERE { ?l :l_orderkey ?o ; :l_suppkey ?s ; :l_extendedprice ?p ; :l_discount ?d . ?o :o_custkey ?c . ?c :c_nationkey ?n . ?s :s_nationkey ?n . ?n :n_regionkey ?k . ?k :r_name ?r } GROUP BY ?r", "SELECT r_name AS r, round(sum(l_extendedprice * (1 - l_discount)), 3) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", revenue=3)
# graphs
query("named_graph_counts", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s a ?t } } GROUP BY ?g", " UNION ALL ".join(f"SELECT '{BASE}graph/{t}' AS g, count(*) AS n FROM {t}" for t in _COLUMNS))
query("graph_constant", "SELECT ?n ?t WHERE { GRAPH g:customer { ?c :c_name ?n } GRAPH g:orders { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > 300000) } }", "SELECT c_name AS n, o_totalprice AS t FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000")
query("from_graph", f"SELECT (COUNT(*) AS ?n) FROM <{BASE}graph/nation> FROM <{BASE}graph/region> WHERE {{ ?s ?p ?o }}", "SELECT (SELECT count(*) * 4 FROM nation) + (SELECT count(*) * 3 FROM region) AS n")
# paths
query("path_sequence_order_region", "SELECT ?r (COUNT(*) AS ?n) WHERE { ?o :o_custkey/:c_nationkey/:n_regionkey/:r_name ?r } GROUP BY ?r", "SELECT r_name AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
query("path_inverse_nation_customers", "SELECT ?n ?c WHERE { ?x :n_name ?n . ?x ^:c_nationkey/:c_name ?c }", "SELECT n_name AS n, c_name AS c FROM nation JOIN customer ON c_nationkey = n_nationkey")
query("path_alternative_location", "SELECT ?n (COUNT(?x) AS ?k) WHERE { ?x (:c_nationkey|:s_nationkey)/:n_name ?n } GROUP BY ?n", "SELECT n_name AS n, count(*) AS k FROM (SELECT c_nationkey AS x FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON x = n_nationkey GROUP BY n_name")
query("path_zero_or_one", f"SELECT ?x WHERE {{ <{BASE}nation/5> :n_regionkey? ?x }}", f"SELECT '{BASE}nation/5' AS x UNION ALL SELECT '{BASE}region/' || n_regionkey FROM nation WHERE n_nationkey = 5")
query("path_negated", f"SELECT ?v WHERE {{ <{BASE}nation/5> !(:n_name|rdf:type|:n_regionkey) ?v }}", "SELECT n_nationkey::VARCHAR AS v FROM nation WHERE n_nationkey = 5")
query("path_range", f"SELECT ?x WHERE {{ <{BASE}customer/9> (:c_nationkey|:n_regionkey){{1,2}} ?x }}", f"SELECT '{BASE}nation/' || c_nationkey AS x FROM customer WHERE c_custkey = 9 UNION SELECT '{BASE}region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 9")
# functions
query(
    "string_functions",
    """SELECT ?n (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (SUBSTR(?n, 2, 3) AS ?sub) (STRBEFORE(?n, 'I') AS ?before) (STRAFTER(?n, 'I') AS ?after) (CONCAT(?n, '-', ?n) AS ?twice)
    (REPLACE(?n, '[AEIOU]', '_') AS ?rep) (ENCODE_FOR_URI(?n) AS ?enc) (MD5(?n) AS ?md5) (SHA256(?n) AS ?sha) (CONTAINS(?n, 'AN') AS ?has) (STRSTARTS(?n, 'A') AS ?starts) (STRENDS(?n, 'A') AS ?ends) (REGEX(?n, '^u', 'i') AS ?re) (IF(STRLEN(?n) > 6, 'long', 'short') AS ?size)
    WHERE { ?x :n_name ?n }""",
    """SELECT n_name AS n, length(n_name) AS len, upper(n_name) AS up, lower(n_name) AS low, substr(n_name, 2, 3) AS sub, CASE WHEN contains(n_name, 'I') THEN split_part(n_name, 'I', 1) ELSE '' END AS before,
    CASE WHEN contains(n_name, 'I') THEN substr(n_name, strpos(n_name, 'I') + 1) ELSE '' END AS after, n_name || '-' || n_name AS twice, regexp_replace(n_name, '[AEIOU]', '_', 'g') AS rep, replace(n_name, ' ', '%20') AS enc, md5(n_name) AS md5, sha256(n_name) AS sha,
    contains(n_name, 'AN') AS has, starts_with(n_name, 'A') AS starts, ends_with(n_name, 'A') AS ends, regexp_matches(n_name, '^u', 'i') AS re, CASE WHEN length(n_name) > 6 THEN 'long' ELSE 'short' END AS size FROM nation""",
)
query("datetime_functions", "SELECT ?y ?m (COUNT(*) AS ?n) (SUM(DAY(?t)) AS ?days) WHERE { ?o :o_orderdate ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) } GROUP BY ?y ?m", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, CAST(sum(day(o_orderdate)) AS BIGINT) AS days FROM orders GROUP BY ALL")
query("numeric_functions", "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (?b / 2 AS ?h) (isNUMERIC(?b) AS ?num) (COALESCE(?none, ?b) AS ?co) WHERE { ?s :s_acctbal ?b ; :s_name ?k }", "SELECT s_name AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, floor(s_acctbal + 0.5) AS r, s_acctbal / 2 AS h, true AS num, CAST(s_acctbal AS VARCHAR) AS co FROM supplier")
query("term_functions", "SELECT ?n (isIRI(?x) AS ?i) (isLITERAL(?n) AS ?l) (STR(?x) AS ?s) (DATATYPE(?k) AS ?dt) (LANG(?n) AS ?lang) (?x = ?x AS ?eq) (?n IN ('FRANCE', 'PERU') AS ?in) WHERE { ?x :n_name ?n ; :n_nationkey ?k }", f"SELECT n_name AS n, true AS i, true AS l, '{BASE}nation/' || n_nationkey AS s, 'http://www.w3.org/2001/XMLSchema#integer' AS dt, '' AS lang, true AS eq, n_name IN ('FRANCE', 'PERU') AS \"in\" FROM nation")


# query forms
@operator("ask_exists", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000) AS answer")
def _ask(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).run(_P + "ASK { ?o :o_totalprice ?t FILTER(?t > 400000) }")


@operator("construct_customer_region", f"SELECT '{BASE}customer/' || c_custkey AS s, '{BASE}inRegion' AS p, r_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _construct(spark: SparkSession, d: str) -> DataFrame:
    made = engine(spark, d).run(_P + "CONSTRUCT { ?c :inRegion ?r } WHERE { ?c :c_nationkey/:n_regionkey/:r_name ?r }")
    return made.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


@operator("describe_nation", f"SELECT '{BASE}n_nationkey' AS p, '1' AS o UNION ALL SELECT '{BASE}n_name', n_name FROM nation WHERE n_nationkey = 1 UNION ALL SELECT '{BASE}n_regionkey', '{BASE}region/' || n_regionkey FROM nation WHERE n_nationkey = 1 UNION ALL SELECT '{RDF.type}', '{BASE}nation'")
def _describe(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).run(_P + f"DESCRIBE <{BASE}nation/1>").select("p", F.col("o.lex").alias("o"))


@operator("service_join", "SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def _service(spark: SparkSession, d: str) -> DataFrame:
    tables = benchmark_tables(spark, d)
    return Engine(spark, tables, {f"{BASE}sparql": tables}).select(_P + f"SELECT ?name ?nation WHERE {{ ?c :c_name ?name ; :c_acctbal ?b ; :c_nationkey ?n FILTER(?b > 9000) SERVICE <{BASE}sparql> {{ ?n :n_name ?nation }} }}")


# whole graphs
def _triples(spark: SparkSession, d: str, *tables: str) -> DataFrame:
    return benchmark_tables(spark, d).quads([*tables]).select("s", "p", "o")


@operator("materialised_bgp", "SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _materialised(spark: SparkSession, d: str) -> DataFrame:
    source = QuadSource.of_triples(_triples(spark, d, "customer", "nation"))
    return Engine(spark, source).select(_P + "SELECT ?name (COUNT(*) AS ?n) WHERE { ?c :c_nationkey ?x . ?x :n_name ?name } GROUP BY ?name")


@operator("path_plus_reply_chain", "SELECT count(*) AS n, CAST(sum(b.turn - a.turn) AS BIGINT) AS steps FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE NOT EXISTS (SELECT 1 FROM generate_series(a.turn + 1, b.turn - 1) g(t) WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn = g.t))")
def _replies(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/conversations.parquet")
    turn = lambda n: make(IRI, F.concat(F.lit(f"{BASE}turn/"), F.col("conv_id").cast("string"), F.lit("/"), n.cast("string")))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"))
    links = t.select("conv_id", "turn").join(after, ["conv_id", "turn"]).select(turn(F.col("turn")).alias("s"), F.lit(f"{BASE}next").alias("p"), turn(F.col("turn") + 1).alias("o"))
    got = Engine(spark, QuadSource.of_triples(links)).select(_P + "SELECT ?a ?b WHERE { ?a :next+ ?b }")
    at = lambda c: F.element_at(F.split(c, "/"), -1).cast("bigint")
    return got.agg(F.count(F.lit(1)).alias("n"), F.sum(at("b") - at("a")).alias("steps"))


@operator("rdfs_domain_typing", f"SELECT DISTINCT '{BASE}orders/' || o_orderkey AS node, '{BASE}Order' AS class FROM orders UNION ALL SELECT '{BASE}customer/' || o_custkey, '{BASE}Party' FROM (SELECT DISTINCT o_custkey FROM orders)")
def _typing(spark: SparkSession, d: str) -> DataFrame:
    p = f"{BASE}o_custkey"
    rules = [((IRI, p, "", "", ""), RDFS.domain, (IRI, f"{BASE}Order", "", "", "")), ((IRI, p, "", "", ""), RDFS.range, (IRI, f"{BASE}Party", "", "", ""))]
    data = _triples(spark, d, "orders")
    return graph.infer(data.union(spark.createDataFrame(rules, data.schema))).where(F.col("p") == RDF.type).select(F.col("s.lex").alias("node"), F.col("o.lex").alias("class"))


@operator("graph_symmetric_difference", f"SELECT 'left' AS side, '{BASE}orders/' || o_orderkey AS s FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'right', '{BASE}orders/' || o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def _difference(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d, "orders").where(F.col("p") == f"{BASE}o_orderstatus")
    return graph.difference(t.where("o.lex <> 'O'"), t.where("o.lex <> 'F'")).select("side", F.col("s.lex").alias("s"))


@operator("materialise_customer", f"SELECT '{BASE}customer/' || c_custkey AS node, c_name AS name, c_acctbal AS balance FROM customer")
def _resources(spark: SparkSession, d: str) -> DataFrame:
    return graph.materialise(_triples(spark, d, "customer"), {"name": (f"{BASE}c_name", "string", False), "balance": (f"{BASE}c_acctbal", "double", False)})


@operator("property_bag_counts", "SELECT 7 * (SELECT count(*) FROM orders) + 6 * (SELECT count(*) FROM customer) + 7 * (SELECT count(*) FROM part) AS n, 5 * (SELECT count(*) FROM orders) + 4 * (SELECT count(*) FROM customer) + 6 * (SELECT count(*) FROM part) AS n_literals")
def _bags(spark: SparkSession, d: str) -> DataFrame:
    return graph.property_bag(_triples(spark, d, "orders", "customer", "part")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_literals").alias("n_literals"))


@operator("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.35")
def _cosine(spark: SparkSession, d: str) -> DataFrame:
    return graph.cosine_pairs(spark.read.parquet(f"{d}/embeddings.parquet"), 0.35, "vec_id", "embedding")


_LINES = {"orders": ("o_orderkey", (("o_orderstatus", "s"), ("o_orderpriority", "s"), ("o_custkey", "customer"), ("o_orderkey", "i"))), "customer": ("c_custkey", (("c_name", "s"), ("c_mktsegment", "s"), ("c_nationkey", "nation"))), "part": ("p_partkey", (("p_type", "s"), ("p_size", "i")))}


def _object(c: str, kind: str) -> str:
    return f"""'"' || {c} || '"'""" if kind == "s" else f"""'"' || {c} || '"^^<http://www.w3.org/2001/XMLSchema#integer>'""" if kind == "i" else f"'<{BASE}{kind}/' || {c} || '>'"


@operator("snapshot_lines", " UNION ALL ".join(f"SELECT '<{BASE}{t}/' || {k} || '> <{BASE}{c}> ' || {_object(c, kind)} || ' .' AS line FROM {t}" for t, (k, cs) in _LINES.items() for c, kind in cs))
def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    wanted = [f"{BASE}{c}" for _, cs in _LINES.values() for c, _ in cs]
    return graph.snapshot(_triples(spark, d, *_LINES).where(F.col("p").isin(wanted)))


# shapes over tables
_SHAPES = f"""@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix : <{BASE}> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
"""


def shape(name: str, target: str, constraint: str, sql: str) -> None:
    """(node, value) of each violation."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = Validator(spark, benchmark_tables(spark, d), _SHAPES + f":S a sh:NodeShape ; sh:targetClass :{target} ; {constraint} .").validate()
        return found.select(F.col("focus.lex").alias("node"), F.col("value.lex").alias("value"))

    QUERIES[name], SQL[name] = run, sql


_CUSTOMER, _ORDER = f"'{BASE}customer/' || c_custkey AS node", f"'{BASE}orders/' || o_orderkey AS node"
shape("shacl_min_count", "customer", "sh:property [ sh:path [ sh:inversePath :o_custkey ] ; sh:minCount 8 ]", f"SELECT {_CUSTOMER}, CAST(NULL AS VARCHAR) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 8")
shape("shacl_max_count", "customer", "sh:property [ sh:path [ sh:inversePath :o_custkey ] ; sh:maxCount 15 ]", f"SELECT {_CUSTOMER}, CAST(NULL AS VARCHAR) AS value FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) > 15")
shape("shacl_max_inclusive", "orders", "sh:property [ sh:path :o_totalprice ; sh:maxInclusive 400000 ]", f"SELECT {_ORDER}, CAST(o_totalprice AS VARCHAR) AS value FROM orders WHERE o_totalprice > 400000")
shape("shacl_in", "orders", "sh:property [ sh:path :o_orderstatus ; sh:in ( 'F' 'O' ) ]", f"SELECT {_ORDER}, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
shape("shacl_pattern", "customer", "sh:property [ sh:path :c_mktsegment ; sh:pattern '^[A-H]' ]", f"SELECT {_CUSTOMER}, c_mktsegment AS value FROM customer WHERE NOT regexp_matches(c_mktsegment, '^[A-H]')")
shape("shacl_class", "customer", "sh:property [ sh:path :c_nationkey ; sh:class :region ]", f"SELECT {_CUSTOMER}, '{BASE}nation/' || c_nationkey AS value FROM customer")
shape("shacl_datatype", "supplier", "sh:property [ sh:path :s_acctbal ; sh:datatype xsd:decimal ]", f"SELECT '{BASE}supplier/' || s_suppkey AS node, CAST(s_acctbal AS VARCHAR) AS value FROM supplier")
shape("shacl_has_value", "supplier", "sh:property [ sh:path ( :s_nationkey :n_regionkey :r_name ) ; sh:hasValue 'ASIA' ]", f"SELECT '{BASE}supplier/' || s_suppkey AS node, CAST(NULL AS VARCHAR) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
shape("shacl_length", "nation", "sh:property [ sh:path :n_name ; sh:minLength 5 ; sh:maxLength 8 ]", f"SELECT '{BASE}nation/' || n_nationkey AS node, n_name AS value FROM nation WHERE length(n_name) NOT BETWEEN 5 AND 8")
shape("shacl_less_than", "part", "sh:property [ sh:path :p_size ; sh:lessThan :p_partkey ]", f"SELECT '{BASE}part/' || p_partkey AS node, CAST(p_size AS VARCHAR) AS value FROM part WHERE NOT p_size < p_partkey")
shape("shacl_or", "customer", "sh:or ( [ sh:path :c_acctbal ; sh:minInclusive 0 ] [ sh:path :c_mktsegment ; sh:hasValue 'BUILDING' ] )", f"SELECT {_CUSTOMER}, '{BASE}customer/' || c_custkey AS value FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'")
shape("shacl_not_node", "orders", "sh:property [ sh:path :o_custkey ; sh:not [ sh:path :c_acctbal ; sh:minInclusive 0 ] ]", f"SELECT {_ORDER}, '{BASE}customer/' || o_custkey AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0")
shape("shacl_qualified", "customer", "sh:property [ sh:path [ sh:inversePath :o_custkey ] ; sh:qualifiedValueShape [ sh:path :o_totalprice ; sh:minInclusive 300000 ] ; sh:qualifiedMinCount 3 ]", f"SELECT {_CUSTOMER}, CAST(NULL AS VARCHAR) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice >= 300000 GROUP BY c_custkey HAVING count(o_orderkey) < 3")
shape("shacl_sparql", "customer", """sh:sparql [ sh:select "SELECT $this ?value WHERE { ?o <http://tables.example/o_custkey> $this ; <http://tables.example/o_totalprice> ?value FILTER(?value > 450000) }" ]""", f"SELECT {_CUSTOMER}, CAST(o_totalprice AS VARCHAR) AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000")
shape("shacl_unique_values_for", "nation", "sh:uniqueValuesFor ( :n_regionkey )", f"SELECT '{BASE}nation/' || a.n_nationkey AS node, '{BASE}nation/' || b.n_nationkey AS value FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
shape("shacl_closed", "region", "sh:closed true ; sh:property [ sh:path :r_regionkey ] ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> )", f"SELECT '{BASE}region/' || r_regionkey AS node, r_name AS value FROM region")


# updates and measures
@operator("update_delete_insert", f"SELECT '{BASE}orders/' || o_orderkey AS node, CASE o_orderstatus WHEN 'P' THEN 'PENDING' ELSE o_orderstatus END AS status FROM orders")
def _update(spark: SparkSession, d: str) -> DataFrame:
    repo = Repository(spark, _triples(spark, d, "orders").select(F.lit(None).cast("string").alias("g"), "*"))
    repo.update(_P + "DELETE { ?o :o_orderstatus 'P' } INSERT { ?o :o_orderstatus 'PENDING' } WHERE { ?o :o_orderstatus 'P' }")
    return repo.select(_P + "SELECT ?node ?status WHERE { ?node :o_orderstatus ?status }")


@operator("graph_counts", "SELECT 7 * o + 6 * c AS triples, o + c AS subjects, 12 AS predicates, 5 * o + 4 * c AS literal_objects FROM (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM customer) AS c)")
def _counts(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.graph_counts(_triples(spark, d, "orders", "customer"))
    return got.select("triples", "subjects", F.col("predicates").cast("int").alias("predicates"), "literal_objects")


@operator("entity_counts", " UNION ALL ".join(f"SELECT '{BASE}{t}' AS type, count(*) AS n FROM {t}" for t in _COLUMNS if t != "lineitem"))
def _entities(spark: SparkSession, d: str) -> DataFrame:
    return metrics.entity_counts(_triples(spark, d, *(t for t in _COLUMNS if t != "lineitem")))


@operator("cell_statements", " UNION ALL ".join(f"SELECT '{BASE}graph/{t}' AS g, CAST({' + '.join(f'count({c})' for c in cs)} + count(*) AS BIGINT) AS n FROM {t}" for t, cs in _COLUMNS.items()))
def _cells(spark: SparkSession, d: str) -> DataFrame:
    return benchmark_tables(spark, d).quads().groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@operator("line_round_trip", f"SELECT '{BASE}orders/' || o_orderkey AS node, 'o_orderpriority' AS p, o_orderpriority AS v FROM orders UNION ALL SELECT '{BASE}part/' || p_partkey, 'p_name', p_name FROM part UNION ALL SELECT '{BASE}documents/' || doc_id, 'documents_text', text FROM documents WHERE text IS NOT NULL")
def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts with line breaks and quotes among them."""
    t = _triples(spark, d, "orders", "part", "documents")
    back = parsed_lines(t.select(graph.line(F.col("s"), F.col("p"), F.col("o")).alias("value")))
    p = F.replace("p", F.lit(BASE))
    return back.where(p.isin("o_orderpriority", "p_name", "documents_text")).select(F.col("s.lex").alias("node"), p.alias("p"), F.col("o.lex").alias("v"))


from . import queries_more  # noqa: E402, F401  (registers the rest)

__all__ = ["QUERIES", "SQL"]
