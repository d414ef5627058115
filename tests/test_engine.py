import pytest
from pyspark.sql import functions as F

from quadrille.dataset import Repository
from quadrille.errors import GraphError, ParseError, QueryError
from quadrille.functions import builtins
from quadrille.functions.values import Value
from quadrille.plans.engine import Engine
from quadrille.plans.parser import parse_query
from quadrille.sources.quads import QuadSource
from quadrille.sources.turtle import parse, quads
from quadrille.store import QuadStore

DATA = """@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :knows :b , :c ; :age 30 ; :name "Ann"@en , "Anna" . :b :knows :c ; :age "x" ; :name "Bob" . :c :knows :a ; :height 1.5 ; :born "2000-01-02"^^xsd:date .
<< :a :knows :b >> :since 2001 . _:z :name "Zed" ; :addr [ :city "Ulm" ] ."""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, QuadSource(quads(spark, parse(DATA))))


def rows(engine, text):
    return sorted(tuple(r) for r in engine.select("PREFIX : <http://x/> " + text).collect())


def test_comparison_errors_are_not_true(engine):
    assert rows(engine, "SELECT ?s { ?s :age ?a FILTER(?a > 18) }") == [("http://x/a",)]
    assert rows(engine, "SELECT ?s { ?s :age ?a FILTER(!(?a > 18)) }") == []


def test_optional_then_bound(engine):
    got = rows(engine, "SELECT ?s ?h { ?s :knows ?o OPTIONAL { ?s :height ?h } FILTER(!BOUND(?h)) }")
    assert [r[0] for r in got] == ["http://x/a", "http://x/a", "http://x/b"]


def test_minus_without_shared_variables_keeps_all(engine):
    assert len(rows(engine, "SELECT ?s { ?s :age ?a MINUS { ?x :height ?h } }")) == 2
    assert rows(engine, "SELECT ?s { ?s :age ?a FILTER NOT EXISTS { ?x :height ?h } }") == []


def test_paths_over_a_circle(engine):
    assert len(rows(engine, "SELECT ?a ?b { ?a :knows+ ?b }")) == 9
    assert rows(engine, "SELECT ?b { :b :knows* ?b }") == [("http://x/a",), ("http://x/b",), ("http://x/c",)]
    assert rows(engine, "SELECT ?b { :nowhere :knows* ?b }") == [("http://x/nowhere",)]
    assert rows(engine, "SELECT ?s { ?s :knows{2} :b }") == [("http://x/c",)]
    assert rows(engine, "SELECT ?s { ?s !(:knows|:name|:age|^:knows) 1.5 }") == [("http://x/c",)]


def test_quoted_triples(engine):
    assert rows(engine, "SELECT ?o ?y { << :a :knows ?o >> :since ?y }") == [("http://x/b", "2001")]
    assert rows(engine, "SELECT (isTRIPLE(?t) AS ?i) (STR(OBJECT(?t)) AS ?o) { ?r <http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies> ?t }") == [(True, "http://x/b")]


def test_order_puts_unbound_first(engine):
    got = engine.select("PREFIX : <http://x/> SELECT ?a { ?s :name ?n OPTIONAL { ?s :age ?a } } ORDER BY ?a").collect()
    assert got[0][0] is None


def test_sum_of_a_non_number_is_an_error(engine):
    assert rows(engine, "SELECT (SUM(?a) AS ?s) (COUNT(?a) AS ?n) { ?x :age ?a }") == [(None, 2)]


def test_language_and_functions(engine):
    assert rows(engine, "SELECT ?n { ?s :name ?n FILTER(LANG(?n) = 'en') }") == [("Ann",)]
    assert rows(engine, "SELECT (UCASE(?n) AS ?u) (LANGMATCHES(LANG(?n), 'EN') AS ?m) { :a :name ?n }") == [("ANN", True), ("ANNA", False)]
    assert rows(engine, "SELECT (YEAR(?b) AS ?y) (?b < '2001-01-01'^^xsd:date AS ?e) { ?s :born ?b }") == [(2000, True)]
    assert rows(engine, "SELECT (DECODE_FOR_URI(ENCODE_FOR_URI('a b+~*')) AS ?x) (STRBEFORE('abc', 'z') AS ?y) { }") == [("a b+~*", "")]


def test_custom_function(engine):
    builtins.register("http://x/twice", lambda v: Value("num", v.num() * 2, "http://www.w3.org/2001/XMLSchema#double"))
    assert rows(engine, "SELECT (:twice(?h) AS ?d) { ?s :height ?h }") == [(3.0,)]
    with pytest.raises(QueryError):
        rows(engine, "SELECT (:unknown(1) AS ?x) { }")


def test_describe_follows_blank_nodes(engine):
    got = engine.run("PREFIX : <http://x/> DESCRIBE ?z { ?z :addr ?a }")
    assert got.count() == 3


def test_construct_blank_nodes_are_fresh_per_solution(engine):
    got = engine.run("PREFIX : <http://x/> CONSTRUCT { _:k :of ?s . ?n :x ?s } WHERE { ?s :age ?n }")
    assert got.count() == 2 and got.select("s").distinct().count() == 2  # literals can't be subjects


def test_parse_errors_have_a_place():
    with pytest.raises(ParseError) as e:
        parse_query("SELECT ?x WHERE {\n ?x ?y }")
    assert e.value.line == 2


def test_updates(spark):
    repo = Repository(spark)
    repo.update("PREFIX : <http://x/> INSERT DATA { :a :p 1 GRAPH :g { :b :p 2 } } ; DELETE { ?s :p ?o } INSERT { ?s :q ?o GRAPH ?s { ?s :q ?o } } WHERE { ?s :p ?o }", {})
    assert repo.list_graphs() == ["http://x/a", "http://x/g"]
    assert repo.ask("ASK { <http://x/a> <http://x/q> 1 }") and not repo.ask("ASK { ?s <http://x/p> 1 }")
    repo.update("COPY GRAPH <http://x/g> TO GRAPH <http://x/h> ; MOVE <http://x/h> TO DEFAULT ; CREATE GRAPH <http://x/e>")
    assert repo.quads.where("g IS NULL").count() == 1 and repo.has_graph("http://x/e")
    with pytest.raises(GraphError):
        repo.update("INSERT DATA { <http://x/n> <http://x/n> 1 } ; CREATE GRAPH <http://x/e>")
    assert not repo.ask("ASK { <http://x/n> ?p ?o }")  # nothing of a failed request stays
    repo.update("DELETE WHERE { GRAPH <http://x/g> { ?s ?p ?o } } ; DROP SILENT GRAPH <http://x/none> ; CLEAR DEFAULT")
    assert repo.list_graphs() == ["http://x/a", "http://x/e"]


def test_from_is_a_set_union(spark):
    e = Engine(spark, QuadSource(quads(spark, parse("PREFIX : <http://x/> :g { :a :p 1 } :h { :a :p 1 . :a :p 2 }", "trig"))))
    assert e.select("SELECT ?o FROM <http://x/g> FROM <http://x/h> { ?s ?p ?o }").count() == 2
    assert e.select("SELECT ?g FROM NAMED <http://x/h> { GRAPH ?g { ?s ?p ?o } }").count() == 2


def test_reifier_and_registered_aggregate(engine):
    assert rows(engine, "SELECT ?y { << :a :knows ?o ~ ?r >> :since ?y }") == [("2001",)]
    builtins.register_aggregate("http://x/widest", lambda v: Value("num", F.max(v.num()) - F.min(v.num()), "http://www.w3.org/2001/XMLSchema#double"), "spread")
    assert rows(engine, "SELECT (:widest(?v) + 1 AS ?w) { VALUES ?v { 1 4 2 } }") == [(4.0,)]
    assert builtins.known("http://x/widest") and builtins.described()["http://x/widest"] == "spread"
    assert builtins.unregister("http://x/widest") and not builtins.known("http://x/widest")


def test_minus_with_unbound_variables(engine):
    assert rows(engine, "SELECT ?s ?h { ?s :name ?n OPTIONAL { ?s :height ?h } MINUS { ?s :age 30 } }") == sorted([("http://x/b", None), *[r for r in rows(engine, "SELECT ?s ?h { ?s :name 'Zed' OPTIONAL { ?s :height ?h } }")]])
    assert rows(engine, "SELECT ?x ?y { VALUES (?x ?y) { (1 UNDEF) (UNDEF 2) (3 4) } MINUS { VALUES (?x ?y) { (1 5) (UNDEF 4) } } }") == [(None, "2")]


def test_store_versions(spark, tmp_path):
    store = QuadStore(spark, f"file://{tmp_path}/store")
    assert store.versions() == [] and store.quads().count() == 0
    first = store.commit(quads(spark, parse(DATA)))
    one, other = store.repository(), store.repository()
    one.update("INSERT DATA { <http://x/n> <http://x/n> 1 } ; CREATE GRAPH <http://x/g>")
    assert store.save(one) == first + 1 and store.repository().has_graph("http://x/g")
    assert store.quads(first).count() + 1 == store.quads().count()
    with pytest.raises(GraphError):
        store.save(other)  # someone was first
    assert store.versions() == [0, 1]


def test_plans_read_only_what_they_need(spark):
    import __spark_entry__

    for name in ("bgp_nation_revenue", "bgp_pricing_summary", "filter_numeric_range", "five_way_join", "bind_discounted_price"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "sha2" not in plan and "l_shipmode" not in plan
        scans = [x for x in plan.split("ReadSchema")[1:] if "l_extendedprice" in x[:400]]
        assert scans and all("l_tax" not in x[:400] for x in scans)


def test_entry_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "quadrille", tmp_path / "quadrille", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()); print(len(e.queries()))"
    assert int(run(code).stdout) > 150
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    assert "no_such_module" in run(code).stderr  # any other missing module is an error
