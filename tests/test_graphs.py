import json

import pytest
from pyspark.sql import functions as F

from quadrille.errors import ParseError, UnsupportedError
from quadrille.operators import graph, metrics
from quadrille.operators.authoring import GraphBuilder
from quadrille.operators.reasoning import Reasoning, preset, reason
from quadrille.shacl.reports import report_turtle, to_json, to_markdown
from quadrille.shacl.rules import check
from quadrille.shacl.validate import Validator, as_triples, report
from quadrille.sources.quads import QuadSource
from quadrille.sources.rdfxml import to_rdfxml
from quadrille.sources.turtle import parse, parsed_lines, quads, read, to_jsonld, to_turtle, write
from quadrille.streaming.ingest import append, read_stream
from quadrille.terms import bnode, iri, literal
from quadrille.vocab import RDF, RDFS

HEAD = "@prefix : <http://x/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n"


def ttl(spark, text):
    return quads(spark, parse(HEAD + text)).select("s", "p", "o")


def failures(spark, data, shapes, **options):
    got = Validator(spark, QuadSource.of_triples(ttl(spark, data)), HEAD + shapes, **options).validate()
    return sorted((r.focus.lex.removeprefix("http://x/"), r.constraint) for r in got.collect())


def test_lines_round_trip(spark, tmp_path):
    rows = quads(spark, parse('PREFIX : <http://x/> :g { :a :p "q\\"\\n\\\\\\u00e9"@en--ltr , 1.5 , <<( :a :p "x" )>> . _:b :p :c }', "trig"))
    write(rows, str(tmp_path / "out"))
    assert {tuple(map(str, r)) for r in read(spark, str(tmp_path / "out"), "n-quads").collect()} == {tuple(map(str, r)) for r in rows.collect()}
    with pytest.raises(Exception, match="not a statement"):
        parsed_lines(spark.createDataFrame([("<a> b c",)], "value string")).collect()


def test_turtle_and_jsonld_round_trip(spark):
    t = ttl(spark, ':a a :T ; :p 1 , "x"@de ; :q ( :b "c" ) .')
    for made, fmt in ((to_turtle(t, {"x": "http://x/"}), "turtle"), (to_jsonld(t), "json-ld")):
        assert graph.isomorphic(quads(spark, parse(made, fmt)).select("s", "p", "o"), t)
    assert parse(json.dumps({"@context": {"n": "http://x/n"}, "@id": "http://x/a", "n": 1}), "json-ld")[0][2] == "http://x/n"
    with pytest.raises(ParseError):
        parse(":a :b")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.nt").write_text('<http://x/a> <http://x/p> "1" .\n')
    append(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_isomorphism(spark):
    a, b, c = (ttl(spark, x) for x in ("_:a :p _:b . _:b :q 1 .", "_:x :p _:y . _:y :q 1 .", "_:x :p _:y . _:x :q 1 ."))
    assert graph.isomorphic(a, b) and not graph.isomorphic(a, c)
    assert graph.blank_node_mapping(a, b) == {"a": "x", "b": "y"}


def test_isomorphism_where_colours_do_not_decide(spark):
    ring = lambda n, at=0: " ".join(f"_:n{at + i} :p _:n{at + (i + 1) % n} ." for i in range(n))
    six, three, turned = (ttl(spark, x) for x in (ring(6), ring(3) + ring(3, 3), " ".join(f"_:m{5 * i % 6} :p _:m{5 * (i + 1) % 6} ." for i in range(6))))
    assert not graph.isomorphic(six, three) and graph.isomorphic(six, turned) and graph.blank_node_mapping(six, three) is None
    found = graph.blank_node_mapping(six, turned)
    assert {(found[f"n{i}"], found[f"n{(i + 1) % 6}"]) for i in range(6)} == {(f"m{5 * i % 6}", f"m{5 * (i + 1) % 6}") for i in range(6)}


def test_colours_go_on_until_stable(spark):
    chain = lambda n, name: [(f"{name}{i}", f"{name}{i + 1}") for i in range(n)]
    t = lambda edges: quads(spark, [(None, bnode(a), "http://x/p", bnode(b)) for a, b in edges]).select("s", "p", "o")
    assert not graph.isomorphic(t(chain(8, "a") + chain(4, "b")), t(chain(6, "a") + chain(6, "b")))


def test_rdf_xml(spark):
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/" xml:base="http://x/" xml:lang="en">
    <x:T rdf:about="a" x:n="q"><x:p rdf:resource="b"/><x:i rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</x:i>
    <x:r rdf:parseType="Resource"><x:m>in</x:m></x:r><x:l rdf:parseType="Collection"><rdf:Description rdf:about="c"/></x:l><x:k rdf:ID="s">v</x:k></x:T></rdf:RDF>"""
    want = ttl(spark, ':a a :T ; :n "q"@en ; :p :b ; :i 5 ; :r [ :m "in"@en ] ; :l ( :c ) ; :k "v"@en . <http://x/#s> a <%s> ; <%s> :a ; <%s> :k ; <%s> "v"@en .' % (RDF.Statement, RDF.subject, RDF.predicate, RDF.object))
    got = quads(spark, parse(text, "rdf/xml")).select("s", "p", "o")
    assert graph.isomorphic(got, want)
    assert graph.isomorphic(quads(spark, parse(to_rdfxml(want), "rdf-xml")).select("s", "p", "o"), want)
    with pytest.raises(ParseError):
        parse("<a", "rdf-xml")


def test_lines_with_long_literals(spark, tmp_path):
    long = 'word "quoted" \\ \n' * 20_000
    rows = quads(spark, [(None, iri("http://x/a"), "http://x/p", literal(long))])
    write(rows, str(tmp_path / "long"))
    assert read(spark, str(tmp_path / "long"), "n-quads").first().o.lex == long


def test_imports_end_in_a_circle(spark):
    known = {n: f"<urn:{n}> <http://www.w3.org/2002/07/owl#imports> <urn:{m}> , <urn:gone> ." for n, m in ("ab", "bc", "ca")}
    got = graph.imported(ttl(spark, known["a"]), "urn:a", lambda n: ttl(spark, known[n[-1]]) if n[-1] in known else None)
    assert got.depths == {"urn:a": 0, "urn:b": 1, "urn:c": 2} and got.missing == ["urn:gone"] and got.triples.count() == 6


def test_reports(spark):
    v = Validator(spark, QuadSource.of_triples(ttl(spark, ":a a :P . :b a :P .")), HEAD + ":S a sh:NodeShape ; sh:targetClass :P ; sh:property [ sh:path :n ; sh:minCount 1 ; sh:message 'a | b' ] .").validate()
    made = json.loads(to_json(v, 1))
    assert made["results_total"] == 2 and len(made["results"]) == 1 and not made["conforms"]
    assert "a \\| b" in to_markdown(v) and "sh:ValidationReport" in report_turtle(v)
    t = as_triples(v)
    assert t.where("p LIKE '%#result'").count() == 2 and t.where("p LIKE '%#conforms'").first().o.lex == "false"
    assert as_triples(v.limit(0)).where("p LIKE '%#conforms'").first().o.lex == "true"


def test_equals_compares_bags(spark):
    data = ":a :f :b , :c ; :g 1 . :b :v 1 . :c :v 1 . :d :f :b ; :g 1 ."
    shape = ":S a sh:NodeShape ; sh:targetSubjectsOf :f ; sh:property [ sh:path ( :f :v ) ; sh:equals :g ] ."
    assert failures(spark, data, shape) == [("a", "equals")]


def test_rdfs(spark):
    t = ttl(spark, ":A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :C rdfs:subClassOf :D . :p rdfs:domain :A ; rdfs:range :D . :x :p :y .")
    once = {(r.s.lex[-1], r.o.lex[-1]) for r in graph.infer(t).collect()}
    assert once == {("A", "C"), ("B", "D"), ("x", "A"), ("y", "D")}
    full = {(r.s.lex[-1], r.o.lex[-1]) for r in graph.infer(t, "fixpoint").collect()}
    assert full == once | {("A", "D"), ("x", "B"), ("x", "C"), ("x", "D")}


def test_reasoning_by_rules(spark):
    t = ttl(spark, ":p a owl:FunctionalProperty . :a :p :x , :y . :y :q 1 . :U owl:unionOf ( :A :B ) . :i a :A . :j a :B .")
    got = {(r.s.lex[-1], r.p.rpartition("#")[2].rpartition("/")[2], r.o.lex[-1]) for r in reason(t, preset("owl_rl")).collect()}
    assert {("y", "sameAs", "x"), ("x", "q", "1"), ("A", "subClassOf", "U"), ("i", "type", "U"), ("j", "type", "U")} <= got
    assert reason(t, preset("rdfs")).count() == 0 and reason(t, preset("custom", custom=("CONSTRUCT { ?s <http://x/is> ?o } WHERE { ?s a ?o }",), rounds=1)).count() == 3
    for bad in (lambda: preset("owl_dl"), lambda: Reasoning(frozenset({"magic"}))):
        with pytest.raises(UnsupportedError):
            bad()


def test_lists(spark):
    t = ttl(spark, ":a :l ( 1 2 ) . :b :l _:c . _:c <%s> 1 ; <%s> _:c ." % (RDF.first, RDF.rest))
    heads = t.where(F.col("p") == "http://x/l").select(F.col("o").alias("head"))
    got = sorted([None if r.items_ is None else len(r.items_) for r in graph.lists(t, heads).withColumnRenamed("items", "items_").collect()], key=str)
    assert got == [2, None]


def test_shapes(spark):
    data = ':a a :P ; :name "A" , "B" ; :age 5 . :b a :Q ; :age "x" ; :friend :a . :Q rdfs:subClassOf :P .'
    shape = ":S a sh:NodeShape ; sh:targetClass :P ; sh:property [ sh:path :name ; sh:minCount 1 ; sh:maxCount 1 ] ; sh:property [ sh:path :age ; sh:datatype xsd:integer ; sh:minInclusive 6 ] ."
    assert failures(spark, data, shape) == [("a", "maxCount"), ("a", "minInclusive"), ("b", "datatype"), ("b", "minCount"), ("b", "minInclusive")]
    assert failures(spark, data, ":S a sh:NodeShape ; sh:targetNode :b ; sh:property [ sh:path ( :friend :name ) ; sh:minCount 2 ; sh:node :S ] .") == [("b", "node")] * 2  # a shape that calls itself
    assert failures(spark, data, ":S a sh:NodeShape ; sh:targetSubjectsOf :age ; sh:xone ( [ sh:path :name ; sh:minCount 1 ] [ sh:path :friend ; sh:minCount 1 ] ) .") == []
    assert failures(spark, data, ":S a sh:NodeShape ; sh:targetObjectsOf :friend ; sh:closed true ; sh:property [ sh:path :name ] .") == [("a", "closed"), ("a", "closed")]


def test_shapes_of_lists_languages_pairs(spark):
    data = ':a :l ( 1 1 ) ; :t "x"@en , "y"@EN ; :lo 3 ; :hi 2 . :b :l :a .'
    target = ":S a sh:NodeShape ; sh:targetSubjectsOf :l ; "
    assert failures(spark, data, target + "sh:property [ sh:path :l ; sh:uniqueMembers true ; sh:minListLength 1 ] .") == [("a", "uniqueMembers"), ("b", "minListLength"), ("b", "uniqueMembers")]
    assert failures(spark, data, target + "sh:property [ sh:path :t ; sh:uniqueLang true ; sh:languageIn ( 'en' ) ] .") == [("a", "uniqueLang")]
    assert failures(spark, data, target + "sh:property [ sh:path :lo ; sh:lessThan :hi ; sh:equals :hi ] .") == [("a", "equals"), ("a", "equals"), ("a", "lessThan")]


def test_report_as_triples(spark):
    v = Validator(spark, QuadSource.of_triples(ttl(spark, ":a a :P .")), HEAD + ":S a sh:NodeShape ; sh:targetClass :P ; sh:property [ sh:path :n ; sh:minCount 1 ; sh:severity sh:Warning ] .")
    found = v.validate()
    assert v.conforms() and report(found).first().n == 1 and as_triples(found).count() == 10


def test_measures(spark):
    diamond = ttl(spark, ":B rdfs:subClassOf :A . :C rdfs:subClassOf :A . :D rdfs:subClassOf :B , :C .")
    got = metrics.oquare(diamond).first()
    assert (got.dit, got.nac, got.tm, got.cycle_participants) == (2, 2, 2, 0)
    assert metrics.oquare(ttl(spark, ":A rdfs:subClassOf :B . :B rdfs:subClassOf :A .")).first().cycle_participants == 2
    chain = metrics.Hierarchy(ttl(spark, ":B rdfs:subClassOf :A . :C rdfs:subClassOf :B . :D rdfs:subClassOf :C ."))
    assert len(chain.deepest_chain()) == 4 and chain.fan_out_summary().first()["median"] == 1
    assert metrics.importance(diamond).orderBy(F.desc("importance")).first().c == "http://x/A"


def test_cohorts(spark):
    t = ttl(spark, ":a a skos:Concept . :b a skos:Concept ; skos:broader :a ; skos:related :c . :c a skos:Concept ; skos:broader :a ; skos:prefLabel 'c'@en .")
    r = metrics.skos_cohorts(t).first()
    assert (r["size"], r.pairs, r.related) == (2, 1, 1)
    c = metrics.skos_coverage(t).first()
    assert (c.concepts, c.with_label, c.orphans, c.broader) == (3, 1, 0, 2)


def test_rules(spark):
    t = ttl(spark, ":A a owl:Class ; rdfs:label 'A'@en ; rdfs:subClassOf :B . :B a owl:Class ; rdfs:label 'B'@en ; rdfs:subClassOf :A .")
    got = {(r["shape"].rpartition(":")[2], r.focus.lex[-1]) for r in check(spark, t, "owl").where("severity = 'Violation'").collect()}
    assert got == {("subclass-cycle", "A"), ("subclass-cycle", "B")}


def test_builder(spark):
    b = GraphBuilder({"x": "http://x/"})
    b.class_("x:A", "x:B", label="A").property("x:p", domain="x:A").reifies("x:r", "x:a", "x:p", 1).add("x:a", "x:l", b.list([1, 2]))
    b.shape("x:S", "x:A")
    b.shape_property("x:S", "x:p", minCount=1)
    v = Validator(spark, QuadSource.of_triples(ttl(spark, ":i a :A .")), b.rows).validate()
    assert v.count() == 1 and b.triples(spark).where(F.col("p") == RDFS.domain).count() == 1


def test_similarity(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0])], "id string, vec array<float>")
    assert [(r.a, r.b) for r in graph.cosine_pairs(v, 0.7).collect()] == [("a", "b")]
    assert v.select(graph.drift(F.col("vec"), F.array(F.lit(1.0), F.lit(0.0)))).collect()[1][0] == 0.2


def test_drift_is_rounded_once(spark, tmp_path):
    import __spark_entry__

    v = [(0, [0.5000503, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (4, [1.0, 0.0])]  # 0.4999497: to 6 places 0.49995, which rounds to 0.5
    spark.createDataFrame(v, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(tuple(r) for r in __spark_entry__.queries()["embedding_drift"](spark, str(tmp_path)).collect()) == [(0, 0.4999), (1, 1.0)]
