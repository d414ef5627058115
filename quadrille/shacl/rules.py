"""Catalogues of quality rules as shapes, own wording: ontologies, SKOS vocabularies, engineering practice, RDF 1.2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cosine_pairs
from ..operators.metrics import importance, prioritised
from ..sources.quads import QuadSource
from .validate import Validator

_HEAD = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix dcterms: <http://purl.org/dc/terms/> . @prefix r: <urn:quadrille:rule:> .
"""


def _query(name: str, severity: str, message: str, target: str, where: str, value: bool = False) -> str:
    """A rule that a query states: $this (and ?value) of its rows are at fault."""
    select = f"SELECT $this{' ?value' if value else ''} WHERE {{ {where} }}"
    return f'r:{name} a sh:NodeShape ; {target} ; sh:severity sh:{severity} ; sh:message "{message}" ; sh:sparql [ sh:select """{select}""" ] .\n'


_CLASS, _OP, _DP, _ONT, _CONCEPT = "sh:targetClass owl:Class", "sh:targetClass owl:ObjectProperty", "sh:targetClass owl:DatatypeProperty", "sh:targetClass owl:Ontology", "sh:targetClass skos:Concept"

OWL_QUALITY = _HEAD + f"""
r:ontology-version a sh:NodeShape ; {_ONT} ; sh:severity sh:Warning ; sh:property [ sh:path owl:versionInfo ; sh:minCount 1 ; sh:message "an ontology states its version" ] .
r:ontology-license a sh:NodeShape ; {_ONT} ; sh:property [ sh:path dcterms:license ; sh:minCount 1 ; sh:severity sh:Warning ; sh:message "an ontology names its license" ] .
r:class-label a sh:NodeShape ; {_CLASS} ; sh:property [ sh:path rdfs:label ; sh:minCount 1 ; sh:uniqueLang true ; sh:severity sh:Warning ; sh:message "a class has one label in a language" ] .
r:property-label a sh:NodeShape ; {_OP} , owl:DatatypeProperty ; sh:property [ sh:path rdfs:label ; sh:minCount 1 ; sh:severity sh:Warning ; sh:message "a property has a label" ] .
r:property-domain a sh:NodeShape ; {_OP} , owl:DatatypeProperty ; sh:property [ sh:path rdfs:domain ; sh:minCount 1 ; sh:maxCount 1 ; sh:severity sh:Info ; sh:message "a property has one domain" ] .
r:property-range a sh:NodeShape ; {_OP} , owl:DatatypeProperty ; sh:property [ sh:path rdfs:range ; sh:minCount 1 ; sh:maxCount 1 ; sh:severity sh:Info ; sh:message "a property has one range" ] .
""" + "".join([
    _query("subclass-cycle", "Violation", "a class is below itself", _CLASS, "$this rdfs:subClassOf+ $this"),
    _query("subproperty-cycle", "Violation", "a property is below itself", "sh:targetClass owl:ObjectProperty", "$this rdfs:subPropertyOf+ $this"),
    _query("equivalent-and-below", "Violation", "two classes are equivalent and one is below the other", _CLASS, "$this owl:equivalentClass ?value . $this rdfs:subClassOf ?value", True),
    _query("orphan-class", "Info", "a class that nothing refers to", _CLASS, "$this a owl:Class . FILTER NOT EXISTS { $this rdfs:subClassOf ?a } FILTER NOT EXISTS { ?b ?p $this }"),
    _query("self-inverse", "Violation", "a property is its own inverse", _OP, "$this owl:inverseOf $this"),
    _query("inverse-of-symmetric", "Warning", "a symmetric property has an inverse", _OP, "$this owl:inverseOf ?value . $this a owl:SymmetricProperty", True),
    _query("deprecated-in-use", "Warning", "a deprecated class has instances", _CLASS, "$this owl:deprecated true . ?value a $this", True),
    _query("recursive-definition", "Warning", "a restriction on a class refers to it", _CLASS, "$this rdfs:subClassOf|owl:equivalentClass ?x . ?x owl:someValuesFrom|owl:allValuesFrom $this"),
    _query("class-naming", "Info", "a class name starts with a capital", _CLASS, "$this a owl:Class . FILTER(isIRI($this) && REGEX(REPLACE(STR($this), '^.*[/#]', ''), '^[a-z]'))"),
    _query("property-naming", "Info", "a property name starts with a small letter", _OP, "$this a owl:ObjectProperty . FILTER(REGEX(REPLACE(STR($this), '^.*[/#]', ''), '^[A-Z]'))"),
    _query("missing-inverse", "Info", "a property with a domain and a range has no inverse", _OP, "$this rdfs:domain ?d . $this rdfs:range ?e . FILTER NOT EXISTS { $this owl:inverseOf ?x } FILTER NOT EXISTS { ?y owl:inverseOf $this }"),
    _query("label-is-comment", "Info", "label and comment say the same", _CLASS, "$this rdfs:label ?value . $this rdfs:comment ?value", True),
    _query("polysemy", "Info", "two classes share a label", _CLASS, "$this rdfs:label ?l . ?value rdfs:label ?l . ?value a owl:Class FILTER($this != ?value)", True),
    _query("imports-cycle", "Warning", "an ontology imports itself", _ONT, "$this owl:imports+ $this"),
    _query("single-child", "Info", "a class has one child only", _CLASS, "{ SELECT $this (COUNT(?c) AS ?n) WHERE { ?c rdfs:subClassOf $this } GROUP BY $this } FILTER(?n = 1)"),
    _query("datatype-with-object-range", "Violation", "the range of a datatype property is a class", _DP, "$this rdfs:range ?value . ?value a owl:Class", True),
])

SKOS_QUALITY = _HEAD + f"""
r:concept-label a sh:NodeShape ; {_CONCEPT} ; sh:property [ sh:path skos:prefLabel ; sh:minCount 1 ; sh:uniqueLang true ; sh:message "a concept has one preferred label in a language" ] .
r:labels-differ a sh:NodeShape ; {_CONCEPT} ; sh:property [ sh:path skos:prefLabel ; sh:disjoint skos:altLabel ; sh:message "preferred and other labels differ" ] ; sh:property [ sh:path skos:prefLabel ; sh:disjoint skos:hiddenLabel ] .
r:concept-is-no-scheme a sh:NodeShape ; {_CONCEPT} ; sh:not [ sh:class skos:ConceptScheme ] ; sh:message "a concept is no scheme" .
r:notation a sh:NodeShape ; {_CONCEPT} ; sh:property [ sh:path skos:notation ; sh:nodeKind sh:Literal ; sh:message "a notation is a literal" ] .
""" + "".join([
    _query("related-broader", "Violation", "a related concept is above too", _CONCEPT, "$this skos:related ?value . $this skos:broader+ ?value", True),
    _query("self-relation", "Violation", "a concept refers to itself", _CONCEPT, "$this skos:related|skos:broader|skos:narrower $this"),
    _query("broader-cycle", "Violation", "a concept is above itself", _CONCEPT, "$this skos:broader+ $this"),
    _query("one-way-related", "Info", "related goes one way only", _CONCEPT, "$this skos:related ?value . FILTER NOT EXISTS { ?value skos:related $this }", True),
    _query("mapping-clash", "Violation", "exact and broad match at once", _CONCEPT, "$this skos:exactMatch ?value . $this skos:broadMatch ?value", True),
    _query("concept-orphan", "Info", "a concept without links", _CONCEPT, "$this a skos:Concept . FILTER NOT EXISTS { $this skos:broader|skos:narrower|skos:related|skos:topConceptOf ?x } FILTER NOT EXISTS { ?y skos:broader|skos:narrower|skos:related|skos:hasTopConcept $this }"),
])

ENGINEERING = _HEAD + f"""
r:ontology-contact a sh:NodeShape ; {_ONT} ; sh:property [ sh:path [ sh:alternativePath ( dcterms:creator dcterms:publisher ) ] ; sh:minCount 1 ; sh:severity sh:Warning ; sh:message "an ontology names who keeps it" ] .
r:ontology-no-blank a sh:NodeShape ; sh:targetSubjectsOf rdfs:label ; sh:nodeKind sh:IRI ; sh:severity sh:Info ; sh:message "what has a label has an IRI" .
r:label-is-no-sentence a sh:NodeShape ; sh:targetSubjectsOf rdfs:label ; sh:property [ sh:path rdfs:label ; sh:maxLength 80 ; sh:singleLine true ; sh:severity sh:Info ; sh:message "a label is short" ] .
""" + "".join([
    _query("versioned-import", "Info", "an import without a version", _ONT, "$this owl:imports ?value FILTER(!REGEX(STR(?value), '[0-9]+[.][0-9]+'))", True),
    _query("class-as-instance", "Warning", "a class is an instance of another", _CLASS, "$this a owl:Class . $this a ?value . ?value a owl:Class FILTER(?value != owl:Class)", True),
])

RDF12 = _HEAD + "".join([
    _query("legacy-reification", "Info", "a statement in the old way", "sh:targetClass rdf:Statement", "$this rdf:subject ?s"),
    _query("rtl-direction", "Info", "a label without its direction", "sh:targetSubjectsOf rdfs:label", "$this rdfs:label ?value FILTER(LANG(?value) IN ('ar', 'he', 'fa', 'ur') && LANGDIR(?value) = '')", True),
])
CATALOGUES = {"owl": OWL_QUALITY, "skos": SKOS_QUALITY, "engineering": ENGINEERING, "rdf12": RDF12}


def check(spark: SparkSession, triples: DataFrame, *catalogues: str, top: int | None = None) -> DataFrame:
    """Violations of the catalogues (all, if none is named), the most important first."""
    source = QuadSource.of_triples(triples)
    found = None
    for name in catalogues or CATALOGUES:
        own = Validator(spark, source, CATALOGUES[name]).validate()
        found = own if found is None else found.unionByName(own)
    return prioritised(found, importance(triples), top)


def alike(vectors: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, similarity): entities whose embeddings are alike, that may be one."""
    return cosine_pairs(vectors, least, "iri", "vec").orderBy(F.desc("similarity"), "a", "b")
