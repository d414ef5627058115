"""IRIs of the vocabularies that the engine itself needs."""

from __future__ import annotations


class Vocabulary(str):
    """A namespace; attributes and items are its IRIs."""

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return f"{self}{name.removesuffix('_')}"

    def __getitem__(self, name: str) -> str:  # type: ignore[override]
        return f"{self}{name}"


RDF = Vocabulary("http://www.w3.org/1999/02/22-rdf-syntax-ns#")
RDFS = Vocabulary("http://www.w3.org/2000/01/rdf-schema#")
XSD = Vocabulary("http://www.w3.org/2001/XMLSchema#")
OWL = Vocabulary("http://www.w3.org/2002/07/owl#")
SH = Vocabulary("http://www.w3.org/ns/shacl#")
SKOS = Vocabulary("http://www.w3.org/2004/02/skos/core#")
PROV = Vocabulary("http://www.w3.org/ns/prov#")
DCAT = Vocabulary("http://www.w3.org/ns/dcat#")
DCTERMS = Vocabulary("http://purl.org/dc/terms/")
DC = Vocabulary("http://purl.org/dc/elements/1.1/")
FOAF = Vocabulary("http://xmlns.com/foaf/0.1/")
GEO = Vocabulary("http://www.opengis.net/ont/geosparql#")
TIME = Vocabulary("http://www.w3.org/2006/time#")
VOID = Vocabulary("http://rdfs.org/ns/void#")
BFO = Vocabulary("http://purl.obolibrary.org/obo/BFO_")
SD = Vocabulary("http://www.w3.org/ns/sparql-service-description#")
VANN = Vocabulary("http://purl.org/vocab/vann/")

PREFIXES = {
    "rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL, "sh": SH, "skos": SKOS, "prov": PROV, "dcat": DCAT, "dcterms": DCTERMS, "dc": DC,
    "foaf": FOAF, "geo": GEO, "time": TIME, "void": VOID, "sd": SD, "vann": VANN,
}
INTEGERS = tuple(XSD[n] for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte"))
NUMERIC = (*INTEGERS, XSD.decimal, XSD.float, XSD.double)


def resolve(name: str, prefixes: dict[str, str] = PREFIXES) -> str:
    """The IRI of a prefixed name; IRIs of common schemes are returned as they are. An unknown prefix is a KeyError."""
    prefix, colon, local = name.partition(":")
    if colon and prefix in ("http", "https", "urn", "file", "data", "mailto"):
        return name
    if not colon or prefix not in prefixes:
        raise KeyError(f"unknown prefix in {name!r}")
    return f"{prefixes[prefix]}{local}"
