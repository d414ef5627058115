"""RDF/XML: read into quads and written."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from ..errors import ParseError
from ..terms import BNODE, IRI, LITERAL, Term, bnode, iri, literal
from ..vocab import RDF, XSD

Quad = tuple[str | None, Term, str, Term]
_XML = "http://www.w3.org/XML/1998/namespace"
_RDF = str(RDF)


def _uri(tag: str) -> str:
    ns, _, local = tag[1:].partition("}")
    return f"{ns}{local}"


def parse_rdfxml(text: str, base: str = "") -> list[Quad]:
    """Node and property elements, typed nodes, attributes as properties, parseType Resource, Collection and Literal, rdf:li, rdf:ID with reification, xml:base and xml:lang."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ParseError(f"no XML: {e}", *e.position) from e
    out: list[Quad] = []
    count = iter(range(1 << 40))
    a = lambda e, name: e.get(f"{{{_RDF}}}{name}")

    def fresh() -> Term:
        return bnode(f"x{next(count)}")

    def scope(e: ET.Element, base_: str, lang: str) -> tuple[str, str]:
        return e.get(f"{{{_XML}}}base", base_), e.get(f"{{{_XML}}}lang", lang)

    def resolved(ref: str, base_: str) -> Term:
        return iri(urljoin(base_, ref) if base_ else ref)

    def say(s: Term, p: str, o: Term, reified: str | None, base_: str) -> None:
        out.append((None, s, p, o))
        if reified is not None:
            r = resolved(f"#{reified}", base_)
            out.extend([(None, r, RDF.type, iri(RDF.Statement)), (None, r, RDF.subject, s), (None, r, RDF.predicate, iri(p)), (None, r, RDF.object, o)])

    def attributes(e: ET.Element, s: Term, base_: str, lang: str) -> None:
        for k, v in e.attrib.items():
            if not k.startswith("{") or k.startswith(f"{{{_XML}}}"):
                continue
            p = _uri(k)
            if p in {f"{_RDF}{n}" for n in ("about", "ID", "nodeID", "resource", "datatype", "parseType")}:
                continue
            out.append((None, s, p, resolved(v, base_) if p == RDF.type else literal(v, "", lang)))

    def node(e: ET.Element, base_: str, lang: str) -> Term:
        base_, lang = scope(e, base_, lang)
        if a(e, "about") is not None:
            s = resolved(a(e, "about"), base_)
        elif a(e, "ID") is not None:
            s = resolved(f"#{a(e, 'ID')}", base_)
        else:
            s = bnode(f"n{a(e, 'nodeID')}") if a(e, "nodeID") is not None else fresh()
        if _uri(e.tag) != f"{_RDF}Description":
            out.append((None, s, RDF.type, iri(_uri(e.tag))))
        attributes(e, s, base_, lang)
        properties(e, s, base_, lang)
        return s

    def properties(e: ET.Element, s: Term, base_: str, lang: str) -> None:
        item = 0
        for x in e:
            p = _uri(x.tag)
            if p == f"{_RDF}li":
                item += 1
                p = f"{_RDF}_{item}"
            own, tongue = scope(x, base_, lang)
            kind, reified = a(x, "parseType"), a(x, "ID")
            if kind == "Resource":
                o = fresh()
                say(s, p, o, reified, own)
                properties(x, o, own, tongue)
            elif kind == "Collection":
                cells = [(fresh(), node(y, own, tongue)) for y in x]
                for (c, v), rest in zip(cells, [c for c, _ in cells[1:]] + [iri(RDF.nil)]):
                    out.extend([(None, c, RDF.first, v), (None, c, RDF.rest, rest)])
                say(s, p, cells[0][0] if cells else iri(RDF.nil), reified, own)
            elif kind is not None:
                inner = (x.text or "") + "".join(ET.tostring(y, "unicode") for y in x)
                say(s, p, literal(inner, f"{_RDF}XMLLiteral"), reified, own)
            elif len(x):
                if len(x) > 1:
                    raise ParseError(f"more than one node in {p}", 1, 1)
                say(s, p, node(x[0], own, tongue), reified, own)
            elif a(x, "resource") is not None or a(x, "nodeID") is not None or any(k.startswith("{") and not k.startswith((f"{{{_XML}}}", f"{{{_RDF}}}")) for k in x.attrib):
                o = resolved(a(x, "resource"), own) if a(x, "resource") is not None else bnode(f"n{a(x, 'nodeID')}") if a(x, "nodeID") is not None else fresh()
                say(s, p, o, reified, own)
                attributes(x, o, own, tongue)
            else:
                dt = a(x, "datatype")
                say(s, p, literal(x.text or "", urljoin(own, dt) if dt and own else dt or "", "" if dt else tongue), reified, own)

    if _uri(root.tag) == f"{_RDF}RDF":
        own, tongue = scope(root, base, "")
        for e in root:
            node(e, own, tongue)
    else:
        node(root, base, "")
    return list(dict.fromkeys(out))


def to_rdfxml(rows: DataFrame) -> str:
    """A graph of a size for reading, as RDF/XML sorted by subject; turtle.write() is for larger ones. Predicates must end in an XML name; quoted triples have no place in the format."""
    return rdfxml_text([(None, Term(*r["s"]), r["p"], Term(*r["o"])) for r in rows.select("s", "p", "o").distinct().collect()])


def rdfxml_text(rows: list[Quad]) -> str:
    names: dict[str, str] = {}
    nodes: dict[Term, list[tuple[str, Term]]] = {}
    for _, s, p, o in rows:
        nodes.setdefault(s, []).append((p, o))
    body = []
    label = lambda t: "n" + re.sub(r"[^A-Za-z0-9_]", lambda m: f"_{ord(m[0]):x}_", t.lex)
    for s, own in sorted(nodes.items()):
        if s.kind not in (IRI, BNODE):
            raise ParseError(f"{s} can't be a subject in RDF/XML", 1, 1)
        body.append(f"  <rdf:Description rdf:{'about' if s.kind == IRI else 'nodeID'}={quoteattr(s.lex if s.kind == IRI else label(s))}>")
        for p, o in sorted(own):
            m = re.search(r"[A-Za-z_][A-Za-z0-9_.-]*$", p)
            if m is None or not p[: m.start()]:
                raise ParseError(f"{p} doesn't end in an XML name", 1, 1)
            tag = f"{names.setdefault(p[: m.start()], f'ns{len(names)}')}:{m[0]}"
            if o.kind == LITERAL:
                extra = f" xml:lang={quoteattr(o.lang)}" if o.lang else f" rdf:datatype={quoteattr(o.dt)}" if o.dt not in ("", XSD.string) else ""
                body.append(f"    <{tag}{extra}>{escape(o.lex, {chr(13): '&#13;'})}</{tag}>")
            elif o.kind in (IRI, BNODE):
                body.append(f"    <{tag} rdf:{'resource' if o.kind == IRI else 'nodeID'}={quoteattr(o.lex if o.kind == IRI else label(o))}/>")
            else:
                raise ParseError(f"{o} can't be an object in RDF/XML", 1, 1)
        body.append("  </rdf:Description>")
    spaces = "".join(f" xmlns:{k}={quoteattr(ns)}" for ns, k in names.items())
    return f'<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF xmlns:rdf="{_RDF}"{spaces}>\n' + "\n".join(body) + "\n</rdf:RDF>\n"
