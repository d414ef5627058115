"""Turtle, TriG, N-Triples, N-Quads, plain JSON-LD and (see rdfxml.py) RDF/XML: read and written."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParseError, UnsupportedError
from ..functions.builtins import parse_nt
from ..operators.graph import line
from ..plans import ast as A
from ..plans.parser import DataParser
from ..terms import BNODE, IRI, LITERAL, QUADS, Term, bnode, iri, literal, nt_text, triple_term
from ..vocab import RDF, XSD

Quad = tuple[str | None, Term, str, Term]
FORMATS = {"rdf-xml": ("rdf", "xml", "owl", "rdfxml", "rdf/xml", "application/rdf+xml"), "turtle": ("ttl", "text/turtle"), "n-triples": ("nt", "ntriples", "application/n-triples"), "n-quads": ("nq", "nquads", "application/n-quads"), "trig": ("application/trig",), "json-ld": ("jsonld", "json", "application/ld+json")}


def format_of(name: str) -> str:
    """The format of a name, an alias or a path's extension, without regard to case."""
    key = name.lower().rpartition("/")[2] if "." in name.rpartition("/")[2] else name.lower()
    for known, aliases in FORMATS.items():
        if key in (known, *aliases) or key.rpartition(".")[2] in (known, *aliases):
            return known
    raise UnsupportedError(f"unknown format {name}")


class _Data(DataParser):
    def new_var(self):
        return self.anonymous()

    def document(self) -> Iterator[Quad]:
        graph = None
        while self.kind() != "end":
            if self.value() in ("@prefix", "@base") or self.is_word("prefix", "base", "version"):
                self.directive()
                continue
            if graph is not None and self.take("}"):
                graph = None
                continue
            if graph is None and (self.take_word("graph") or self.is_punct("{") or (self.value(1) == "{" and self.kind() in ("iri", "pname"))):
                graph = "" if self.is_punct("{") else self.iri()
                self.need("{")
                continue
            out: list = []
            self.triples_same_subject(out)
            for x in out:
                yield (graph or None, *self.triple(x))
            if not self.take(".") and not (graph is not None and self.is_punct("}")):
                self.fail("expected '.'")
        if graph is not None:
            self.fail("expected '}'")

    def directive(self) -> None:
        at = self.next().lower().lstrip("@")
        if at == "version":
            self.string()
        elif at == "base":
            self.base = self.iri()
        else:
            if self.kind() != "pname":
                self.fail("expected a prefix")
            name = self.next()[:-1]
            self.prefixes[name] = self.iri()
        self.take(".")

    def triple(self, x) -> tuple[Term, str, Term]:
        if isinstance(x, A.Reifier):
            return self.flat(x.reifier), RDF.reifies, self.flat(x.triple)
        s = self.flat(x.s)
        if s.kind == LITERAL or not isinstance(x.p, A.Link):
            self.fail("not a triple")
        return s, x.p.iri, self.flat(x.o)

    def flat(self, n) -> Term:
        if isinstance(n, A.Quoted):
            return triple_term(self.flat(n.s), n.p.lex, self.flat(n.o))
        if not isinstance(n, Term):
            self.fail("a variable in data")
        return n


def parse(text: str, fmt: str = "turtle", base: str = "", scope: str = "") -> list[Quad]:
    """The quads of a text. scope: put before blank node labels, so that those of several documents don't meet."""
    fmt = format_of(fmt)
    if fmt == "json-ld":
        made = _jsonld(json.loads(text), base)
    elif fmt == "rdf-xml":
        from .rdfxml import parse_rdfxml

        made = parse_rdfxml(text, base)
    else:
        made = list(_Data(text, {}, base).document())
    if fmt in ("turtle", "n-triples") and any(q[0] for q in made):
        raise ParseError("a graph name in a format without graphs", 1, 1)
    named = lambda t: Term(BNODE, scope + t.lex) if scope and t.kind == BNODE else t
    return list(dict.fromkeys((g, named(s), p, named(o)) for g, s, p, o in made))


def _jsonld(doc, base: str) -> list[Quad]:
    out: list[Quad] = []
    fresh = iter(range(1 << 30))

    def expand(name: str, context: dict, vocab: bool) -> str:
        if vocab and isinstance(found := context.get(name), (str, dict)):
            return expand(found if isinstance(found, str) else found["@id"], {k: v for k, v in context.items() if k != name}, True)
        prefix, colon, local = name.partition(":")
        if colon and isinstance(context.get(prefix), str) and not local.startswith("//"):
            return context[prefix] + local
        return name if colon else (context.get("@vocab", "") if vocab else base) + name

    def node_term(name: str, context: dict) -> Term:
        return bnode(name[2:]) if name.startswith("_:") else iri(expand(name, context, False))

    def value(v, context: dict, kind: str, g) -> Term:
        if isinstance(v, dict) and "@value" in v:
            return literal(v["@value"], expand(v["@type"], context, True) if "@type" in v else "", v.get("@language", ""))
        if isinstance(v, dict) and "@list" in v:
            head = iri(RDF.nil)
            for item in reversed(v["@list"]):
                cell = bnode(f"l{next(fresh)}")
                out.append((g, cell, RDF.first, value(item, context, kind, g)))
                out.append((g, cell, RDF.rest, head))
                head = cell
            return head
        if isinstance(v, dict):
            return node(v, context, g)
        if kind == "@id":
            return node_term(str(v), context)
        return literal(v, expand(kind, context, True) if kind else "")

    def node(d: dict, context: dict, g) -> Term:
        if isinstance(d.get("@context"), dict):
            context = {**context, **d["@context"]}
        s = node_term(d["@id"], context) if "@id" in d else bnode(f"j{next(fresh)}")
        for k, v in d.items():
            if k in ("@id", "@context"):
                continue
            many = v if isinstance(v, list) else [v]
            if k == "@graph":
                for x in many:
                    node(x, context, s.lex if "@id" in d else g)
            elif k == "@type":
                out.extend((g, s, RDF.type, iri(expand(x, context, True))) for x in many)
            else:
                own = context.get(k)
                kind = own.get("@type", "") if isinstance(own, dict) else ""
                out.extend((g, s, expand(k, context, True), value(x, context, kind, g)) for x in many)
        return s

    for d in doc if isinstance(doc, list) else [doc]:
        node(d, {}, None)
    return out


def quads(spark: SparkSession, rows: list[Quad]) -> DataFrame:
    return spark.createDataFrame([(g, s.row, p, o.row) for g, s, p, o in rows], QUADS)


_LINE = r"^\s*(<[^>]*>|_:[^\s<]+)\s*<([^>]*)>\s*(<<\(.*\)>>|<[^>]*>|_:[^\s<]+|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(?:<([^>]*)>\s*)?\.\s*(?:#.*)?$"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(g, s, p, o) of lines (value) of N-Triples or N-Quads, by built-in functions only; a line that is none raises. Works on streams too."""
    cut = lines.select("value", F.regexp_replace("value", _LINE, "\0$4\0$2\0$1\0$3\0").alias("cut"))  # each line is matched once; the object comes last, as it may hold anything
    cut = cut.select("value", "cut", F.split("cut", "\0", 5).alias("part"))
    found = F.startswith("cut", F.lit("\0")) & ~F.startswith("value", F.lit("\0"))
    rest = F.col("part")[4]
    o = F.left(rest, F.length(rest) - F.length(F.substring_index(rest, "\0", -1)) - 1)
    row = F.struct(F.nullif(F.col("part")[1], F.lit("")).alias("g"), F.col("part")[3].alias("s"), F.col("part")[2].alias("p"), o.alias("o"))
    bad = F.raise_error(F.concat(F.lit("not a statement: "), F.substring("value", 1, 200))).cast("array<struct<g:string,s:string,p:string,o:string>>")
    # not a filter: that would be pushed down with a copy of the match
    rows = cut.select(F.explode(F.when(found, F.array(row)).when(~F.col("value").rlike(r"^\s*(#.*)?$"), bad)).alias("x"))
    return rows.select("x.g", parse_nt(F.col("x.s")).alias("s"), "x.p", parse_nt(F.col("x.o")).alias("o"))


def read(spark: SparkSession, path: str, fmt: str = "", base: str = "", parts: bool = False) -> DataFrame:
    """(g, s, p, o) of a file or folder. Line formats are split at will; of the others each file is one task's. parts: the files are parts of one graph, as write() makes them, so what a label names is one blank node."""
    fmt = format_of(fmt or path)
    if fmt in ("n-triples", "n-quads"):
        return parsed_lines(spark.read.text(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                scope = "" if parts else hashlib.md5(name.encode(), usedforsecurity=False).hexdigest()[:8]
                yield _columns(parse(bytes(content).decode(), fmt, base, scope))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, QUADS)


def _columns(rows: list[Quad]) -> pd.DataFrame:
    term = lambda t: dict(zip(("kind", "lex", "dt", "lang", "dir"), t.row))
    return pd.DataFrame({"g": [r[0] for r in rows], "s": [term(r[1]) for r in rows], "p": [r[2] for r in rows], "o": [term(r[3]) for r in rows]})


#: Statements of one file that write() makes of a format without lines.
PART = 10_000


def write(rows: DataFrame, path: str, fmt: str = "", prefixes: dict[str, str] | None = None) -> None:
    """Statements by all tasks: as lines, with a column g as N-Quads; or in another format, as a folder of files of up to PART statements, each a document of its own that read(parts=True) puts together again. A subject's statements stand together as far as they fit in a file."""
    g = F.col("g") if "g" in rows.columns else None
    fmt = format_of(fmt) if fmt else "n-triples"
    if fmt in ("n-triples", "n-quads"):
        rows.select(line(F.col("s"), F.col("p"), F.col("o"), g).alias("value")).write.text(path)
        return
    if g is not None and fmt != "trig":
        rows, g = rows.drop("g"), None
    from .rdfxml import rdfxml_text

    text = {"turtle": lambda q: turtle_text(q, prefixes), "trig": lambda q: turtle_text(q, prefixes), "json-ld": jsonld_text, "rdf-xml": rdfxml_text}[fmt]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part: list[Quad] = []
        for batch in batches:
            for name, s, p, o in zip(batch["g"], batch["s"], batch["p"], batch["o"]):
                part.append((name if isinstance(name, str) else None, Term(*(s[k] for k in _FIELDS)), p, Term(*(o[k] for k in _FIELDS))))
                if len(part) == PART:
                    yield pd.DataFrame({"value": [text(part)]})
                    part = []
        if part:
            yield pd.DataFrame({"value": [text(part)]})

    whole = rows.select((g if g is not None else F.lit(None)).cast("string").alias("g"), "s", "p", "o")
    apart = whole.repartition("g", "s").distinct().sortWithinPartitions("g", "s", "p", "o")
    apart.mapInPandas(run, "value string").write.option("maxRecordsPerFile", 1).text(path)


_FIELDS = ("kind", "lex", "dt", "lang", "dir")


def to_turtle(rows: DataFrame, prefixes: dict[str, str] | None = None) -> str:
    """A graph of a size for reading, as Turtle sorted by subject; with a column g as TriG. write() is for larger ones."""
    return turtle_text([(r["g"] if "g" in rows.columns else None, Term(*r["s"]), r["p"], Term(*r["o"])) for r in rows.distinct().collect()], prefixes)


def turtle_text(rows: list[Quad], prefixes: dict[str, str] | None = None) -> str:
    prefixes = prefixes or {}

    def short(t: Term) -> str:
        if t.kind == IRI:
            for k, ns in prefixes.items():
                local = t.lex.removeprefix(ns)
                if t.lex.startswith(ns) and local.replace("_", "").replace("-", "").isalnum():
                    return f"{k}:{local}"
        if t.kind == LITERAL and t.dt == XSD.integer and t.lex.lstrip("-").isdigit():
            return t.lex
        return nt_text(t)

    graphs: dict[str | None, dict[Term, dict[str, list[Term]]]] = {}
    for g, s, p, o in rows:
        graphs.setdefault(g, {}).setdefault(s, {}).setdefault(p, []).append(o)
    out = [f"@prefix {k}: <{v}> ." for k, v in sorted(prefixes.items())]
    for g, subjects in sorted(graphs.items(), key=lambda x: x[0] or ""):
        body = []
        for s, preds in sorted(subjects.items()):
            said = " ;\n    ".join(("a" if p == RDF.type else short(iri(p))) + " " + ", ".join(map(short, sorted(os))) for p, os in sorted(preds.items(), key=lambda x: (x[0] != RDF.type, x[0])))
            body.append(f"{short(s)} {said} .")
        out += [f"{short(iri(g))} {{", *body, "}"] if g else body
    return "\n".join(out) + "\n"


def to_jsonld(rows: DataFrame) -> str:
    """A graph of a size for reading, as expanded JSON-LD. write() is for larger ones."""
    return jsonld_text([(None, Term(*r["s"]), r["p"], Term(*r["o"])) for r in rows.select("s", "p", "o").distinct().orderBy("s", "p", "o").collect()])


def jsonld_text(rows: list[Quad]) -> str:
    nodes: dict[str, dict] = {}
    name = lambda t: t.lex if t.kind == IRI else f"_:{t.lex}"
    for _, s, p, o in rows:
        d = nodes.setdefault(name(s), {"@id": name(s)})
        if p == RDF.type:
            d.setdefault("@type", []).append(name(o))
            continue
        v = {"@value": o.lex, **({"@language": o.lang} if o.lang else {"@type": o.dt} if o.dt != XSD.string else {})} if o.kind == LITERAL else {"@id": name(o)}
        d.setdefault(p, []).append(v)
    return json.dumps([*nodes.values()], ensure_ascii=False, indent=1)
