"""Terms as struct columns, and their canonical text.

kind is 0 for an IRI, 1 for a blank node, 2 for a literal, 3 for a quoted triple
(lex is then its canonical text). Absent dt, lang and dir are empty strings, so
that struct equality is term equality; a null struct means unbound.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import INTEGERS, NUMERIC, RDF, XSD

TERM = "struct<kind:tinyint,lex:string,dt:string,lang:string,dir:string>"
TRIPLES = f"s {TERM}, p string, o {TERM}"
QUADS = f"g string, {TRIPLES}"
IRI, BNODE, LITERAL, TRIPLE = 0, 1, 2, 3
#: The canonical text of a quoted triple: subject, predicate, object.
QUOTED = r"^<<\(\s*(<<\(.*\)>>|<[^>]*>|_:\S+)\s+<([^>]*)>\s+(.*\S)\s*\)>>$"
_IRI = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$")


@dataclass(frozen=True, order=True)
class Term:
    """A term on the driver."""

    kind: int
    lex: str
    dt: str = ""
    lang: str = ""
    dir: str = ""

    def __str__(self) -> str:
        return nt_text(self)

    @property
    def row(self) -> tuple:
        return (self.kind, self.lex, self.dt, self.lang, self.dir)


def valid_iri(text: str) -> bool:
    return bool(_IRI.match(text))


def iri(text: str) -> Term:
    return Term(IRI, text)


def bnode(label: str) -> Term:
    return Term(BNODE, label)


def literal(value: object, dt: str = "", lang: str = "", dir: str = "") -> Term:
    """A literal of a Python value; strings keep the datatype given, booleans are canonical."""
    import datetime as d
    from base64 import b64encode
    from decimal import Decimal

    if lang:
        return Term(LITERAL, str(value), RDF.dirLangString if dir else RDF.langString, lang, dir.lower())
    if dt == XSD.boolean:
        if str(value) not in ("true", "false", "1", "0"):
            raise ValueError(f"not a boolean: {value!r}")
        return Term(LITERAL, {"1": "true", "0": "false"}.get(str(value), str(value)), dt)
    if dt:
        return Term(LITERAL, str(value), dt)
    if isinstance(value, bool):
        return Term(LITERAL, str(value).lower(), XSD.boolean)
    if isinstance(value, int):
        return Term(LITERAL, str(value), XSD.integer)
    if isinstance(value, Decimal):
        return Term(LITERAL, format(value.normalize(), "f"), XSD.decimal)
    if isinstance(value, float):
        return Term(LITERAL, repr(value), XSD.double)
    if isinstance(value, d.datetime):
        return Term(LITERAL, value.isoformat(), XSD.dateTime)
    if isinstance(value, d.date):
        return Term(LITERAL, value.isoformat(), XSD.date)
    if isinstance(value, d.time):
        return Term(LITERAL, value.isoformat(), XSD.time)
    if isinstance(value, (bytes, bytearray)):
        return Term(LITERAL, b64encode(bytes(value)).decode(), XSD.base64Binary)
    return Term(LITERAL, str(value), XSD.string)


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def nt_text(t: Term) -> str:
    """The term in N-Triples."""
    if t.kind == IRI:
        return f"<{t.lex}>"
    if t.kind == BNODE:
        return f"_:{t.lex}"
    if t.kind == TRIPLE:
        return t.lex
    text = '"' + re.sub(r'[\\"\n\r\t]', lambda m: _ESCAPES[m[0]], t.lex) + '"'
    if t.lang:
        return f"{text}@{t.lang}" + (f"--{t.dir}" if t.dir else "")
    return text if t.dt in ("", XSD.string) else f"{text}^^<{t.dt}>"


def triple_term(s: Term, p: str, o: Term) -> Term:
    return Term(TRIPLE, f"<<( {nt_text(s)} <{p}> {nt_text(o)} )>>")


def lit(t: Term) -> Column:
    """The term as a constant column."""
    return make(t.kind, F.lit(t.lex), t.dt, t.lang, t.dir)


def make(kind: int | Column, lex: Column, dt: str | Column = "", lang: str | Column = "", dir: str | Column = "") -> Column:
    """A term struct, null where lex is."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(c(kind).cast("tinyint").alias("kind"), lex.cast("string").alias("lex"), c(dt).alias("dt"), c(lang).alias("lang"), c(dir).alias("dir"))
    return F.when(lex.isNotNull(), made)


def nt(term: Column) -> Column:
    """The column's terms in N-Triples."""
    text = term["lex"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    tail = F.when(term["lang"] != "", F.concat(F.lit("@"), term["lang"], F.when(term["dir"] != "", F.concat(F.lit("--"), term["dir"])).otherwise("")))
    tail = tail.when(term["dt"].isin("", XSD.string), "").otherwise(F.concat(F.lit("^^<"), term["dt"], F.lit(">")))
    return (
        F.when(term["kind"] == IRI, F.concat(F.lit("<"), term["lex"], F.lit(">")))
        .when(term["kind"] == BNODE, F.concat(F.lit("_:"), term["lex"]))
        .when(term["kind"] == TRIPLE, term["lex"])
        .otherwise(F.concat(quoted, tail))
    )


def number(term: Column) -> Column:
    """The value of a numeric literal as a double; null for anything else."""
    lex = F.when(term["lex"].isin("INF", "+INF"), "Infinity").when(term["lex"] == "-INF", "-Infinity").otherwise(term["lex"])
    return F.when((term["kind"] == LITERAL) & term["dt"].isin(*NUMERIC), lex.try_cast("double"))


def instant(term: Column) -> Column:
    """The value of a date or dateTime literal as a timestamp; null for anything else."""
    return F.when((term["kind"] == LITERAL) & term["dt"].isin(XSD.dateTime, XSD.date, XSD.dateTimeStamp), term["lex"].try_cast("timestamp"))


def equivalent(a: Column, b: Column) -> Column:
    """Like equality, but two literals only need the same lexical form and datatype: language tags don't count."""
    both = (a["kind"] == LITERAL) & (b["kind"] == LITERAL)
    return F.when(both, (a["lex"] == b["lex"]) & (a["dt"] == b["dt"])).otherwise(a == b)


def is_integer(dt: str) -> bool:
    return dt in INTEGERS
