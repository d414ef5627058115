"""The scalar functions of the query language, as column expressions; each takes and returns Values. A null column is an error or unbound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..terms import BNODE, IRI, LITERAL, QUOTED, TRIPLE, make, nt
from ..vocab import NUMERIC, RDF, XSD
from .values import Value, equal, promoted

Function = Callable[..., Value]
FUNCTIONS: dict[str, Function] = {}
#: Functions that users added: name -> (function, description).
CUSTOM: dict[str, str] = {}


def function(*names: str) -> Callable[[Function], Function]:
    def add(f: Function) -> Function:
        FUNCTIONS.update(dict.fromkeys((n.lower() for n in names), f))
        return f

    return add


def register(name: str, f: Function, description: str = "") -> None:
    """Adds a function under a name or an IRI; it takes Values and returns one."""
    FUNCTIONS[name.lower()] = f
    CUSTOM[name.lower()] = description


#: Aggregates that users added: name -> a function of a Value that returns a Value of an aggregate column.
AGGREGATES: dict[str, Function] = {}


def register_aggregate(name: str, f: Function, description: str = "") -> None:
    """Adds an aggregate under an IRI; it takes the Value of the argument and returns one whose column aggregates it."""
    AGGREGATES[name.lower()] = f
    CUSTOM[name.lower()] = description


def unregister(name: str) -> bool:
    """Takes a function or aggregate away; whether there was one."""
    there = [d.pop(name.lower(), None) is not None for d in (FUNCTIONS, AGGREGATES, CUSTOM)]
    return any(there)


def known(name: str) -> bool:
    return name.lower() in FUNCTIONS or name.lower() in AGGREGATES or name in _CASTS


def described() -> dict[str, str]:
    """The functions and aggregates that users added, with their descriptions."""
    return dict(CUSTOM)


def call(name: str, args: list[Value]) -> Value:
    f = FUNCTIONS.get(name.lower()) or (FUNCTIONS.get(_CASTS[name]) if name in _CASTS else None)
    if f is None:
        raise QueryError(f"unknown function {name}")
    return f(*args)


def _str(c: Column) -> Value:
    return Value("str", c)


def _bool(c: Column) -> Value:
    return Value("bool", c)


def _int(c: Column) -> Value:
    return Value("num", c, XSD.integer)


def _string(v: Value) -> Column:
    """The lexical form of a string literal; of others null."""
    if v.form == "term":
        t = v.col
        return F.when((t["kind"] == LITERAL) & (t["dt"].isin("", XSD.string) | (t["lang"] != "")), t["lex"])
    return v.col if v.form == "str" else F.lit(None).cast("string")


def _keep(v: Value, made: Column) -> Value:
    """A string with the language of v."""
    if v.form == "str":
        return _str(made)
    t = v.term()
    return Value("term", make(LITERAL, made, t["dt"], t["lang"], t["dir"]))


@function("bound")
def bound(v: Value) -> Value:
    return _bool(v.col.isNotNull())


for _name, _kind in (("isiri", IRI), ("isuri", IRI), ("isblank", BNODE), ("isliteral", LITERAL), ("istriple", TRIPLE)):
    FUNCTIONS[_name] = lambda v, k=_kind: _bool(v.kind() == k)

FUNCTIONS |= {
    "isnumeric": lambda v: _bool(F.when(v.col.isNotNull(), v.num().isNotNull())),
    "str": lambda v: _str(F.when(v.kind() != BNODE, v.text())),
    "lang": lambda v: _str(v.col["lang"] if v.form == "term" else F.when(v.kind() == LITERAL, F.lit(""))),
    "langdir": lambda v: _str(v.col["dir"] if v.form == "term" else F.when(v.kind() == LITERAL, F.lit(""))),
    "datatype": lambda v: Value("iri", v.datatype()),
    "iri": lambda v: Value("iri", v.text()),
    "uri": lambda v: Value("iri", v.text()),
    "bnode": lambda v=None: Value("bnode", v.text() if v else F.replace(F.uuid(), F.lit("-"), F.lit(""))),
    "strlen": lambda v: _int(F.char_length(_string(v)).cast("bigint")),
    "ucase": lambda v: _keep(v, F.upper(_string(v))),
    "lcase": lambda v: _keep(v, F.lower(_string(v))),
    "contains": lambda a, b: _bool(F.contains(_string(a), _string(b))),
    "strstarts": lambda a, b: _bool(F.startswith(_string(a), _string(b))),
    "strends": lambda a, b: _bool(F.endswith(_string(a), _string(b))),
    "concat": lambda *v: _str(F.concat(*(x.text() for x in v))),
    "encode_for_uri": lambda v: _str(F.replace(F.replace(F.replace(F.url_encode(_string(v)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))),
    "decode_for_uri": lambda v: _str(F.try_url_decode(F.replace(_string(v), F.lit("+"), F.lit("%2B")))),
    "rand": lambda: Value("num", F.rand(), XSD.double),
    "random": lambda: _int(F.floor(F.rand() * 2147483647).cast("bigint")),
    "now": lambda: Value("time", F.current_timestamp(), XSD.dateTime),
    "sameterm": lambda a, b: _bool(a.term() == b.term()),
    "md5": lambda v: _str(F.md5(v.text().cast("binary"))),
    "sha1": lambda v: _str(F.sha1(v.text().cast("binary"))),
    "uuid": lambda: Value("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "struuid": lambda: _str(F.uuid()),
    "strlangdir": lambda s, lang, d: Value("term", make(LITERAL, s.text(), RDF.dirLangString, lang.text(), F.lower(d.text()))),
    "strlang": lambda s, lang: Value("term", make(LITERAL, s.text(), RDF.langString, lang.text())),
    "strdt": lambda s, dt: Value("term", make(LITERAL, s.text(), dt.text())),
    "haslang": lambda v, x=None: _bool(F.lower(v.term()["lang"]) == F.lower(x.text()) if x else v.term()["lang"] != ""),
    "haslangdir": lambda v, x=None: _bool(v.term()["dir"] == F.lower(x.text()) if x else v.term()["dir"] != ""),
}
for _bits in (256, 384, 512):
    FUNCTIONS[f"sha{_bits}"] = lambda v, n=_bits: _str(F.sha2(v.text().cast("binary"), n))
for _other, _own in (("startswith", "strstarts"), ("endswith", "strends"), ("encodeforuri", "encode_for_uri"), ("decodeforuri", "decode_for_uri")):
    FUNCTIONS[_other] = FUNCTIONS[_own]


@function("langmatches")
def langmatches(lang: Value, wanted: Value) -> Value:
    a, b = F.lower(lang.text()), F.lower(wanted.text())
    return _bool(F.when(b == "*", a != "").otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-")))))


@function("substr")
def substr(v: Value, start: Value, length: Value | None = None) -> Value:
    s, a = _string(v), start.num().cast("int")
    first = F.greatest(a, F.lit(1))
    n = F.char_length(s) if length is None else F.greatest(length.num().cast("int") - (first - a), F.lit(0))
    return _keep(v, F.substring(s, first, n))


@function("strbefore")
def strbefore(v: Value, part: Value) -> Value:
    s, p = _string(v), _string(part)
    at = F.call_function("instr", s, p)
    return _keep(v, F.when(at > 0, F.substring(s, F.lit(1), at - 1)).when(at == 0, F.lit("")))


@function("strafter")
def strafter(v: Value, part: Value) -> Value:
    s, p = _string(v), _string(part)
    at = F.call_function("instr", s, p)
    return _keep(v, F.when(at > 0, F.substring(s, at + F.char_length(p), F.char_length(s))).when(at == 0, F.lit("")))


def _pattern(p: Value, flags: Value | None) -> Column:
    return p.text() if flags is None else F.when(flags.text() == "", p.text()).otherwise(F.concat(F.lit("(?"), F.replace(F.replace(flags.text(), F.lit("q"), F.lit("")), F.lit("g"), F.lit("")), F.lit(")"), p.text()))


@function("regex")
def regex(v: Value, p: Value, flags: Value | None = None) -> Value:
    return _bool(F.call_function("rlike", _string(v), _pattern(p, flags)))


@function("replace", "replace_all", "replaceall")
def replace(v: Value, p: Value, by: Value, flags: Value | None = None) -> Value:
    return _keep(v, F.regexp_replace(_string(v), _pattern(p, flags), by.text()))


@function("triple")
def triple(s: Value, p: Value, o: Value) -> Value:
    text = F.concat(F.lit("<<( "), nt(s.term()), F.lit(" <"), p.text(), F.lit("> "), nt(o.term()), F.lit(" )>>"))
    return Value("term", make(TRIPLE, text))


def parse_nt(text: Column) -> Column:
    """The term that N-Triples text writes; null for null."""
    literal = F.startswith(text, F.lit('"'))
    raw = F.regexp_extract(text, r'^"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    lex = F.when(F.contains(raw, F.lit("\\")), F.get(F.from_json(F.concat(F.lit('["'), F.replace(raw, F.lit("\\'"), F.lit("'")), F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"}), F.lit(0))).otherwise(raw)
    lang, way, dt = F.regexp_extract(text, r'"@([A-Za-z0-9-]+?)(--(?:ltr|rtl))?$', 1), F.regexp_extract(text, r'"@[A-Za-z0-9-]+?--(ltr|rtl)$', 1), F.regexp_extract(text, r'"\^\^<([^>]*)>$', 1)
    dt = F.when(way != "", F.lit(RDF.dirLangString)).when(lang != "", F.lit(RDF.langString)).when(dt != "", dt).otherwise(XSD.string)
    return (
        F.when(literal, make(LITERAL, lex, dt, lang, way))
        .when(F.startswith(text, F.lit("<<(")), make(TRIPLE, text))
        .when(F.startswith(text, F.lit("<")), make(IRI, F.regexp_extract(text, r"^<([^>]*)>", 1)))
        .when(F.startswith(text, F.lit("_:")), make(BNODE, F.substring(text, 3, 1 << 30)))
    )


def parts(v: Value) -> tuple[Value, Value, Value]:
    """Subject, predicate and object of quoted triples."""
    t = v.term()
    text = F.when(t["kind"] == TRIPLE, t["lex"])
    return Value("term", parse_nt(F.regexp_extract(text, QUOTED, 1))), Value("iri", F.regexp_extract(text, QUOTED, 2)), Value("term", parse_nt(F.regexp_extract(text, QUOTED, 3)))


for _n, _name in enumerate(("subject", "predicate", "object")):
    FUNCTIONS[_name] = lambda v, n=_n: parts(v)[n]


def _number(name: str, f: Callable[[Column], Column]) -> None:
    def run(v: Value) -> Value:
        return Value("num", f(v.num()), v.dt if v.form == "num" else F.when(v.rank() == 1, XSD.integer).when(v.rank() == 2, XSD.decimal).when(v.rank() == 3, XSD.float).otherwise(XSD.double))

    FUNCTIONS[name] = run


_number("abs", F.abs)
_number("neg", lambda c: -c)
_number("round", lambda c: F.floor(c + F.lit(0.5)).cast("double"))
_number("ceil", lambda c: F.ceil(c).cast("double"))
_number("floor", lambda c: F.floor(c).cast("double"))
for _name, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hours", F.hour), ("minutes", F.minute)):
    FUNCTIONS[_name] = lambda v, f=_f: _int(f(v.time()).cast("bigint"))
FUNCTIONS["seconds"] = lambda v: Value("num", F.second(v.time()).cast("double"), XSD.decimal)
FUNCTIONS["date"] = lambda v: Value("time", F.date_trunc("day", v.time()), XSD.date)
FUNCTIONS["time"] = lambda v: Value("term", make(LITERAL, F.date_format(v.time(), "HH:mm:ss"), XSD.time))
FUNCTIONS["datetime"] = lambda d, t: Value("time", F.concat(d.text(), F.lit("T"), t.text()).try_cast("timestamp"), XSD.dateTime)
_zone = lambda v: F.regexp_extract(v.text(), r"T.*?(Z|[+-]\d\d:\d\d)$", 1)
FUNCTIONS["tz"] = lambda v: _str(_zone(v))


@function("timezone")
def timezone(v: Value) -> Value:
    z = _zone(v)
    hours, minutes = F.regexp_extract(z, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(z, r":(\d\d)", 1).try_cast("int")
    text = F.concat(F.when(F.startswith(z, F.lit("-")), "-").otherwise(""), F.lit("PT"), hours.cast("string"), F.lit("H"), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return Value("term", make(LITERAL, F.when(z == "Z", "PT0S").when(z != "", text), XSD.dayTimeDuration))


def _same_form(values: tuple[Value, ...]) -> list[Value]:
    return list(values) if all(v.like(values[0]) for v in values) else [v.as_term() for v in values]


@function("coalesce")
def coalesce(*values: Value) -> Value:
    v = _same_form(values)
    return Value(v[0].form, F.coalesce(*(x.col for x in v)), v[0].dt, v[0].prefix)


@function("if")
def if_(test: Value, a: Value, b: Value) -> Value:
    x, y = _same_form((a, b))
    e = test.ebv()
    return Value(x.form, F.when(e, x.col).when(~e, y.col), x.dt, x.prefix)


@function("in")
def in_(v: Value, *options: Value) -> Value:
    out = F.lit(False)
    for o in options:
        out = out | equal(v, o)
    return _bool(out)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    x, y = a.num(), b.num()
    made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x.cast("double"), y.cast("double"))}[op]()
    return Value("num", made, promoted(a, b, op))


_CASTS = {XSD.string: "str", XSD.boolean: "_boolean", XSD.dateTime: "_datetime", XSD.date: "date", **{dt: f"_number {dt}" for dt in NUMERIC}}
FUNCTIONS["_boolean"] = lambda v: _bool(v.text().try_cast("boolean"))
FUNCTIONS["_datetime"] = lambda v: Value("time", v.text().try_cast("timestamp"), XSD.dateTime)
for _dt in NUMERIC:
    FUNCTIONS[f"_number {_dt}"] = lambda v, dt=_dt: Value("num", v.text().try_cast("double") if dt in (XSD.double, XSD.float, XSD.decimal) else v.text().try_cast("double").cast("bigint"), dt)
