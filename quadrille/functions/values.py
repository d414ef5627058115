"""Columns that know which terms they hold.

A Value is a column with a static form. Where the form is known (a number of one
datatype, IRIs of one template, strings) joins, filters and aggregates work on
the native column, so Catalyst sees plain table columns; only mixed columns carry
the term struct.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import BNODE, IRI, LITERAL, TERM, Term, instant, lit, make, number
from ..vocab import INTEGERS, NUMERIC, XSD

TIMES = (XSD.dateTime, XSD.date, XSD.dateTimeStamp)
_RANK = {**dict.fromkeys(INTEGERS, 1), XSD.decimal: 2, XSD.float: 3, XSD.double: 4}
_BY_RANK = {1: XSD.integer, 2: XSD.decimal, 3: XSD.float, 4: XSD.double}


def lexical(col: Column, dt: Any) -> Column:
    whole, plain = col.cast("bigint").cast("string"), F.regexp_replace(F.regexp_replace(col.try_cast("decimal(38,10)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    if isinstance(dt, str):
        return whole if dt in INTEGERS else plain if dt == XSD.decimal else col.cast("string")
    return F.when(dt.isin(*INTEGERS), whole).when(dt == XSD.decimal, plain).otherwise(col.cast("string"))


@dataclass(frozen=True)
class Value:
    """form: term, iri, bnode, num, str, bool or time; dt: of num and time; prefix: an IRI is the prefix and the column."""

    form: str
    col: Column
    dt: Any = ""
    prefix: str = ""

    def at(self, name: str) -> "Value":
        return Value(self.form, F.col(name), self.dt, self.prefix)

    def like(self, other: "Value") -> bool:
        return isinstance(self.dt, str) and isinstance(other.dt, str) and (self.form, self.dt, self.prefix) == (other.form, other.dt, other.prefix)

    def text(self) -> Column:
        """The IRI, label or lexical form."""
        if self.form == "term":
            return self.col["lex"]
        if self.form == "iri":
            return F.concat(F.lit(self.prefix), self.col.cast("string")) if self.prefix else self.col
        if self.form == "num":
            return lexical(self.col, self.dt)
        if self.form == "time":
            return self.col.cast("date").cast("string") if self.dt == XSD.date else F.replace(self.col.cast("string"), F.lit(" "), F.lit("T"))
        return self.col.cast("string")

    def term(self) -> Column:
        if self.form == "term":
            return self.col
        kind = {"iri": IRI, "bnode": BNODE}.get(self.form, LITERAL)
        dt = {"iri": "", "bnode": "", "str": XSD.string, "bool": XSD.boolean}.get(self.form, self.dt)
        return make(kind, self.text(), dt)

    def as_term(self) -> "Value":
        return Value("term", self.term())

    def native(self) -> Column:
        """A plain column: the value of a literal of known type, else the text."""
        return self.col if self.form in ("num", "str", "bool", "time") else self.text()

    def num(self) -> Column:
        if self.form == "num":
            return self.col
        return number(self.col) if self.form == "term" else F.lit(None).cast("double")

    def time(self) -> Column:
        if self.form == "time":
            return self.col
        return instant(self.col) if self.form == "term" else F.lit(None).cast("timestamp")

    def rank(self) -> Column:
        if self.form == "num" and isinstance(self.dt, str):
            return F.lit(_RANK[self.dt])
        dt = self.dt if self.form == "num" else self.col["dt"]
        return F.when(dt.isin(*INTEGERS), 1).when(dt == XSD.decimal, 2).when(dt == XSD.float, 3).otherwise(4)

    def kind(self) -> Column:
        return self.col["kind"] if self.form == "term" else F.when(self.col.isNotNull(), F.lit({"iri": IRI, "bnode": BNODE}.get(self.form, LITERAL)))

    def datatype(self) -> Column:
        if self.form == "term":
            return F.when(self.col["kind"] == LITERAL, self.col["dt"])
        dt = {"iri": None, "bnode": None, "str": XSD.string, "bool": XSD.boolean}.get(self.form, self.dt)
        return F.when(self.col.isNotNull(), dt if isinstance(dt, Column) else F.lit(dt).cast("string"))

    def ebv(self) -> Column:
        """The effective boolean value; null for an error."""
        if self.form == "bool":
            return self.col
        if self.form == "str":
            return F.length(self.col) > 0
        if self.form == "num":
            return (self.col != 0) & ~F.isnan(self.col.cast("double"))
        if self.form != "term":
            return F.lit(None).cast("boolean")
        t = self.col
        n = number(t)
        plain = t["dt"].isin("", XSD.string) | (t["lang"] != "")
        got = F.when(t["dt"] == XSD.boolean, t["lex"].isin("true", "1")).when(t["dt"].isin(*NUMERIC), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))).when(plain, F.length(t["lex"]) > 0)
        return F.when(t["kind"] == LITERAL, got)


def constant(t: Term | None) -> Value:
    if t is None:
        return Value("term", F.lit(None).cast(TERM))
    if t.kind == IRI:
        return Value("iri", F.lit(t.lex))
    if t.kind == LITERAL and not t.lang:
        try:
            if t.dt in INTEGERS:
                return Value("num", F.lit(int(t.lex)), t.dt)
            if t.dt in NUMERIC:
                return Value("num", F.lit(float(t.lex)), t.dt)
        except ValueError:
            return Value("term", lit(t))
        if t.dt == XSD.string:
            return Value("str", F.lit(t.lex))
        if t.dt == XSD.boolean:
            return Value("bool", F.lit(t.lex in ("true", "1")))
        if t.dt in TIMES:
            return Value("time", F.lit(t.lex).try_cast("timestamp"), t.dt)
    return Value("term", lit(t))


def matches(value: Value, t: Term) -> Column:
    """Whether the value is that term: a filter on the native column, so that it can be pushed down."""
    if value.form == "iri":
        rest = t.lex.removeprefix(value.prefix)
        if t.kind != IRI or not t.lex.startswith(value.prefix):
            return F.lit(False)
        return value.col == F.lit(int(rest) if value.dt == "key" and rest.isdigit() else rest)
    if value.form == "term":
        c = value.col
        return (c["lex"] == t.lex) & (c["kind"] == t.kind) & (c["dt"] == t.dt) & (c["lang"] == t.lang) & (c["dir"] == t.dir)
    if t.kind != LITERAL or t.lang or value.form == "bnode":
        return F.lit(False)
    own = constant(t)
    return value.col == own.col if own.like(value) else F.lit(False)


def promoted(a: Value, b: Value, op: str = "") -> Any:
    """The datatype of arithmetic on both."""
    if a.form == b.form == "num" and isinstance(a.dt, str) and isinstance(b.dt, str):
        r = max(_RANK[a.dt], _RANK[b.dt])
        return _BY_RANK[2 if op == "/" and r == 1 else r]
    r = F.greatest(a.rank(), b.rank())
    if op == "/":
        r = F.greatest(r, F.lit(2))
    return F.when(r == 1, XSD.integer).when(r == 2, XSD.decimal).when(r == 3, XSD.float).otherwise(XSD.double)


def equal(a: Value, b: Value) -> Column:
    """The language's =; null where the comparison is an error."""
    if a.form == b.form == "iri" and a.prefix != b.prefix:
        return a.text() == b.text()
    if a.form == b.form and a.form != "term":
        return a.col == b.col
    if "term" not in (a.form, b.form):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    x, y = a.term(), b.term()
    literals = (x["kind"] == LITERAL) & (y["kind"] == LITERAL)
    known = lambda t: t["dt"].isin("", XSD.string, XSD.boolean) | (t["lang"] != "")
    return F.coalesce(a.num() == b.num(), a.time() == b.time(), F.when(x == y, True).when(~literals | (known(x) & known(y)), F.when(x.isNotNull() & y.isNotNull(), F.lit(False))))


def less(a: Value, b: Value, strict: bool = True) -> Column:
    """a < b or a <= b by value; null where incomparable."""
    cmp = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    if a.form == b.form and a.form in ("num", "str", "time", "bool"):
        return cmp(a.col, b.col)
    if "term" not in (a.form, b.form):
        return F.lit(None).cast("boolean")
    x, y = a.term(), b.term()
    text = lambda t: F.when((t["kind"] == LITERAL) & (t["dt"].isin("", XSD.string, XSD.boolean)), t["lex"])
    return F.coalesce(cmp(a.num(), b.num()), cmp(a.time(), b.time()), F.when(x["dt"] == y["dt"], cmp(text(x), text(y))))


def order_key(v: Value) -> list[Column]:
    """Unbound, blank node, IRI, literal; then by value; ties by the whole term."""
    if v.form != "term":
        return [v.col if v.form != "iri" else v.text()]
    t = v.col
    rank = F.when(t.isNull(), 0).when(t["kind"] == BNODE, 1).when(t["kind"] == IRI, 2).otherwise(3)
    return [rank, number(t), instant(t), t["lex"], t["dt"], t["lang"]]
