"""Personal data and secrets by weak supervision.

Loose patterns find candidate spans in whole texts (whatever holds an "@" or a
digit in a shape worth a look, version numbers too, or follows the name of a key). Labelers vote on each, +1
personal, -1 not, 0 no opinion:

* regex: the strict form of its kind (address with a domain, four octets, a
  grouped phone number, 13 to 19 digits, a long key of letters and digits);
* gazetteer: country calling codes, top-level domains, card issuers' prefixes,
  special-use address blocks, prefixes and names of keys;
* context: words such as mail, call, card, token before the span, or version,
  license, page and the like;
* border: what touches the span on either side;
* size: the number of digits and characters its kind has (at most 80 characters of
  an address or a key);
* mix: variety of its characters (no single repeated digit, no mere sequence).

Expectation-maximisation over the votes of all candidates (the counts of vote
patterns, of which there are few, hold everything it needs) estimates for each
kind how common true spans are and for each labeler how often it votes each way
on true and on false ones. The resulting posteriors train the span classifier, a
logistic regression over features of the span itself (kind, length, digits,
separators, the characters beside it, the kind of word before it), fitted to
the counts of all distinct feature sets; it, not the votes, decides: spans with
a probability of at least LEAST are returned.

Labelers and classifier see the whole span, 24 characters before it and 2 after it.
Patterns never cross a line. Every search takes time in proportion to the text.

Defined results. Null and empty texts have no span. Each row is searched on its
own, repeated ones too; null doc_ids are handed on. Where candidates overlap,
the first found by the order of the patterns stays. Without a candidate there
are no rows. Offsets count characters from 0, the end is exclusive. Other
columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LEAST, ROUNDS, STEPS = 0.5, 60, 400
LABELERS = ("regex", "gazetteer", "context", "border", "size", "mix")

#: A key after its name, digits or not.
_LABELLED = re.compile(r"(?:token|secret|passw(?:or)?d|passphrase|pwd|key)[\"']?[ \t]*(?:[:=]|\bis\b)[ \t]*[\"']?(?P<span>[A-Za-z0-9_+/-]{16,}={0,2})(?![A-Za-z0-9_])", re.I)
_NAMES = ("token", "secret", "passw", "passphrase", "pwd", "key")
_DOMAIN, _LOCAL = re.compile(r"@[\w-]+(?:\.[\w-]+)*"), re.compile(r"[\w.+%-]*")
_RUN, _DIGIT, _LETTER = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_])"), re.compile("[0-9]"), re.compile("[A-Za-z]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    r"""What ``[\w.+%-]+@[\w-]+(?:\.[\w-]+)*`` matches, found from the "@" on: a long run without one is read once."""
    if "@" not in text:
        return
    back, n, end = text[::-1], len(text), 0
    for m in _DOMAIN.finditer(text):
        start = n - _LOCAL.match(back, n - m.start(), n - end).end()
        if start < m.start():
            end = m.end()
            yield start, start + len(text[start:end].rstrip(".-"))


def _keys(text: str) -> Iterator[tuple[int, int]]:
    """Runs of 16 or more of a key's characters with a digit and a letter, and up to two "="."""
    for m in _RUN.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]):
            yield m.span()


def _named_keys(text: str) -> Iterator[tuple[int, int]]:
    if _named(text):
        for m in _LABELLED.finditer(text):
            yield m.span("span")


def _spans(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    find = re.compile(pattern).finditer
    return lambda text: (m.span() for m in find(text))


#: Loose finders in the order of precedence.
_LOOSE = [
    ("email", _emails),
    ("secret", _keys),
    ("secret", _named_keys),
    ("phone", _spans(r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4})?(?![\w])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![\w])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w])|(?<![\w.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("card", _spans(r"(?<![\w.-])[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?(?![\w-])|(?<![\w.-])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![\w-])")),
    ("ip", _spans(r"(?<![\w.-])[0-9]+(?:\.[0-9]+)+(?![\w-])")),
    ("national_id", _spans(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("card", _spans(r"(?<![\w.-])[0-9]+(?![\w-])(?!\.[0-9])")),
]
KINDS = ("card", "email", "ip", "national_id", "phone", "secret")
_STRICT = {
    "secret": re.compile(r"(?:[0-9A-Fa-f]{16,}|AKIA[0-9A-Z]{16}|(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/-]{20,}={0,2}|(?=.*[a-z])(?=.+[A-Z])[A-Za-z_+/-]{20,}={0,2})"),
    "email": re.compile(r"[A-Za-zÀ-ÿ0-9][\wÀ-ÿ.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "phone": re.compile(r"\+?[0-9]{0,3} ?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{2,4}"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"),
    "national_id": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
}
_TLDS = set(
    "com org net edu gov mil int io info biz name pro app dev ai co me tv cc xyz online site shop tech cloud blog "
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cd cf cg ch ci ck cl cm cn cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu "
    "id ie il im in iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw "
    "sa sb sc sd se sg sh si sk sl sm sn so sr ss st sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "421"}
_NEAR = re.compile(r"(mail|phone|tel|call|fax|mobile|card|visa|credit|address|\bip\b|host|server|token|secret|passw|pwd|\bkey|api|ssn|social|account)\W*(?:is|no|number|=|:)?\W*$", re.I)
_AWAY = re.compile(r"(version|licen[sc]e|\bv|page|chapter|section|figure|fig|table|vol|no|release|by(?:-[a-z]+)*|isbn|year)\W*$", re.I)
_SIZES = {"secret": (16, 80, 2), "email": (8, 80, 0), "phone": (9, 24, 8), "card": (13, 23, 13), "ip": (7, 15, 4), "national_id": (11, 11, 9)}


def _gazetteer(kind: str, span: str, left: str) -> int:
    if kind == "email":
        return 1 if span.rpartition(".")[2].lower() in _TLDS else -1
    if kind == "phone":
        code = re.match(r"\+([0-9]{1,3})", span)
        return (1 if any(code[1][:n] in _CODES for n in (1, 2, 3)) else -1) if code else 0
    if kind == "card":
        return 1 if len(span) >= 13 and span[0] in "3456" else (-1 if len(span) < 12 else 0)
    if kind == "ip":
        head = span.split(".")
        return -1 if len(head) != 4 or head[0] in ("0", "127", "255") or span.startswith(("192.0.2.", "198.51.100.", "203.0.113.")) else 0
    if kind == "secret":
        return 1 if span.startswith(("AKIA", "ASIA", "ghp_", "sk-", "xox", "eyJ")) or re.search(r"(token|secret|passw\w*|pwd|key)\W*$", left, re.I) else 0
    return 0


def _mix(kind: str, span: str) -> int:
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        return 0
    if len(digits) >= 4 and (len(set(digits)) < 3 or digits in "01234567890123456789"):
        return -1
    return 1 if len(set(span)) >= 5 else -1


def votes(kind: str, span: str, left: str, right: str) -> list[int]:
    """Each labeler's vote; left and right are what stands beside the span."""
    low, high, least = _SIZES[kind]
    digits = sum(map(str.isdigit, span))
    context = 1 if _NEAR.search(left) else -1 if _AWAY.search(left) else 0
    border = -1 if left[-1:].isalnum() or right[:1].isalnum() or (right[:1] == "." and right[1:2].isdigit()) else 1
    return [1 if _STRICT[kind].fullmatch(span) else -1, _gazetteer(kind, span, left), context, border, 1 if low <= len(span) <= high and digits >= least else -1, _mix(kind, span)]


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3 if c in "\"'=:([<" else 4


#: The width of each feature; the first is the kind.
_WIDTHS = (len(KINDS), 8, 8, 5, 5, 5, 3, 3)
_STARTS = np.r_[0, np.cumsum(_WIDTHS)]


def features(kind: str, span: str, left: str, right: str) -> list[int]:
    """Cells of the span's features, one each."""
    digits = sum(map(str.isdigit, span))
    separators = sum(not c.isalnum() for c in span)
    context = 1 if _NEAR.search(left) else 2 if _AWAY.search(left) else 0
    shape = 2 if span.isdigit() else 1 if any(map(str.isalpha, span)) else 0
    values = (KINDS.index(kind), min(7, len(span) // 4), min(7, digits // 3), min(4, separators), _side(left[-1:]), _side(right[:1]), context, shape)
    return [int(s + v) for s, v in zip(_STARTS, values)]


def _named(text: str) -> bool:
    low = text.lower()
    return any(n in low for n in _NAMES)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each candidate of a text, without overlaps."""
    found: list[tuple[str, int, int]] = []
    taken = np.zeros(0, bool)
    for kind, find in _LOOSE:
        for a, b in find(text):
            if not len(taken):
                taken = np.zeros(len(text), bool)
            if not taken[a:b].any():
                taken[a:b] = True
                found.append((kind, a, b))
    return sorted(found, key=lambda x: x[1])


_LOOK = re.compile(r"[0-9@]")
_SCHEMA = "doc_id long, kind string, span_start int, span_end int, span string, votes array<int>, cells array<int>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            labelled = bool(text) and _named(text) and bool(_LABELLED.search(text))
            if not text or not labelled and not _LOOK.search(text):
                continue
            at = -1
            for own in text.split("\n"):  # no pattern crosses a line
                at, start = at + len(own) + 1, at + 1
                if not labelled and not _LOOK.search(own):
                    continue
                for kind, a, b in candidates(own):
                    span, left, right = own[a:b], own[max(0, a - 24) : a], own[b : b + 2]
                    out.append((doc, kind, start + a, start + b, span, votes(kind, span, left, right), features(kind, span, left, right)))
        cols = list(zip(*out)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "kind", "span_start", "span_end", "span", "votes", "cells"])


def estimate(kinds: np.ndarray, votes_: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """By EM: the posterior of each vote pattern, and reliability[labeler, truth, vote + 1]."""
    n, k = votes_.shape
    p = np.clip(0.5 + votes_.sum(1) / (2 * k), 0.02, 0.98)
    rate = np.zeros((k, 2, 3))
    for _ in range(rounds):
        for j in range(k):
            for v in range(3):
                hit = votes_[:, j] == v - 1
                rate[j, 1, v], rate[j, 0, v] = (counts * p)[hit].sum() + 1, (counts * (1 - p))[hit].sum() + 1
        rate /= rate.sum(2, keepdims=True)
        prior = np.array([((counts * p)[kinds == x].sum() + 1) / (counts[kinds == x].sum() + 2) for x in range(kinds.max() + 1)])[kinds]
        logit = np.log(prior / (1 - prior)) + sum(np.log(rate[j, 1, votes_[:, j] + 1] / rate[j, 0, votes_[:, j] + 1]) for j in range(k))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, rate


def train(cells: np.ndarray, target: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of the cells, by gradient steps on the expected log loss with a light ridge."""
    w, m, v = np.zeros(_STARTS[-1]), np.zeros(_STARTS[-1]), np.zeros(_STARTS[-1])
    share = counts / counts.sum()
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-w[cells].sum(1)))
        g = np.bincount(cells.ravel(), np.repeat(share * (p - target), cells.shape[1]), len(w)) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return w


def spans(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, kind, span_start, span_end, span, probability) of each span found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text RLIKE '[0-9@]|(?i:token|secret|passw|passphrase|pwd|key)'")
    found = written(rows.mapInArrow(_find, _SCHEMA), "candidates")
    # distinct patterns: at most 3^6 votes for as many sets of cells as occur, both bounded by design
    table = found.groupBy("votes", "cells").count().toPandas()
    out = found.select("doc_id", "kind", "span_start", "span_end", "span", "cells")
    if not len(table):
        return out.select("doc_id", "kind", "span_start", "span_end", "span", F.lit(0.0).alias("probability"))
    table = table.assign(order=[(tuple(a), tuple(b)) for a, b in zip(table["votes"], table["cells"])]).sort_values("order")
    cells, vote, counts = np.array(table["cells"].tolist()), np.array(table["votes"].tolist()), table["count"].to_numpy(float)
    posterior, _ = estimate(cells[:, 0], vote, counts)
    weights = F.array(*(F.lit(round(float(x), 9)) for x in train(cells, posterior, counts)))
    logit = F.aggregate("cells", F.lit(0.0), lambda s, c: s + F.get(weights, c))
    out = out.withColumn("probability", F.round(1 / (1 + F.exp(-logit)), 6)).where(F.col("probability") >= least)
    return out.drop("cells")
