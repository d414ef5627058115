"""URL filter lists by hashed expressions.

A rule is an expression ``host/path`` with an action. Each URL is expanded into
suffixes of its host (whole host down to two labels; an IP address only whole) and
prefixes of its path (with the query, without it, then each directory up to "/").
Of these only those that some rule could equal are made: host suffixes of as many
labels as a rule's host has are equi-joined with the hosts of the rules first, and
the directories are then those of a depth that a rule of that host has. So a URL
costs its length times the depths of the rules it meets, never the square of its
length. The first 4 bytes of the expressions' SHA-256 are equi-joined with those of
the rules, the full digests then confirm, and of the rules that match the one with
the longest host decides, then the longest path, then "allow" over "block".

Canonical form: scheme, credentials, port and fragment go; the host is in lower
case without dots at its ends; an empty path is "/". The expressions are made
by built-in functions only, so the plan holds no Python.

Defined results. A null, empty or hostless URL matches no rule and is allowed
with a null rule. Each row is judged on its own, repeated rows and null page_ids
too. Duplicate rules count once; rules with a null expression or an action other
than allow or block are ignored. An empty rule list allows everything. Extra
columns, also ones named like those added, don't matter: only page_id and url
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The list in production here: (expression, action).
RULES = [
    ("spam-farm.example.org/", "block"), ("cheap-pills.example.com/", "block"), ("casino-win.example.org/", "block"),
    ("free-bets.example.com/", "block"), ("ads-track.example.org/", "block"), ("cheap-pills.example.com/en/", "allow"),
    ("m.free-bets.example.com/", "allow"), ("m.free-bets.example.com/de/", "block"), ("example.net/es/", "block"),
]


def host(url: Column) -> Column:
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.btrim(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")), F.lit("."))


def path(url: Column) -> Column:
    """Path and query, without the fragment."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    got = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.when(F.startswith(got, F.lit("/")), got).otherwise(F.concat(F.lit("/"), got))


def host_suffixes(h: Column, labels: list[int]) -> Column:
    """The whole host and its suffixes of so many labels."""
    several = [F.when(F.size(F.split(h, r"\.", -1)) > k, F.substring_index(h, ".", -k)) for k in labels if k > 1]
    bare = h.rlike(r"^[0-9.]+$") | h.contains(":")
    return F.when(bare, F.array(h)).otherwise(F.array_compact(F.array(h, *several)))


def path_prefixes(p: Column, depths: Column) -> Column:
    """The path with and without its query, and its directories of the depths given; "/" has depth 1."""
    plain = F.substring_index(p, "?", 1)
    deepest = F.length(plain) - F.length(F.replace(plain, F.lit("/")))
    dirs = F.transform(F.filter(depths, lambda d: d <= deepest), lambda d: F.concat(F.call_function("substring_index", plain, F.lit("/"), d), F.lit("/")))
    return F.array_distinct(F.concat(F.array(p, plain), dirs))


def _digest(c: Column) -> Column:
    return F.sha2(c, 256)


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, action, rule) of each row; rule is the expression that decided, null if none matched."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    known = rules.select(F.col("expression").cast("string").alias("expression"), F.col("action").cast("string").alias("action"))
    known = known.where("expression IS NOT NULL AND action IN ('allow', 'block')").distinct()
    known = known.select("expression", "action", _digest(F.col("expression")).alias("digest")).withColumn("prefix", F.substring("digest", 1, 8))
    at = known.select(F.substring_index("expression", "/", 1).alias("host"), F.expr("substr(expression, length(substring_index(expression, '/', 1)) + 1)").alias("path"))
    depth = F.when(F.endswith("path", F.lit("/")), F.length("path") - F.length(F.replace("path", F.lit("/"))))
    # a row for each host with rules; its depths and, over all of them, the numbers of labels are few
    hosts = at.groupBy("host").agg(F.collect_set(depth).alias("depths")).withColumn("host_digest", _digest(F.col("host"))).withColumn("host_prefix", F.substring("host_digest", 1, 8))
    labels = sorted(r.n for r in hosts.select(F.size(F.split("host", r"\.", -1)).alias("n")).distinct().collect())
    # distinct URLs are looked up once, however many rows have them
    urls = rows.where("url IS NOT NULL").select("url").distinct().select("url", host(F.col("url")).alias("h"), path(F.col("url")).alias("p")).where("h <> ''")
    made = urls.select("url", "p", F.explode(host_suffixes(F.col("h"), labels)).alias("hs")).withColumn("full", _digest(F.col("hs"))).withColumn("host_prefix", F.substring("full", 1, 8))
    made = made.join(hosts.drop("host"), "host_prefix").where("full = host_digest").select("url", "hs", path_prefixes(F.col("p"), F.col("depths")).alias("ps"))
    made = made.select("url", F.length("hs").alias("hl"), F.explode(F.transform("ps", lambda p: F.concat("hs", p))).alias("e"))
    made = made.select("url", "hl", F.length("e").alias("el"), _digest(F.col("e")).alias("full")).withColumn("prefix", F.substring("full", 1, 8))
    hits = made.join(known, "prefix").where("full = digest")
    best = F.struct("hl", "el", (F.col("action") == "allow").alias("allow"))
    decided = hits.groupBy("url").agg(F.max_by(F.struct("action", "expression"), best).alias("d"))
    return rows.join(decided, "url", "left").select("page_id", "url", F.coalesce("d.action", F.lit("allow")).alias("action"), F.col("d.expression").alias("rule"))
