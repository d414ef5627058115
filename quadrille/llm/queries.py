"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, ordinal, pii, quality, sharding, simhash, token_counts, token_ids, urlfilter
from .common import SPACE, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The path of the ranks of the byte-level BPE; set BPE_RANKS to use others."""
    return os.environ.get("BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def op1_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, d))


def op2_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return pii.spans(_docs(spark, d))


def op3_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return ordinal.score(docs, ordinal.train(docs, table(spark, d, "labels")))


def op4_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.score(_docs(spark, d), table(spark, d, "labels"))


def op5_token_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids.token_table(_docs(spark, d), vocabulary())


def op6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, d), vocabulary())


def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.occurrences(_docs(spark, d), table(spark, d, "benchmark"))


def op8_url_filters(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "expression string, action string")
    return urlfilter.match(table(spark, d, "pages"), rules)


def op9_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.plan(_docs(spark, d))


def op10_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sample(_docs(spark, d))


def queries() -> dict[str, Query]:
    found = {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

_OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT doc_id, word, CAST(floor(16 * sqrt(count(*))) AS BIGINT) AS k FROM w GROUP BY doc_id, word),
h AS (SELECT doc_id, k, md5(word) AS m FROM c),
x AS (SELECT doc_id, j, k, strpos('0123456789abcdef', substr(m, j, 1)) - 1 AS v FROM h, (SELECT unnest(range(1, 33)) AS j)),
n AS (SELECT doc_id, j,
  8 * CAST(sum(CASE WHEN v & 8 > 0 THEN k ELSE -k END) > 0 AS BIGINT) + 4 * CAST(sum(CASE WHEN v & 4 > 0 THEN k ELSE -k END) > 0 AS BIGINT)
  + 2 * CAST(sum(CASE WHEN v & 2 > 0 THEN k ELSE -k END) > 0 AS BIGINT) + CAST(sum(CASE WHEN v & 1 > 0 THEN k ELSE -k END) > 0 AS BIGINT) AS v
  FROM x GROUP BY doc_id, j),
e AS (SELECT doc_id, list_transform({_WORDS}, lambda y: CAST('0x' || substr(md5(y), 1, 8) AS BIGINT)) AS h FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g3 AS (SELECT doc_id, unnest(list_transform(range(1, greatest(2, len(h) - {simhash.SHINGLE - 2})), lambda i: (h[i] * {simhash.FACTORS[0]} + coalesce(h[i + 1], 0) * {simhash.FACTORS[1]} + coalesce(h[i + 2], 0) * {simhash.FACTORS[2]}) % {simhash.PRIME})) AS z
  FROM e WHERE len(h) > 0),
t AS (SELECT doc_id, (z * f) % {simhash.PRIME} AS z FROM g3, (SELECT unnest({list(simhash.TURNS)}) AS f)),
m AS (SELECT doc_id, z % {simhash.BINS} AS bin, min(z // {simhash.BINS}) & 1 AS bit FROM t GROUP BY doc_id, bin),
f AS (SELECT doc_id, j, arg_min(bit, (bin - j + {simhash.BINS}) % {simhash.BINS}) AS bit FROM m, (SELECT unnest(range({simhash.BINS})) AS j) GROUP BY doc_id, j),
q AS (SELECT doc_id, (j - 1) // 8 AS part, CAST(sum(v << (4 * (7 - (j - 1) % 8))) AS BIGINT) AS v FROM n GROUP BY doc_id, part
  UNION ALL SELECT doc_id, 4 + j // 32, CAST(sum(bit << (j % 32)) AS BIGINT) FROM f GROUP BY doc_id, j // 32),
s AS (SELECT d.doc_id, list_transform(range(8), lambda i: coalesce(list_extract(v, CAST(list_position(p, i) AS BIGINT)), 0)) AS b
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d LEFT JOIN (SELECT doc_id, list(part) AS p, list(v) AS v FROM q GROUP BY doc_id) USING (doc_id)),
p AS (SELECT x.doc_id AS u, y.doc_id AS v FROM s x JOIN s y ON x.doc_id <> y.doc_id
  AND bit_count(xor(x.b[1], y.b[1])) + bit_count(xor(x.b[2], y.b[2])) + bit_count(xor(x.b[3], y.b[3])) + bit_count(xor(x.b[4], y.b[4])) <= {simhash.MAX_BITS}
  AND bit_count(xor(x.b[5], y.b[5])) + bit_count(xor(x.b[6], y.b[6])) + bit_count(xor(x.b[7], y.b[7])) + bit_count(xor(x.b[8], y.b[8])) <= {simhash.MAX_SKETCH}),
r AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
g AS (SELECT u AS doc_id, min(v) AS group_id FROM r GROUP BY u)
SELECT d.doc_id, coalesce(g.group_id, d.doc_id) AS group_id, coalesce(g.group_id = d.doc_id, true) AS keep FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g USING (doc_id)
"""

_OP4 = rf"""
WITH t AS (SELECT row_number() OVER () AS n, documents.doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SPACE}+'), lambda x: x <> '') AS w, g.doc_id IS NOT NULL AS trusted
  FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality > 0 AND toxic <= 0) g ON documents.doc_id = g.doc_id),
h AS (SELECT n, trusted, list_transform(w, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM t),
c AS (SELECT n, trusted, unnest(h) % {quality.BUCKETS} AS cell FROM h UNION ALL
  SELECT n, trusted, unnest(list_transform(range(1, len(h)), lambda i: (h[i] * {quality.A} + h[i + 1] * {quality.B}) % {quality.BUCKETS})) FROM h),
k AS (SELECT cell, count(*) AS raw, count(*) FILTER (trusted) AS target FROM c GROUP BY cell),
s AS (SELECT sum(raw) + {quality.BUCKETS} AS raw, sum(target) + {quality.BUCKETS} AS target, sum(target) > 0 AS fit FROM k),
r AS (SELECT cell, CASE WHEN fit THEN ln((k.target + 1) / s.target) - ln((k.raw + 1) / s.raw) ELSE 0 END AS r FROM k, s),
m AS (SELECT n, round(avg(r), 6) + 0.0 AS score FROM c JOIN r USING (cell) GROUP BY n)
SELECT doc_id, coalesce(score, 0.0) AS score, coalesce(score, 0.0) >= {quality.LEAST} AS keep FROM t LEFT JOIN m USING (n)
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[k:k + {decontaminate.WORDS - 1}], ' ') || ' ' AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {decontaminate.WORDS - 2}))) AS k FROM i WHERE len(w) > 0))
SELECT doc_id, item_id, count(*) AS n_windows FROM d JOIN s ON contains(d.t, s.s) GROUP BY doc_id, item_id
"""

_RULES = ", ".join(f"('{e}', '{a}')" for e, a in urlfilter.RULES)
_REST = r"regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_OP8 = rf"""
WITH rules(expression, action) AS (VALUES {_RULES}),
u AS (SELECT DISTINCT url,
  regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract({_REST}, '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^\.+|\.+$', '', 'g') AS h,
  regexp_extract({_REST}, '^[^/?#]*([^#]*)', 1) AS q FROM pages WHERE url IS NOT NULL),
v AS (SELECT url, h, string_split(h, '.') AS l, CASE WHEN starts_with(q, '/') THEN q ELSE '/' || q END AS p FROM u WHERE h <> ''),
hs AS (SELECT url, h AS s FROM v UNION
  SELECT url, array_to_string(l[i:], '.') FROM (SELECT url, l, unnest(range(2, greatest(2, len(l)))) AS i FROM v WHERE NOT regexp_matches(h, '^[0-9.]+$') AND NOT contains(h, ':'))),
ps AS (SELECT url, p FROM v UNION SELECT url, regexp_replace(p, '\?.*$', '') FROM v UNION
  SELECT url, array_to_string(c[1:i], '/') || '/' FROM (SELECT url, c, unnest(range(1, len(c))) AS i FROM (SELECT url, string_split(regexp_replace(p, '\?.*$', ''), '/') AS c FROM v))),
m AS (SELECT hs.url, action, expression, row_number() OVER (PARTITION BY hs.url ORDER BY length(s) DESC, length(s || p) DESC, action) AS n
  FROM hs JOIN ps ON hs.url = ps.url JOIN rules ON expression = s || p)
SELECT page_id, pages.url, coalesce(action, 'allow') AS action, expression AS rule FROM pages LEFT JOIN m ON pages.url = m.url AND n = 1
"""


def shards_sql(rows: str, shards: int) -> str:
    """CTEs that end in placed(doc_id, n_chars, shard_id); rows is a query of (doc_id, size), a row for each atomic group. The smallest capacity is found by dynamic programming over all cuts."""
    return rf"""
g AS ({rows}),
o AS (SELECT doc_id, size, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS i, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p FROM g),
z AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS p UNION ALL SELECT i, p FROM o),
runs AS (SELECT DISTINCT b.p - a.p AS c FROM z a JOIN z b ON a.i < b.i, (SELECT max(size) AS m, sum(size) AS t FROM o) q WHERE b.p - a.p BETWEEN greatest(m, t / {shards}) AND m + ceil(t / {shards})),
f AS (SELECT c, CAST(0 AS BIGINT) AS base, 0 AS k FROM runs UNION ALL
  SELECT c, (SELECT max(p) FROM o WHERE o.p <= f.base + f.c), k + 1 FROM f WHERE k < {shards} AND base < (SELECT max(p) FROM o)),
best AS (SELECT min(c) AS c FROM f WHERE base = (SELECT max(p) FROM o)),
cut AS (SELECT base, row_number() OVER (ORDER BY k) - 1 AS s FROM f JOIN best USING (c) WHERE k > 0),
placed AS (SELECT doc_id, CAST(size AS BIGINT) AS n_chars, CAST((SELECT count(*) FROM cut WHERE cut.base < o.p) AS INTEGER) AS shard_id FROM o)"""


_OP9 = f"WITH RECURSIVE {shards_sql('SELECT doc_id, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY doc_id', sharding.SHARDS)} SELECT * FROM placed"

_OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS src, text FROM documents),
s AS (SELECT src, CAST(sum(coalesce(length(text), 0)) AS HUGEINT) AS size FROM d GROUP BY src),
w AS (SELECT *, CAST(floor(sqrt(CAST(size AS DOUBLE))) AS HUGEINT) AS w FROM s),
r AS (SELECT src, CASE WHEN size = 0 OR (SELECT sum(w) FROM w) = 0 THEN {mixing.UNIT} ELSE
  CAST((w * (SELECT CAST(sum(size) AS HUGEINT) FROM w) * {mixing.UNIT}) // ((SELECT CAST(sum(w) AS HUGEINT) FROM w) * size) AS BIGINT) END AS r,
  CAST('0x' || substr(md5('{mixing.SEED}:' || src), 1, 8) AS BIGINT) % {mixing.UNIT} AS u FROM w),
p AS (SELECT doc_id, source, u, r, CAST(sum(r) OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, length(text) NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM d JOIN r USING (src)),
c AS (SELECT doc_id, source, (e + u) // {mixing.UNIT} - (e - r + u) // {mixing.UNIT} AS n FROM p)
SELECT doc_id, source, unnest(range(1, n + 1)) AS copy FROM c WHERE n > 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_simhash_near_dedup": _OP1, "op4_quality_rules": _OP4, "op7_decontamination": _OP7, "op8_url_filters": _OP8, "op9_sharding": _OP9, "op10_source_mixing": _OP10}
