"""Benchmark decontamination by Wu-Manber multi-pattern search.

Documents and benchmark items are normalised to their words in lower case with
one space around each. An item's test strings are its windows of ``words``
consecutive words, at every word (the whole item if it has fewer words; an item
without a word has none). The scanner looks at the last BLOCK characters of a
window of ``m`` characters, m being the length of the shortest test string. A
shift table maps each block that occurs in the first m characters of a test
string to the distance by which the window may move without missing one; any
other block moves it past the block at once. At a shift of zero the suffix
hash bucket gives the test strings that may end there, and a direct comparison
with the text confirms each.

The test strings are made and made distinct by a job of their own. They travel to
the executors in parts of about PART characters, cut by a hash of the string, one
scan of the documents for each part: what is sent has a bound, and every string is
looked for once, with all items that own it, so the parts never change a count.

Defined results. Null and empty texts, and null or empty items, match nothing.
occurrences() has a row for each doc_id and item_id that meet: rows that share a
doc_id (or have none) are searched one by one and their counts added up; rows
that share an item_id (or have none) are one item, whose test strings are those
of all of them, each counted once. Items with the same test string are all
reported. decontaminate() judges each row on its own. An empty table on either
side gives no rows of occurrences. doc_id and item_id must be whole numbers or
strings of one. Other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, forget, fresh, written

WORDS, BLOCK = 13, 8
#: Characters of test strings in one part, about.
PART = 1 << 26


def normal(text: str) -> str:
    return f" {' '.join(WORD.findall(text.lower()))} "


def test_strings(text: str, words: int = WORDS) -> set[str]:
    w = normal(text).split()
    return {f" {' '.join(w[i : i + words])} " for i in range(max(1, len(w) - words + 1))} if w else set()


class WuManber:
    """Finds which of the patterns occur in a text."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = b = min(BLOCK, m)
        self.shift: dict[str, int] = {}
        self.buckets: dict[str, list[int]] = defaultdict(list)
        for n, p in enumerate(patterns):
            for end in range(b, m + 1):
                key = p[end - b : end]
                if self.shift.get(key, m) > m - end:
                    self.shift[key] = m - end
            self.buckets[p[m - b : m]].append(n)
        self.skip = m - b + 1

    def find(self, text: str) -> set[int]:
        shift, buckets, patterns, m, b, skip, found = self.shift.get, self.buckets, self.patterns, self.m, self.block, self.skip, set()
        at, end = m, len(text)
        while at <= end:
            step = shift(text[at - b : at], skip)
            if step:
                at += step
                continue
            for n in buckets[text[at - b : at]]:
                if n not in found and text.startswith(patterns[n], at - m):
                    found.add(n)
            at += 1
        return found


def _windows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted(test_strings(t, words))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array(own, pa.string())], ["i", "s"])

    return run


def parts(benchmark: DataFrame, words: int = WORDS, part: int = PART) -> Iterator[list[tuple[int | None, str]]]:
    """(item, test string), a bounded number of characters at a time; all items of a string are in one part."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL")
    strings = written(items.mapInArrow(_windows(words), "i long, s string").distinct(), "strings")
    n = -(-int(strings.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0]) // part)
    for k in range(n):
        rows = strings.where(F.pmod(F.xxhash64("s"), F.lit(n)) == k).collect()
        if rows:
            yield [tuple(r) for r in rows]
    forget(strings)


def _scanner(spark: SparkSession, found: list[tuple[int | None, str]]):
    owners: dict[str, set[int | None]] = defaultdict(set)
    for i, s in found:
        owners[s].add(i)
    strings = sorted(owners)
    sent = spark.sparkContext.broadcast((strings, [sorted(owners[s], key=lambda i: (i is None, i)) for s in strings]))
    made: list[WuManber] = []

    def find(text: str | None) -> dict[int | None, int]:
        """How many test strings of each item occur in the text."""
        if not made:
            made.append(WuManber(sent.value[0]))
        hits: dict[int | None, int] = defaultdict(int)
        if text:
            for n in made[0].find(normal(text)):
                for i in sent.value[1][n]:
                    hits[i] += 1
        return hits

    return find


def _hit(find):
    @F.pandas_udf("boolean")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bool(find(t)) for t in texts], dtype=bool)

    return hit


def occurrences(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, part: int = PART) -> DataFrame:
    """(doc_id, item_id, n_windows) for each document and each item of which it holds test strings; n_windows counts those."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long")
    for found in parts(benchmark, words, part):
        find = _scanner(docs.sparkSession, found)

        def run(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(d, i, n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, n in find(t).items()]
                cols = list(zip(*got)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_windows"])

        out = out.union(rows.mapInArrow(run, "doc_id long, item_id long, n_windows long"))
    return out.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, part: int = PART) -> DataFrame:
    """The rows of docs that hold no test string of any item, with all their columns."""
    (mark,) = fresh(docs, "contaminated")
    for found in parts(benchmark, words, part):
        find = _scanner(docs.sparkSession, found)
        docs = docs.withColumn(mark, _hit(find)(F.col("text").cast("string"))).where(~F.col(mark)).drop(mark)
    return docs
