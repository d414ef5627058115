"""Quality by the log-likelihood ratio of hashed n-grams.

Two multinomials over BUCKETS cells are counted: the raw one over all
documents, the target one over the trusted (labelled good quality and not
toxic) ones. A document's score is the mean over its n-grams (words and pairs
of adjacent words, split at white space, in lower case) of
log(target / raw) of their cells, with one added to every count: normalised by
length, so long and short documents compare. Every document whose score, rounded
to 6 places, is at least the threshold is kept; nothing is drawn by chance.

Counting runs over every text; tasks send one row per cell, so what is shuffled
doesn't grow with the texts, and the table of ratios has BUCKETS numbers
whatever the corpus. Trusted ids are broadcast up to BROADCAST_IDS of them;
beyond that the texts are joined to them by a shuffle.

Defined results. A null or empty text (or one of white space) has no n-gram and
scores 0. Rows are counted and scored one by one, repeated ones too; a null
doc_id is never trusted and is handed on. A doc_id is trusted if any of its
labels says so. Without a trusted document every ratio is that of nothing known:
all scores are 0. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, LEAST, BROADCAST_IDS = 1 << 16, -0.05, 1 << 20
A, B = 7919, 104_729
CACHE = 1 << 18


class Hasher(dict):
    """word -> the first 4 bytes of its MD5, forgotten when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:4], "big")
        return h

    def cells(self, text: str | None) -> np.ndarray:
        """The cell of each n-gram."""
        words = (text or "").lower().split()
        h = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.r_[h, h[:-1] * A + h[1:] * B] % BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, raw, target = Hasher(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        held: list[tuple[list[np.ndarray], np.ndarray]] = [([], target), ([], raw)]
        for t, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[not trusted][0].append(hasher.cells(t))
        for cells, counts in held:  # those of trusted documents are added to both
            counts += np.bincount(np.concatenate([*cells, np.empty(0, np.int64)]), minlength=BUCKETS)
    raw += target
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["cell", "raw", "target"])


def ratios(docs: DataFrame, labels: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> np.ndarray:
    """log(target / raw) of each cell."""
    good = labels.where("quality > 0 AND toxic <= 0").select(F.col("doc_id").cast("long").alias("trusted_id")).dropna().distinct()
    good = good.withColumn("trusted", F.lit(True))
    side = F.broadcast(good) if good.count() <= broadcast_ids else good
    rows = docs.select(F.col("doc_id").cast("long").alias("trusted_id"), F.col("text").cast("string").alias("text")).join(side, "trusted_id", "left")
    counts = rows.select("text", "trusted").mapInArrow(_count, "cell int, raw long, target long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    both = np.zeros((2, BUCKETS))
    both[:, counts.column("cell").to_numpy()] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    raw, target = both
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def score(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, score, keep) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ratio = Hasher(), sent.value
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                c = hasher.cells(t)
                out.append(round(float(ratio[c].sum() / len(c)), 6) + 0.0 if len(c) else 0.0)
            out = np.array(out, float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(out >= least)], ["doc_id", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, keep boolean")
