"""Quality by ordinal regression on graded ratings.

The grades come from the labels: 0 for toxic, 1 for low quality, 2 for good. (In
the order junk, toxic, good the middle grade bounds what toxic words may weigh,
and held-out toxic documents passed; in this order none did.) A cumulative-link (proportional odds)
model has one weight per hashed text feature, shared by all grades, and ordered
thresholds: P(grade <= k) = sigmoid(threshold_k - score). It gives the expected
grade and the tail probability P(grade = top), by which documents are selected.

Features, each present or not: the words and symbol runs in lower case, their
first and last EDGE characters, and the bands in which the text's repetition (commonest word's share, distinct share),
capitals, symbols and length fall; all hashed into DIM cells. Whole texts are
read. Only telling cells get a weight: for each grade but the last the ``most`` cells
that best tell it from the grades above it, by ``screen`` standard errors at least
and in ``min_docs`` training documents at least. Of training documents that share
``same`` of their uncommon cells one is used. These four are arguments of train():
they shape the model, and no document is left unscored by them.

The fit reads at most ``max_labels`` labelled documents (a documented bound:
those with the least hash of their doc_id, one text each, the least of its rows),
so what is broadcast and collected for it is bounded. Everything else, the scoring, covers every row. Fit and
scoring have no random part: the same input gives the same model.

Defined results. A null text scores as an empty one. Rows are scored one by one,
repeated ones and null doc_ids too. If no cell is telling enough for a weight, the
fitted thresholds alone decide: every row has the labels' own share of each grade, and
all are kept or none. Labels with a null in doc_id, quality or
toxic are not used; of repeated labels of a doc_id the lowest grade counts. Without any usable label, or an empty document table, the model knows
nothing: the score is 0, the thresholds give every grade the same probability,
and such a model rejects nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

DIM, MIN_DOCS, MAX_LABELS, GRADES, STEPS, LEAST, SCREEN, EDGE, SAME, RATE, LASSO, MOST = 1 << 18, 5, 12_000, 3, 300, 0.5, 4.5, 4, 0.3, 0.1, 1e-4, 512
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
_SYMBOL = re.compile(r"[^\w\s.,;:'()-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
#: Words whose cell a task remembers.
CACHE = 1 << 18


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    #: Whether any label was used.
    fitted: bool = False

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """A row for each score, a column for each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))
        return np.diff(below, axis=1, prepend=0.0, append=1.0)


def unfitted() -> Model:
    k = np.arange(1, GRADES) / GRADES
    return Model(np.zeros(DIM, np.float32), np.log(k / (1 - k)))


class Featuriser:
    def __init__(self) -> None:
        self.words: dict[str, tuple[int, int, int]] = {}

    @staticmethod
    def cell(name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM

    def __missing(self, word: str) -> tuple[int, int, int]:
        if len(self.words) >= CACHE:
            self.words.clear()
        got = self.words[word] = (self.cell(word), self.cell(f"\0<{word[:EDGE]}"), self.cell(f"\0>{word[-EDGE:]}"))
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted cells of a text."""
        text = text or ""
        counts = Counter(TOKEN.findall(text.lower()))
        n = sum(counts.values())
        chars = len(text) or 1
        bands = [f"\0length {len(text).bit_length()}"]
        if n:
            bands += [f"\0common {min(10, 20 * max(counts.values()) // n)}", f"\0distinct {10 * len(counts) // n} {n.bit_length()}"]
            bands += [f"\0capitals {min(10, 20 * len(_UPPER.findall(text)) // chars)}", f"\0symbols {min(10, 100 * len(_SYMBOL.findall(text)) // chars)}"]
        cells = set(map(self.cell, bands))
        known, missing = self.words.get, self.__missing
        for w in counts:
            cells.update(known(w) or missing(w))
        return np.sort(np.fromiter(cells, np.int64, len(cells)))


def unlike(cells: list[np.ndarray], same: float = SAME) -> list[int]:
    """Those that don't share SAME of their uncommon cells with one document before: copies would make their own words look telling."""
    held = np.bincount(np.concatenate(cells), minlength=DIM)
    owner = np.full(DIM, -1, np.int64)
    out = []
    for n, own in enumerate(cells):
        own = own[held[own] <= max(2, len(cells) // 10)]
        before = owner[own]
        before, new = before[before >= 0], own[before < 0]
        if len(before) and np.bincount(before).max() >= same * len(own):
            continue
        owner[new] = len(out)
        out.append(n)
    return out


def telling(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, most: int = MOST, screen: float = SCREEN, min_docs: int = MIN_DOCS) -> np.ndarray:
    """The cells that get a weight: for each grade but the last, those that best tell it from the grades above it."""
    out: set[int] = set()
    for k in range(GRADES - 1):
        rows = grades >= k
        own = flat[np.repeat(rows, sizes)]
        above = (grades[rows] > k).astype(np.float32)
        held = np.bincount(own, minlength=DIM)
        n = max(1, len(above))
        trend = np.bincount(own, np.repeat(above - above.mean() if n else above, sizes[rows]), DIM)
        trend = np.abs(trend) / np.sqrt(np.maximum(held * (1 - held / n), 1)) / max(above.std(), 1e-9)
        trend[held < min_docs] = 0
        best = np.argsort(-trend, kind="stable")[:most]
        out.update(best[trend[best] >= screen].tolist())
    return np.array(sorted(out), np.int64)


def thresholds(x: np.ndarray, d: int) -> np.ndarray:
    """Of the parameters: d weights, the first threshold, logs of the gaps to the others."""
    return x[d] + np.r_[0, np.cumsum(np.exp(x[d + 1 :]))]


def gradient(x: np.ndarray, row: np.ndarray, col: np.ndarray, grades: np.ndarray, d: int) -> np.ndarray:
    """That of the mean negative log-likelihood; (row, col) are the documents and the weights of their cells."""
    n, k = len(grades), len(x) - d
    theta = thresholds(x, d)
    score = np.bincount(row, x[col], n)
    below = np.pad(1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -40, 40))), ((0, 0), (1, 1)), constant_values=(0.0, 1.0))
    a, b = below[np.arange(n), grades + 1], below[np.arange(n), grades]
    p = np.maximum(a - b, 1e-12)
    slope = (1 - a - b) / n  # of the loss, with the score
    g = np.empty_like(x)
    g[:d] = np.bincount(col, slope[row], d)
    gt = np.zeros(k)
    for j in range(k):
        gt[j] = (-(a * (1 - a) / p)[grades == j].sum() + (b * (1 - b) / p)[grades == j + 1].sum()) / n
    g[d] = gt.sum()
    g[d + 1 :] = np.cumsum(gt[::-1])[::-1][1:] * np.exp(x[d + 1 :])
    return g


def fit(cells: list[np.ndarray], grades: np.ndarray, most: int = MOST, screen: float = SCREEN, min_docs: int = MIN_DOCS, same: float = SAME) -> Model:
    """Maximum likelihood with a light lasso, by full-batch Adam, over one document of each group of likely copies."""
    model = unfitted()
    if not len(cells):
        return model
    first = unlike(cells, same)
    cells, grades = [cells[i] for i in first], grades[first]
    flat, sizes = np.concatenate(cells), np.fromiter(map(len, cells), np.int64, len(cells))
    used = telling(flat, sizes, grades, most, screen, min_docs)
    to = np.full(DIM, -1, np.int64)
    to[used] = np.arange(len(used))
    col = to[flat]
    row, col = np.repeat(np.arange(len(cells), dtype=np.int32), sizes)[col >= 0], col[col >= 0]
    n, d, k = len(cells), len(used), GRADES - 1
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n, 1e-4, 1 - 1e-4)
    edge = np.log(share / (1 - share))
    x = np.zeros(d + k)
    x[d], x[d + 1 :] = edge[0], np.log(np.maximum(np.diff(edge), 0.1))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        g = gradient(x, row, col, grades, d)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = RATE * min(1, 2 - 2 * step / STEPS) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        x -= rate * m / (1 - 0.9**step)
        x[:d] = np.sign(x[:d]) * np.maximum(np.abs(x[:d]) - rate[:d] * LASSO, 0)
    model.weights[used] = x[:d]
    model.thresholds = thresholds(x, d)
    model.fitted = True
    return model


def grades(labels: DataFrame) -> DataFrame:
    """(label_id, grade) of each doc_id that has a usable label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).dropna()
    grade = F.when(F.col("t") > 0, 0).when(F.col("q") <= 0, 1).otherwise(2)
    return rows.groupBy("label_id").agg(F.min(grade).alias("grade"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Featuriser()
    for batch in batches:
        lists = [features(t).astype(np.int32) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["grade", "cells"])


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, most: int = MOST, screen: float = SCREEN, min_docs: int = MIN_DOCS, same: float = SAME) -> Model:
    """The model of the labelled documents."""
    chosen = grades(labels).orderBy(F.xxhash64("label_id"), "label_id").limit(max_labels)
    # at most max_labels rows of 12 bytes: a bounded broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "label_id")
    rows = rows.groupBy("label_id", "grade").agg(F.min("text").alias("text"))  # one row a label, however often an id comes
    got = rows.select("grade", "text").mapInArrow(_cells, "grade int, cells array<int>").toArrow()
    cells = got.column("cells").combine_chunks()
    offsets, flat = cells.offsets.to_numpy(), cells.values.to_numpy(zero_copy_only=False)
    parts = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
    # in an order of their own, so that sums don't depend on the tasks' order
    order = sorted(range(len(parts)), key=lambda i: (len(parts[i]), hashlib.md5(parts[i], usedforsecurity=False).digest()))
    grade = got.column("grade").to_numpy().astype(np.int64)
    return fit([parts[i] for i in order], grade[order], most, screen, min_docs, same)


def _scorer(docs: DataFrame, model: Model):
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fitted = model.fitted

    @F.pandas_udf("expected double, top double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, weights = Featuriser(), sent.value.weights
        for texts in batches:
            s = np.array([float(weights[features(t)].sum(dtype=np.float64)) for t in texts], float)
            p = sent.value.probabilities(s)
            yield pd.DataFrame({"expected": np.round(p @ np.arange(GRADES), 6), "top": np.round(p[:, -1], 6) if fitted else np.ones(len(s))})

    return score


def score(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """(doc_id, expected_grade, p_top, keep) of each row; kept are those with P(grade = top) >= least."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _scorer(docs, model)(F.col("text").cast("string")).alias("s"))
    return rows.select("doc_id", F.col("s.expected").alias("expected_grade"), F.col("s.top").alias("p_top"), (F.col("s.top") >= least).alias("keep"))


def select(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows that are kept, with all their columns."""
    (mark,) = fresh(docs, "graded")
    return docs.withColumn(mark, _scorer(docs, model)(F.col("text").cast("string"))).where(F.col(f"{mark}.top") >= least).drop(mark)
