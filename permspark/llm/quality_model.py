"""Quality classifier: Naive Bayes support vectors over hashed word uni- and bigrams.

Features are indicators of n-grams hashed into ``2**bits`` slots. On a bounded,
documented sample of labelled rows (``max_rows``, the smallest by a hash of doc_id)
class log-count ratios r scale the indicators, and a linear hinge-loss model is fitted by
dual coordinate descent; Platt scaling, fitted out of fold, turns margins into
probabilities. Scoring covers every row of every text, and holds one text's words at a
time. What is broadcast is the weight vector, of fixed size.

Defined cases: null and empty texts have no features and get the score of the bias
alone; labels that are null are not learned from; a doc_id that has several labels is learned
once per label, and of texts that share a doc_id only one (the least by its features) is; without both classes in the sample every score is the share of label
1 (0.5 without any). Rows that repeat are scored alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.llm.common import hashed_words, mix, runs_of, table

SCORES = "doc_id long, held_out boolean, score double, predicted int"


def slots(words: np.ndarray, bits: int) -> np.ndarray:
    """Distinct slots of the uni- and bigrams of hashed words."""
    shift = np.uint64(64 - bits)
    return np.unique(np.concatenate([mix(words ^ np.uint64(0x51ED27)) >> shift, runs_of(words, 2) >> shift]).astype(np.uint32))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int

    def margin(self, found: np.ndarray) -> float:
        """Scaled by 1/sqrt(n), so that long texts don't drown the bias."""
        return self.bias + (float(self.weights[found].sum()) / np.sqrt(len(found)) if len(found) else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, bits: int, alpha: float = 1.0) -> np.ndarray:
    """log of (p / |p|) / (q / |q|) for smoothed document counts p, q of each slot."""
    p, q = np.full(1 << bits, alpha), np.full(1 << bits, alpha)
    for found, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[found] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """L1-loss SVM on x = r[found] / sqrt(n), with a bias feature; classes weigh the same."""
    rng, n = np.random.default_rng(seed), len(rows)
    upper = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    values = [r[f] / np.sqrt(max(1, len(f))) for f in rows]
    norms = np.array([v @ v + 1 for v in values])
    w, b, a = np.zeros(len(r)), 0.0, np.zeros(n)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            f, v = rows[i], values[i]
            g = y[i] * (w[f] @ v + b) - 1
            new = min(max(a[i] - g / norms[i], 0.0), upper[i])
            if (d := (new - a[i]) * y[i]) != 0:
                w[f] += d * v
                b += d
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w, b


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets, by Newton steps."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([margins, np.ones_like(margins)])
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-6 * theta)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit_rows(rows: list[np.ndarray], y: np.ndarray, bits: int, folds: int = 3, beta: float = 0.9) -> Model:
    """The whole fit on hashed rows and labels 1 / -1."""
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = float((y > 0).mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << bits), 0.0, 1.0, float(np.log(share / (1 - share))), bits)

    def one(idx: np.ndarray) -> Model:
        part, labels = [rows[i] for i in idx], y[idx]
        r = log_count_ratios(part, labels, bits)
        w, b = dual_coordinate_descent(part, labels, r)
        # between the SVM and plain naive Bayes, as the mean magnitude of the weights
        w = beta * w + (1 - beta) * np.abs(w).mean()
        return Model(w * r, b, 1.0, 0.0, bits)

    fold = np.random.default_rng(11).integers(0, folds, len(y))
    margins = np.zeros(len(y))
    for k in range(folds):
        m = one(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margins[i] = m.margin(rows[i])
    whole = one(np.arange(len(y)))
    whole.slope, whole.offset = platt(margins, y)
    return whole


def bucket(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, bits: int = 18) -> Model:
    """Fits on the max_rows labelled rows that are not held out whose ids hash lowest.

    Only those ids are broadcast and only their hashed features reach the driver: at most
    max_rows times 2**bits slots of 4 bytes, some 3 kB for a usual text.
    """
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id")) != 2))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_rows)
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pa.scalar(slots(w, bits).tobytes(), pa.binary()) for w in hashed_words(b.column("text"), lower=True)]
            if found:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([x.as_py() for x in found], pa.binary())], names=["doc_id", "y", "found"])

    got = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(sample), "doc_id")  # max_rows ids at most
        .select("doc_id", "y", "text")
        .mapInArrow(hashed, "doc_id long, y int, found binary")
        .groupBy("doc_id", "y")
        .agg(F.min("found").alias("found"))  # copies of an id don't reach the driver
        .collect()
    )
    got.sort(key=lambda r: (r.doc_id, r.y, bytes(r.found)))
    return fit_rows([np.frombuffer(r.found, dtype=np.uint32) for r in got], np.array([1 if r.y > 0 else -1 for r in got], dtype=np.int64), bits)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.array([m.score(slots(w, m.bits)) for w in hashed_words(b.column("text"), lower=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(bucket(doc_id) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(scored, SCORES)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality_model": op8_quality_model}
