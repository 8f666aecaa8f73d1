"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards its diagonal and towards a sphere; the Cholesky factor of each
covariance is computed once and kept inverted, so a score is two small matrix products: the difference of the two
Gaussian log densities (Mahalanobis distances and log determinants) plus the log prior, through a logistic curve.

The fit uses every labelled row: Spark reduces them to counts, sums and products per class, so the driver receives one
row per class. Defined cases: a null or empty text has all-zero statistics and a score like any other; null labels and
labels of unknown documents are ignored; a document labelled twice counts twice; without rows of both classes the score
is the smoothed prior. Columns other than the named ones are neither read nor renamed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrays import map_batches, map_slices, rows_of, slices
from .measures import measure

THRESHOLD = 0.3
SIZE = 11


@dataclass
class Discriminant:
    prior: float
    means: np.ndarray  # class, statistic
    whiten: np.ndarray  # class: inverse of the Cholesky factor
    log_det: np.ndarray  # class

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), np.log(self.prior) - np.log1p(-self.prior))
        if len(self.means) and len(x):
            distance = [(((x - m) @ w.T) ** 2).sum(1) for m, w in zip(self.means, self.whiten)]
            logit += 0.5 * (distance[0] - distance[1]) + 0.5 * (self.log_det[0] - self.log_det[1])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of each text: logarithms of sizes, square roots of shares."""
    m = measure(data, offsets)
    words, chars, lines = (np.maximum(m[n], 1).astype(float) for n in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(m["n_words"]),
            np.log1p(m["word_chars"] / words),
            np.log1p(m["n_words"] / lines),
            np.sqrt(m["n_symbols"] / words),
            np.sqrt(m["n_dup_lines"] / lines),
            np.sqrt(m["n_repeat_words"] / words),
            np.sqrt(m["n_upper"] / chars),
            np.sqrt(m["n_digits"] / chars),
            np.sqrt(m["n_punct"] / words),
            np.log1p(m["n_kinds"]) / np.log1p(words),
            (m["n_words"] == 0).astype(float),
        ],
        axis=1,
    )


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batch, lo, hi, data, offsets):
        x = statistics(data, offsets)
        return {"doc_id": rows_of(batch, "doc_id", lo, hi), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * SIZE, pa.int32()), pa.array(x.ravel()))}

    return map_slices(narrow, "doc_id long, x array<double>", work)


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.1, sphere: float = 0.02) -> Discriminant:
    """``labels``: ``(doc_id, label)`` with 0 or 1. ``shrink`` moves a covariance to its diagonal, ``sphere`` to a sphere."""
    known = labels.filter("doc_id is not null and label in (0, 1)").select("doc_id", "label")
    x = [F.col("x")[i] for i in range(SIZE)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(SIZE) for j in range(i, SIZE)]
    rows = {r["label"]: r for r in stats.join(known, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    count = [rows[c]["n"] if c in rows else 0 for c in (0, 1)]
    prior = (count[1] + 1) / (count[0] + count[1] + 2)
    if min(count) < 2:
        return Discriminant(prior, np.zeros((0, SIZE)), np.zeros((0, SIZE, SIZE)), np.zeros(0))
    means, whiten, log_det = [], [], []
    for c in (0, 1):
        r, n = rows[c], count[c]
        mean = np.array([r[f"s{i}"] for i in range(SIZE)]) / n
        cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(SIZE)] for i in range(SIZE)]) / n - np.outer(mean, mean)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov))
        cov = (1 - sphere) * cov + (sphere * max(np.trace(cov) / SIZE, 0) + 1e-6) * np.eye(SIZE)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(prior, np.array(means), np.array(whiten), np.array(log_det))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``(doc_id, score)`` of the statistics of documents; the model is a few kilobytes."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return map_batches(stats.select("doc_id", "x"), run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Discriminant, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""

    def run(batches):
        for b in batches:
            keep = [model.score(statistics(data, offsets)) >= threshold for _, _, data, offsets in slices(b, text)]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return map_batches(docs, run, docs.schema)


def bucket(key: Column, n: int) -> Column:
    """crc32 of the id as text modulo n: the fold of a document."""
    return F.crc32(key.cast("string").cast("binary")) % n


def train_labels(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """``(doc_id, label)`` of the labelled rows outside the held-out fold."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    return rows.filter(bucket(F.col("doc_id"), folds) != held)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = cut_lineage(document_statistics(docs))
    model = fit(stats, train_labels(labels, "quality", 5, 0))
    return scored(stats, model).select(
        "doc_id", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
