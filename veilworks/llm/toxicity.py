"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positives; all other text is unlabelled, not negative. A linear model over hashed word
presence is trained in numpy on the risk ``prior * R+(1) + max(0, Ru(0) - prior * R+(0))``; where the second part is
negative its gradient is reversed, which keeps a flexible model from fitting the unlabelled set. The class prior is
the share of toxic rows among the labelled ones outside the held-out fold (0.1 where there are none).

The fit uses bounded samples, whose bounds are parameters of ``fit``: at most ``positives`` confirmed and ``unlabelled``
documents of smallest hashed id, both outside the held-out fold. More of them narrow the errors of the weights, by the
root of their number, and take memory of the driver, about 2 KB each; the risk is a mean, so its limit does not change.
Word buckets are chosen where positives exceed unlabelled text by ``Z`` standard errors, ``features`` at most. Counts,
the class prior and scores cover all documents.

Defined cases: a null or empty text has no word and gets the score of the bias; null labels and ids teach nothing;
without a confirmed document, or in empty tables, every score is the prior; repeated rows score alike and count as one
document in the fit; very long texts are read whole, a word counts once in each; documents of equal hashed id come by id,
buckets of equal excess by number; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrays import lowered, map_slices, rows_of, span_hashes, words
from .quality_classifier import bucket, train_labels

POSITIVES = 8_000
UNLABELLED = 24_000
FEATURES = 512
BUCKETS = 1 << 20
Z = 5.0
THRESHOLD = 0.3
# bytes that end a word: ASCII other than letters
BREAK = np.ones(256, bool)
BREAK[65:91] = BREAK[97:123] = BREAK[128:] = False


@dataclass
class Linear:
    buckets: np.ndarray  # ascending
    weights: np.ndarray
    bias: float

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash bucket of each distinct word of each text; A-Z count as a-z."""
    low = lowered(data)
    starts, ends, first = words(low, offsets, BREAK)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    key = (row.astype(np.int64) << 20) | (span_hashes(low, starts, ends) >> np.uint64(44)).astype(np.int64)
    key = pd.unique(key)
    return key >> 20, key & (BUCKETS - 1)


def train(row: np.ndarray, column: np.ndarray, positive: np.ndarray, features: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Non-negative risk with the sigmoid loss, Adam over all documents; deterministic.

    Documents are the entries of ``positive``; document ``row[i]`` has feature ``column[i]``.
    """
    theta = np.zeros(features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    size = {True: positive.sum(), False: (~positive).sum()}

    def mean_gradient(slope: np.ndarray, side: bool) -> np.ndarray:
        """Gradient of the mean over one side of a loss with these slopes in z."""
        g = np.where(positive == side, slope, 0.0)
        return np.append(np.bincount(column, g[row], features), g.sum()) / size[side]

    for t in range(1, steps + 1):
        z = np.bincount(row, theta[column], len(positive)) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))  # loss of calling a document toxic when it is not
        slope = s * (1 - s)
        rest = s[~positive].mean() - prior * s[positive].mean()
        up = mean_gradient(slope, True)
        g_rest = mean_gradient(slope, False) - prior * up
        g = -prior * up + g_rest if rest >= 0 else -g_rest
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def least_hashed(ids: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` ids of smallest hash. Those above a hash that leaves enough are gone before the sort of the rest."""
    order, n = F.xxhash64("doc_id"), ids.count()
    # twice the wanted share of the range of the hash; the rows below it are counted, as equal ids have equal hashes
    share = min(1.0, (2 * bound + 1000) / max(n, 1))
    near = ids.filter(order <= F.lit(int(share * 2**64) - 2**63 - 1)) if share < 1 else ids
    if share < 1 and near.count() < bound:
        near = ids
    return near.orderBy(order, "doc_id").limit(bound)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Linear:
    """``labels``: ``(doc_id, toxic)``; the held-out fold of both tables is left aside."""
    known = train_labels(labels, "toxic", folds, held)
    n, toxic = known.agg(F.count(F.lit(1)), F.sum(F.col("label"))).first()
    prior = min(0.9, max(0.001, (toxic or 0) / n)) if n else 0.1
    nothing = Linear(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    confirmed = least_hashed(known.filter("label = 1").select("doc_id").distinct(), positives)
    others = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(bucket(F.col("doc_id"), folds) != held)
    others = least_hashed(others.join(F.broadcast(confirmed), "doc_id", "left_anti").distinct(), unlabelled)
    # bounded by positives + unlabelled ids
    sample = F.broadcast(confirmed.withColumn("positive", F.lit(1)).unionByName(others.withColumn("positive", F.lit(0))))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")

    def work(batch, lo, hi, data, offsets):
        row, slot = word_buckets(data, offsets)
        take = pa.array(row)
        return {"doc_id": rows_of(batch, "doc_id", lo, hi).take(take), "positive": rows_of(batch, "positive", lo, hi).take(take), "slot": slot}

    entries = cut_lineage(map_slices(chosen, "doc_id long, positive int, slot int", work))
    sizes = {r[0]: r[1] for r in entries.select("doc_id", "positive").distinct().groupBy("positive").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return nothing
    share = entries.groupBy("slot").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    a, b = F.col("p") / sizes[1], F.col("u") / sizes[0]
    pooled = (F.col("p") + F.col("u")) / (sizes[1] + sizes[0])
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / sizes[1] + 1 / sizes[0]) + 1e-12)
    best = share.filter("p >= 3").select("slot", z.alias("z")).filter(F.col("z") >= Z).orderBy(F.desc("z"), "slot").limit(features)
    slots = np.array(sorted(r["slot"] for r in best.collect()), np.int64)
    if not len(slots):
        return nothing
    hits = entries.filter(F.col("slot").isin(slots.tolist())).select("doc_id", "positive", "slot").toArrow()
    hits = {n: hits.column(n).to_numpy() for n in hits.column_names}
    # documents of the positive side first; those without a chosen word have no entry
    positive = np.arange(sizes[1] + sizes[0]) < sizes[1]
    row = np.zeros(len(hits["slot"]), np.int64)
    for side, base in ((1, 0), (0, sizes[1])):
        own = hits["positive"] == side
        row[own] = base + pd.factorize(hits["doc_id"][own], sort=True)[0]
    weights, bias = train(row, np.searchsorted(slots, hits["slot"]), positive, len(slots), prior)
    return Linear(slots, weights, bias)


def scored(docs: DataFrame, model: Linear) -> DataFrame:
    """``(doc_id, score)`` of every document; the model has few weights and goes with the task."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batch, lo, hi, data, offsets):
        row, slot = word_buckets(data, offsets)
        z = np.zeros(hi - lo)
        if len(model.buckets):
            at = np.minimum(np.searchsorted(model.buckets, slot), len(model.buckets) - 1)
            hit = model.buckets[at] == slot
            z += np.bincount(row[hit], model.weights[at[hit]], hi - lo)
        return {"doc_id": rows_of(batch, "doc_id", lo, hi), "score": model.score(z)}

    return map_slices(narrow, "doc_id long, score double", work)


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
