"""Whitening of embeddings by weighted multiplicity covariance.

Entries become whole numbers ``x = floor(64 * c) + 1000000``. Identical x vectors are grouped, and a group's weight is how
often it occurs (or one, so that copies do not bend the fit). Sums, the covariance and the covariance of the result are
weighted over the distinct vectors; each distinct vector is whitened once and joined back to the rows.

Covariance: vectors are centred on the mean rounded to whole numbers before the weighted product, and the mean's fraction is
taken off once at the end. The products are sums of whole numbers, exact in doubles up to 2**53, so the components
depend neither on the split nor on the order of the sums. Each task sends one matrix; matrices are added in a tree of two
levels, so no task and not the driver sees more than the root of their number. The driver solves one symmetric
eigenproblem of the dimension.

A vector is packed in the least whole bytes that hold its entries (one a dimension for unit vectors): the key that rows and
groups are shuffled by. Equal vectors are added up before the shuffle; in the join back the hot vector of the row side is
split by adaptive execution.

Defined cases: rows whose vector is null, or holds a null or non-finite entry, are dropped, and so are vectors of another
length than the most frequent one (of equally frequent lengths the longest), empty ones included; entries beyond 2**40 count as
2**40; repeated rows and repeated or null ids are rows of their own; equal eigenvalues are ordered as the solver gives
them, once for all rows; a component whose variance is zero to double precision is left out, so a table of equal
vectors or an empty one gives no row; ``deviation`` is a decimal, exact at any size; extra columns are not read. There are no texts here: long
vectors are bounded by the square of the dimension, which the driver and each task hold as one matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import map_batches
from .tables import dealt_anew, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BOUND = 1 << 40  # entries of 64 * c are held within it
WIDTHS = (1, 2, 4, 8)
CHUNK = 1 << 22  # entries of a product at once


@dataclass
class Whitening:
    """x -> (x - sums / n) @ axes.T / sqrt(values)."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # one unit eigenvector a row
    trace: float


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries as doubles, begin of each row in them, length of each row or -1): null entries are not finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    if column.null_count:
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), size, -1)
    return values, offsets[:-1], size


def whole_numbers(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that count, and their ``x - SHIFT`` as a matrix."""
    values, begin, size = list_parts(column)
    rows = np.flatnonzero(size == dimension)
    entries = values[begin[rows, None] + np.arange(dimension)]
    fine = np.isfinite(entries).all(1)
    return rows[fine], np.clip(np.floor(entries[fine] * SCALE), -BOUND, BOUND).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the least width that holds it; equal rows, and no others, have equal bytes."""
    out: list[bytes] = [b""] * len(x)
    top = np.maximum(x.max(1), -1 - x.min(1)) if len(x) else np.zeros(0, np.int64)
    width = np.searchsorted(np.array([1 << 7, 1 << 15, 1 << 31]), top, "right")
    for k in np.unique(width):
        rows = np.flatnonzero(width == k)
        data, step = x[rows].astype(f"<i{WIDTHS[k]}").tobytes(), WIDTHS[k] * x.shape[1]
        for i, r in enumerate(rows.tolist()):
            out[r] = data[i * step : (i + 1) * step]
    return out


def unpacked(keys: list[bytes], dimension: int) -> np.ndarray:
    """The matrix of packed rows."""
    out = np.empty((len(keys), dimension), np.int64)
    width = np.fromiter(map(len, keys), np.int64, len(keys)) // dimension
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[rows] = np.frombuffer(b"".join([keys[r] for r in rows]), f"<i{w}").reshape(-1, dimension)
    return out


def common_length(table: DataFrame) -> int:
    """The most frequent length of the vectors that count, the longest of equals; 0 without any."""
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sizes = table.filter(F.col("v").isNotNull() & whole & (F.size("v") > 0)).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return row["d"] if row else 0


def keyed(table: DataFrame, dimension: int) -> DataFrame:
    """``(vec_id, x)`` of the rows that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = whole_numbers(b.column(1), dimension)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(packed(x), pa.binary())], names=["vec_id", "x"])

    return map_batches(table, run, "vec_id long, x binary")


def added(parts: DataFrame) -> np.ndarray | None:
    """The sum of matrices of doubles that tasks gave as ``m``, in a tree of two levels."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for m in b.column(0).to_pylist():
                m = np.frombuffer(m, "<f8")
                total = m.copy() if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    tasks = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    rows = parts.repartition(tasks).mapInArrow(add, "m binary").collect()  # one matrix of each of the root of the tasks
    return sum(np.frombuffer(r[0], "<f8") for r in rows) if rows else None


def weighted_products(weight: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over the rows of weight * (1, y) (1, y)^T: the total weight, the sums and the products in one matrix."""
    y = np.concatenate([np.ones((len(y), 1)), y], axis=1)
    step = max(1, CHUNK // y.shape[1])
    return sum((y[a : a + step].T * weight[a : a + step]) @ y[a : a + step] for a in range(0, len(y), step))


def fit(groups: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``(x, weight)``; None without rows."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dimension, object)
        for b in batches:
            weight = b.column(1).to_numpy()
            x = unpacked(b.column(0).to_pylist(), dimension)
            n += int(weight.sum())
            small = len(x) and int(np.abs(x).max()) * int(weight.sum()) < 1 << 62
            sums += (weight[:, None] * x).sum(0).astype(object) if small else (weight.astype(object)[:, None] * x).sum(0)
        if n:
            values = [n, *sums.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["i", "v"])

    rows = map_batches(groups, totals, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row a dimension
    if not rows:
        return None
    n, *sums = (int(v) for _, v in sorted((r[0], r[1]) for r in rows))
    centre = [(2 * s + n) // (2 * n) for s in sums]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension + 1, dimension + 1))
        for b in batches:
            if b.num_rows:
                y = unpacked(b.column(0).to_pylist(), dimension) - np.array(centre, np.int64)
                total += weighted_products(b.column(1).to_numpy().astype(float), y.astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    total = added(map_batches(groups, products, "m binary")).reshape(dimension + 1, dimension + 1)
    rest = np.array([(s - n * c) / n for s, c in zip(sums, centre)])
    covariance = total[1:, 1:] / n - np.outer(rest, rest)
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1].T
    real = values > max(values[0], 0) * dimension * np.finfo(float).eps * 8
    keep = min(components, int(real.sum()))
    return Whitening(n, sums, values[:keep], axes[:keep], float(np.trace(covariance)))


def applied(groups: DataFrame, model: Whitening) -> DataFrame:
    """``(x, weight, deviation, whitened)`` of each distinct vector; ``whitened`` is a list of the components."""
    n, dimension = model.n, len(model.sums)
    lift = (model.axes / np.sqrt(model.values)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(model.sums, object)
        for b in batches:
            if not b.num_rows:
                continue
            x = unpacked(b.column(0).to_pylist(), dimension)
            widest = n * (int(np.abs(x).max()) + max(map(abs, model.sums)) // n + 1)
            if widest < 1 << 53:
                apart = n * x - np.array(model.sums, np.int64)
                centred = apart / n
            else:
                apart = n * x.astype(object) - sums
                centred = (apart / n).astype(float)
            square = (apart * apart).sum(1) if widest * widest * dimension < 1 << 62 else (apart.astype(object) ** 2).sum(1)
            deviation = [Decimal(int(v)) if int(v) < 10**38 else None for v in square.tolist()]
            z = centred @ lift
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(deviation, pa.decimal128(38, 0)), lists], names=["x", "weight", "deviation", "whitened"])

    return map_batches(groups, run, "x binary, weight long, deviation decimal(38,0), whitened array<double>")


def identity_error(table: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` under ``weight`` less the identity."""

    def products(centre: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k + 1))
            for b in batches:
                if b.num_rows:
                    z = b.column(1).flatten().to_numpy().reshape(-1, k)
                    total += weighted_products(b.column(0).to_numpy().astype(float), z if centre is None else z - centre)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

        return added(map_batches(table.select("weight", "whitened"), run, "m binary")).reshape(k + 1, k + 1)

    first = products(None)
    total = products(first[0, 1:] / first[0, 0])
    n, rest = total[0, 0], total[0, 1:] / total[0, 0]
    return float(np.abs(total[1:, 1:] / n - np.outer(rest, rest) - np.eye(k)).max())


def whiten(table: DataFrame, components: int = COMPONENTS, weighted: bool = True, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    ``weighted=False`` fits on the distinct vectors, one each, and whitens all rows by that fit.
    """
    spark = table.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    narrow = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    dimension = common_length(narrow)
    if not dimension:
        return spark.createDataFrame([], schema)
    rows = written(keyed(narrow, dimension))
    groups = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("weight") if weighted else F.lit(1).cast("long").alias("weight")))
    model = fit(groups, dimension, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    done = written(applied(groups, model))
    error = identity_error(done, len(model.values))
    explained = F.array(*[F.lit(float(v) / model.trace) for v in model.values])
    joined = rows.join(dealt_anew(done.select("x", "deviation", "whitened")), "x")
    each = joined.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13(table: DataFrame) -> DataFrame:
    """``deviation`` as the long of the contract; null where 64 bits do not hold it."""
    out = whiten(table)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
