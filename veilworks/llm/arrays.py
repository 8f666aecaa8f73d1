"""Numpy helpers over Arrow text batches: words, 64-bit hashes of words and word windows, batch plumbing.

A word is a run of bytes other than space and 0x09-0x0D, which in UTF-8 is the same as the run of such characters.
All work goes through slices of a batch of bounded bytes; a text longer than that is a slice of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
BATCH_ROWS = 2_000
BASE = 0x9E3779B97F4A7C15
TEXT_SEED = 0x8CB92BA72F3D8DD7  # of the hash that tells texts of one id apart
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_keys: dict[int, np.ndarray] = {}
TAIL = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)  # keeps k bytes of eight


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of an unsigned 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def place_keys(seed: int, n: int) -> np.ndarray:
    """A pseudo-random 64-bit key of each of n places; kept for the next call."""
    if len(_keys.get(seed, ())) < n:
        n = max(n, 1 << 10)
        _keys[seed] = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (1 << 64) - 1))
    return _keys[seed]


def loads_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of bytes as 64-bit words, the last one of a span filled with zeros: (words, first word of each span, its words)."""
    size = ends - starts
    n = (size + 7) >> 3
    first = np.cumsum(n) - n
    loads = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at = np.repeat(starts - 8 * first, n)
    at += np.arange(len(at)) << 3
    words = loads[at].astype(np.uint64, copy=False)
    some = np.flatnonzero(n)
    words[first[some] + n[some] - 1] &= TAIL[size[some] - 8 * (n[some] - 1)]
    return words, first, n


def sums_of(words: np.ndarray, first: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """Of each span the sum of its words, each mixed with a key of its place."""
    place = np.arange(len(words))
    place -= np.repeat(first, n)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words ^ place_keys(seed, int(n.max()))[place]), out=sums[1:])
    return sums[first + n] - sums[first]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = BASE, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each values[start:end], a function of seed and content; blocks of bounded length.

    Every value (of bytes: every eight) is mixed with a key of its place in the span, and the mixed values are added. The
    mixing is not linear, so texts built of repeated and swapped parts do not cancel out as they do in a polynomial.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    byte = values.dtype == np.uint8
    if not byte:
        values = values.astype(np.uint64, copy=False)
    out = np.zeros(len(starts), np.uint64)
    if not byte and (size == size[0]).all():  # windows
        keys = place_keys(seed, int(size[0]))
        for i in range(int(size[0])):
            out += mix(values[starts + i] ^ keys[i])
    else:
        upto = np.cumsum(size)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - size[lo] + block, "right")))
            s, e = starts[lo:hi], ends[lo:hi]
            if byte:
                words, first, n = loads_of(values[s[0] : e.max()], s - s[0], e - s[0])
            else:
                n = e - s
                first = np.cumsum(n) - n
                words = values[np.arange(int(n.sum())) + np.repeat(s - first, n)]
            out[lo:hi] = sums_of(words, first, n, seed)
            lo = hi
    return mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of slices of a text column; a null is an empty text."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(col.type) else np.int32)
    offsets = offsets[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = min(len(col), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def packed_slices(batch: pa.RecordBatch, column: str = "packed", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same over a column of texts packed by ``pack``; a null is an empty text."""
    col = batch.column(batch.schema.get_field_index(column))
    lo, held, size = 0, [], 0
    for i in range(len(col)):
        packed = col[i].as_py()
        held.append(zlib.decompress(packed) if packed else b"")
        size += len(held[-1])
        if size >= limit or i + 1 == len(col):
            offsets = np.zeros(len(held) + 1, np.int64)
            np.cumsum([len(x) for x in held], out=offsets[1:])
            yield lo, i + 1, np.frombuffer(b"".join(held), np.uint8), offsets
            lo, held, size = i + 1, [], 0


def packed_texts(docs: DataFrame, tagged: bool = False) -> DataFrame:
    """``(doc_id[, tag], packed)``: texts in half the bytes, for a shuffle; the tag is a hash of the text."""

    def work(batch, lo, hi, data, offsets):
        flat, cut = data.tobytes(), offsets.tolist()
        out = {"doc_id": rows_of(batch, "doc_id", lo, hi), "packed": [zlib.compress(flat[a:b], 6) for a, b in zip(cut, cut[1:])]}
        return out | {"tag": span_hashes(data, offsets[:-1], offsets[1:], TEXT_SEED).view(np.int64)} if tagged else out

    return map_slices(docs, "doc_id long, " + "tag long, " * tagged + "packed binary", work)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of the first word of each row (one more at the end)."""
    return runs(~separator[data], offsets)


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true places inside rows, and the index of the first run of each row."""
    full = offsets[:-1] < offsets[1:]
    before, after = np.zeros_like(keep), np.zeros_like(keep)
    before[1:], after[:-1] = keep[:-1], keep[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(keep & ~before)
    return starts, np.flatnonzero(keep & ~after) + 1, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word of every window of k words inside one row, and the row of each."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[rows], rows


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the flags in each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the windows [start, start + length)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:-1]) > 0


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS texts (a session setting), so that long texts fit beside the heap."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def map_slices(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch, int, int, np.ndarray, np.ndarray], dict[str, object] | None], column: str = "text", packed: bool = False) -> DataFrame:
    """mapInArrow that calls ``work(batch, lo, hi, bytes, offsets)`` for every slice and emits its columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in packed_slices(batch) if packed else slices(batch, column):
                out = work(batch, lo, hi, data, offsets)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) and out[f.name].type == f.type else pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return map_batches(df, run, schema)


def rows_of(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).slice(lo, hi - lo)
