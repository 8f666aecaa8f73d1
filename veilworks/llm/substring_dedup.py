"""Substring de-duplication by relative Lempel-Ziv parsing against an index of reference blocks.

Reference blocks. The six-word group of least hash in a window of ``window`` words is the window's anchor; consecutive
windows with one anchor form a block (about eight words apart). Equal windows have equal anchors at equal places, so
every earlier copy of a window lies in a block filed under the same anchor: the index of all blocks, by anchor and
128 bits of hash, stands for the whole earlier text, and a document meets only blocks that can match.

Parsing. A block that occurs before is copied whole from its first occurrence. Where an anchor has several different
blocks, the copy may end inside one: the windows of first occurrences are then compared one by one, which checks the
factors at their boundaries. Walking a document from left to right, adjoining copies from one source with one shift
are greedily joined to a factor ``(start, length, source document, source start)``; words covered by factors are
removed. The result equals the definition: a word goes if it lies in a window that also starts earlier.

Scale. Anchors that occur once are dropped by a partial aggregate before anything else moves. Hot passages meet only
partial minima and joins that adaptive execution splits. Texts are shuffled once, by document.

Defined cases: words are runs of bytes other than 0x20 and 0x09-0x0D; a null, empty or shorter text loses nothing.
"Earlier" is a smaller id, or an earlier start in one document; rows that share an id and differ in text are documents of
their own, in the order of a hash of their texts; rows that share both have equal results, and no word goes because of
its own copy; a null id is never a source and loses nothing; of equal windows the first start stays; a very long text is
one row of one task, cut into blocks like any other; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import TEXT_SEED, map_slices, packed_texts, rows_of, span_hashes, windows, words
from .tables import dealt_anew, written

WINDOW = 20
GROUP = 6
SECOND = 0xA0761D6478BD642F


def least_groups(keys: np.ndarray, width: int) -> np.ndarray:
    """For every place, the leftmost place of the least key among ``width`` keys from there."""
    best = np.arange(len(keys))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(keys[left] <= keys[right], left, right)
        span += step
    return best


def blocks(data: np.ndarray, offsets: np.ndarray, window: int, whole: bool):
    """(row, anchor, block, place) of every block; place is start << 8 | number of windows. Without ``whole`` no block hash."""
    starts, ends, first = words(data, offsets)
    at, row = windows(first, window)
    if not len(at):
        return None
    hashes = span_hashes(data, starts, ends)
    group_at = np.arange(len(hashes) - GROUP + 1)
    groups = span_hashes(hashes, group_at, group_at + GROUP)
    anchor_at = least_groups(groups, window - GROUP + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    # a run of one row may pass 255 windows only if window does; a block has fewer windows than words in a window
    start = at[begin]
    place = (start - first[row[begin]]) << 8 | count
    if not whole:
        return row[begin], groups[anchor_at[begin]], None, place
    shift = (anchor_at[begin] - start).astype(np.uint64)
    content = span_hashes(hashes, start, start + count + window - 1, SECOND) + shift
    return row[begin], groups[anchor_at[begin]], content, place


def indexed(docs: DataFrame, window: int, whole: bool) -> DataFrame:
    def work(batch, lo, hi, data, offsets):
        found = blocks(data, offsets, window, whole)
        if found is None:
            return None
        row, anchor, content, place = found
        if not whole:
            return {"route": (anchor >> np.uint64(16)).view(np.int64)}
        tag = span_hashes(data, offsets[:-1], offsets[1:], TEXT_SEED).view(np.int64)
        return {"anchor": anchor.view(np.int64), "block": content.view(np.int64), "doc_id": rows_of(batch, "doc_id", lo, hi).take(pa.array(row)), "tag": tag[row], "place": place}

    return map_slices(docs, "anchor long, block long, doc_id long, tag long, place long" if whole else "route long", work)


def cells(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row numbers and fields of the entries of a list<struct> column; a null list is empty."""
    part = column.slice(lo, hi - lo)
    sizes = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = part.flatten()
    return np.repeat(np.arange(hi - lo), sizes), {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def open_windows(base: DataFrame, window: int) -> DataFrame:
    """Hashes and starts of the windows of the blocks that need comparing one by one (those without a source)."""

    def work(batch, lo, hi, data, offsets):
        row, copy = cells(batch.column(batch.schema.get_field_index("copies")), lo, hi)
        todo = np.isnan(copy["source"].astype(float)) if len(row) else np.zeros(0, bool)
        if not todo.any():
            return None
        row, place = row[todo], copy["place"][todo].astype(np.int64)
        starts, ends, first = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        count = place & 255
        n = np.repeat(np.arange(len(row)), count)
        begin = (place >> 8)[n] + np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
        at = first[row[n]] + begin
        fits = at + window <= first[row[n] + 1]
        n, begin, at = n[fits], begin[fits], at[fits]
        order = np.argsort(at, kind="stable")
        n, begin, at = n[order], begin[order], at[order]
        one, two = span_hashes(hashes, at, at + window), span_hashes(hashes, at, at + window, SECOND)
        return {"one": one.view(np.int64), "two": two.view(np.int64) >> 32, "doc_id": rows_of(batch, "doc_id", lo, hi).take(pa.array(row[n])), "tag": rows_of(batch, "tag", lo, hi).take(pa.array(row[n])), "start": begin}

    return map_slices(base, "one long, two int, doc_id long, tag long, start long", work, packed=True)


def greedy(copies: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Join copies (start, end, source, source start), ascending, into factors: go on with one source and shift while they adjoin."""
    out: list[list[int]] = []
    for start, end, source, source_start in copies:
        if out and out[-1][2] == source and source_start - start == out[-1][3] - out[-1][0] and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        elif not out or end > out[-1][1]:
            out.append([start, end, source, source_start])
    return [(s, e - s, d, p) for s, e, d, p in out]


def parsed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, kept_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, factors)`` of every document; ``kept_text`` adds the text that is left."""
    if not GROUP < window < 256:
        raise ValueError(f"a window has {GROUP + 1} to 255 words")
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = narrow.filter("doc_id is not null and text is not null")
    # the route is enough of the anchor to find the anchors that may occur twice; what it mixes up is parted later
    twice = dealt_anew(indexed(known.select("text"), window, False).groupBy("route").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("route"))
    occurrences = indexed(known, window, True)
    found = written(occurrences.join(twice, F.shiftrightunsigned("anchor", 16) == twice["route"], "left_semi"))
    here = F.struct("doc_id", "tag", "place")
    several = found.groupBy("anchor").agg(F.min("block").alias("x"), F.max("block").alias("y")).filter("x != y").select("anchor")
    firsts = found.groupBy("anchor", "block").agg(F.min(here).alias("first"))
    later = found.join(dealt_anew(firsts), ["anchor", "block"]).filter(here != F.col("first"))
    later = later.select("doc_id", "tag", "place", F.col("first.doc_id").alias("source"), F.col("first.place").alias("source_place"))
    unsure = firsts.join(dealt_anew(several), "anchor", "left_semi").select("first.doc_id", "first.tag", "first.place")
    copies = later.unionByName(unsure, allowMissingColumns=True)
    copies = copies.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "source", "source_place")).alias("copies"))
    base = packed_texts(narrow, tagged=True).join(copies, ["doc_id", "tag"], "left")

    # one plan with the last join: the shuffled texts and copies are read again, not shuffled again
    opened = open_windows(base, window)
    there = F.struct("doc_id", "tag", "start")
    earliest = opened.groupBy("one", "two").agg(F.min(there).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = opened.join(dealt_anew(earliest), ["one", "two"]).filter(there != F.col("first"))
    again = again.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", F.col("first.doc_id").alias("source"), F.col("first.start").alias("source_start"))).alias("windows"))
    return finished(base.join(again, ["doc_id", "tag"], "left"), window, kept_text)


def finished(whole: DataFrame, window: int, kept_text: bool) -> DataFrame:
    factor = "array<struct<start:long,length:long,source:long,source_start:long>>"

    def work(batch, lo, hi, data, offsets):
        starts, ends, first = words(data, offsets)
        n = np.diff(first)
        row, copy = cells(batch.column(batch.schema.get_field_index("copies")), lo, hi)
        row_w, single = cells(batch.column(batch.schema.get_field_index("windows")), lo, hi)
        done = ~np.isnan(copy["source"].astype(float)) if len(row) else np.zeros(0, bool)
        place, source_place = copy["place"][done].astype(np.int64), copy["source_place"][done].astype(np.int64)
        entries = np.stack(
            [
                np.concatenate([row[done], row_w]),
                np.concatenate([place >> 8, single["start"].astype(np.int64)]),
                np.concatenate([(place >> 8) + (place & 255) + window - 1, single["start"].astype(np.int64) + window]),
                np.concatenate([copy["source"][done].astype(np.int64), single["source"].astype(np.int64)]),
                np.concatenate([source_place >> 8, single["source_start"].astype(np.int64)]),
            ],
            axis=1,
        )
        entries = entries[entries[:, 2] <= n[entries[:, 0]]] if len(entries) else entries
        entries = entries[np.lexsort((-entries[:, 2], entries[:, 1], entries[:, 0]))]
        step = np.zeros(len(starts) + 1, np.int32)
        np.add.at(step, first[entries[:, 0]] + entries[:, 1], 1)
        np.add.at(step, first[entries[:, 0]] + entries[:, 2], -1)
        gone = np.cumsum(step[:-1]) > 0
        # bytes of the kept words, each with one space after it; a word at the end of a text has none there
        keep = np.zeros(len(data) + 1, np.int8)
        np.add.at(keep, starts[~gone], 1)
        np.add.at(keep, np.minimum(ends[~gone], len(data)), -1)
        keep = np.cumsum(keep[:-1], dtype=np.int8) > 0
        tail = np.isin(ends, offsets[1:])
        blank = ends[~gone & ~tail]
        keep[blank] = True
        flat = data.copy()
        flat[blank] = 32
        flat = flat[keep].tobytes()
        bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
        bounds = bounds.tolist()
        left = [flat[a:b].removesuffix(b" ") for a, b in zip(bounds, bounds[1:])]
        factors: list[list] = [[] for _ in range(hi - lo)]
        edges = np.searchsorted(entries[:, 0], np.arange(hi - lo + 1)).tolist()
        for r, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                factors[r] = [dict(zip(("start", "length", "source", "source_start"), f)) for f in greedy(entries[a:b, 1:].tolist())]
        removed = np.concatenate([[0], np.cumsum(gone)])
        out = {"doc_id": rows_of(batch, "doc_id", lo, hi), "n_words": n, "n_removed": removed[first[1:]] - removed[first[:-1]], "kept_sha256": [hashlib.sha256(x).hexdigest() for x in left], "factors": factors}
        return out | {"kept": [x.decode("utf-8", "replace") for x in left]} if kept_text else out

    return map_slices(whole, f"doc_id long, n_words long, n_removed long, kept_sha256 string, factors {factor}" + ", kept string" * kept_text, work, packed=True)


def op1(docs: DataFrame) -> DataFrame:
    return parsed(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
