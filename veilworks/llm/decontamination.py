"""Benchmark decontamination: an inverted index of test items, queried by every training passage with block-max WAND.

Items are scored by BM25, and an item's score is divided by the score it gives itself, so 1 means that every term of the
item is in the passage and one threshold fits long and short items. Postings are sorted by item in blocks with a
stored maximum. Passages are overlapping windows of a document; a window is two and a half times the longest item, so
every copy, also one with words put in, lies in one. Whole slices of passages are first bounded together: frequent terms, whose summed weight stays below the
threshold in every item, cannot reach it alone, so only passages where the other terms can are walked.

The overlap of a retrieved item, its question or its answer (the last sentence; an item of one sentence has no answer)
with a passage is the share of its word groups there or, if larger, the share of its words less the fewest words to
change, drop or put in to find it in one piece (bit-parallel, over the whole passage). An item counts as a leak if
``OVERLAP`` is reached by the whole of it, by question and answer, or by the question alone if it is longer than the
answer. So no edited word and no missing or other last sentence of a few words loses an item of five words or more,
as long as its score reaches the threshold.

The index holds the items only. It is broadcast in blocks of about ``BLOCK_BYTES`` of item text; a larger test set is
taken in several passes over the documents, each with an index of bounded size. Document frequencies, the number of items,
their mean and longest length are aggregates over the whole test set, so scores do not depend on the blocks. No document row moves.

Defined cases: words are runs of letters, digits and non-ASCII characters in lower case; a null or empty text or item
matches nothing; equal texts of different ids are found each, rows equal in id and text are one item; rows with one id are searched each and reported once per item with their
best score; null ids are not reported; extra columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import map_batches, map_slices, rows_of, slices, span_hashes, words
from .tables import written

THRESHOLD = 0.5  # a question without its answer may hold little more than half of an item's score
OVERLAP = 0.8
GROUP = 5
STRIDE = 64
POSTING_BLOCK = 16
BLOCK_BYTES = 16 << 20
K1, B = 1.2, 0.75
BREAK = np.ones(256, bool)
BREAK[48:58] = BREAK[65:91] = BREAK[97:123] = BREAK[128:] = False


def low_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, end of each text in words, and where a word closes a sentence."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts, ends, first = words(data, offsets, BREAK)
    after = np.append(data, 32)[ends]
    return span_hashes(data, starts, ends), first, np.isin(after, np.frombuffer(b".!?", np.uint8))


def word_groups(hashes: np.ndarray) -> set[int]:
    k = min(GROUP, len(hashes))
    if not k:
        return set()
    at = np.arange(len(hashes) - k + 1)
    return set(span_hashes(hashes, at, at + k).tolist())


@dataclass
class Index:
    items: np.ndarray  # item ids
    terms: np.ndarray  # hashes, ascending
    begin: np.ndarray  # first posting of each term
    item: np.ndarray  # posting: item number, ascending within a term
    weight: np.ndarray  # posting: share of the item's own score
    lists: list[list[int]]  # the postings of each term again, for walking: items
    weights: list[list[float]]  # and weights
    tops: list[float]  # largest weight of each term
    block_top: list[list[float]]  # of each term: largest weight of each block of postings
    rare: np.ndarray  # whether a term can lift an item over the threshold
    slack: np.ndarray  # item: summed weight of its other terms
    question: list[set[int]]
    answer: list[set[int]]
    sizes: list[tuple[int, int]]  # words in a group of question and answer
    words: list[list[int]]  # the item's words in order
    cut: list[int]  # words of the question
    stride: int


@dataclass
class Whole:
    """Statistics of the whole test set, and the document frequencies of the terms of one block."""

    items: int
    words: int
    longest: int
    terms: np.ndarray  # ascending
    df: np.ndarray


def build(rows: list[tuple[int, str]], threshold: float, whole: Whole | None = None) -> Index | None:
    """Index of a block of items; without statistics the block is the whole test set."""
    hashes, first, closes = low_words([t or "" for _, t in rows])
    own = [hashes[a:b] for a, b in zip(first, first[1:])]
    kept = [i for i, h in enumerate(own) if len(h)]
    if not kept:
        return None
    question, answer, sizes, cuts_ = [], [], [], []
    for i in kept:
        stops = np.flatnonzero(closes[first[i] : first[i + 1] - 1])
        cut = int(stops[-1]) + 1 if len(stops) else len(own[i])
        question.append(word_groups(own[i][:cut]))
        answer.append(word_groups(own[i][cut:]))
        sizes.append((min(GROUP, cut), min(GROUP, len(own[i]) - cut)))
        cuts_.append(cut)
    own = [own[i] for i in kept]
    length = np.array([len(h) for h in own], float)
    flat = np.concatenate(own)
    number = np.repeat(np.arange(len(own)), length.astype(int))
    terms, term = np.unique(flat, return_inverse=True)
    pair, tf = np.unique(term.astype(np.int64) * len(own) + number, return_counts=True)
    term, item = pair // len(own), pair % len(own)
    if whole is None:
        whole = Whole(len(own), len(flat), int(length.max()), terms, np.bincount(term, minlength=len(terms)))
    df = whole.df[np.searchsorted(whole.terms, terms)]
    idf = np.log1p((whole.items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] * whole.items / whole.words))
    weight /= np.bincount(item, weight, len(own))[item]
    begin = np.searchsorted(term, np.arange(len(terms) + 1))
    top = np.maximum.reduceat(weight, begin[:-1])
    cuts = list(zip(begin, begin[1:]))
    blocks = [np.maximum.reduceat(weight[a:b], np.arange(0, b - a, POSTING_BLOCK)).tolist() for a, b in cuts]
    lists, weights = ([x[a:b].tolist() for a, b in cuts] for x in (item, weight))
    # as many of the most frequent terms as leave every item below the threshold
    rare, slack = np.ones(len(terms), bool), np.zeros(len(own))
    for t in np.argsort(-df, kind="stable"):
        a, b = begin[t], begin[t + 1]
        grown = slack[item[a:b]] + weight[a:b]
        if (grown >= threshold * 0.9).any():
            break
        slack[item[a:b]] = grown
        rare[t] = False
    return Index(np.array([rows[i][0] for i in kept]), terms, begin, item, weight, lists, weights, top.tolist(), blocks, rare, slack, question, answer, sizes, [h.tolist() for h in own], cuts_, max(STRIDE, int(whole.longest * 1.25) + 1))


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items whose score over the terms reaches the threshold, with the scores."""
    items, weights, tops, top = index.lists, index.weights, index.block_top, index.tops
    cursors = [[items[t][0], t, 0] for t in terms]  # current item, term, posting

    def forward(c: list[int], to: int) -> None:
        own = items[c[1]]
        c[2] = bisect_left(own, to, c[2])
        c[0] = own[c[2]] if c[2] < len(own) else 1 << 60

    found = []
    while True:
        cursors = sorted(c for c in cursors if c[0] < 1 << 60)
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += top[c[1]]
            if bound >= threshold:
                pivot = k
                break
        if pivot < 0:
            return found
        target = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
            pivot += 1
        bound, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
        for c in cursors[: pivot + 1]:
            own = items[c[1]]
            at = bisect_left(own, target, c[2])
            if at >= len(own):
                continue
            block = at // POSTING_BLOCK
            bound += tops[c[1]][block]
            until = min(until, own[min(len(own), (block + 1) * POSTING_BLOCK) - 1] + 1)
        if bound < threshold:  # no item up to the end of these blocks
            to = max(until, target + 1)
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    forward(c, to)
        elif cursors[0][0] == target:
            score = sum(weights[c[1]][c[2]] for c in cursors[: pivot + 1])
            if score >= threshold:
                found.append((target, score))
            for c in cursors[: pivot + 1]:
                forward(c, target + 1)
        else:
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    forward(c, target)


def in_order(want: list[int], passage: list[int]) -> float:
    """1 - (fewest words to change, drop or put in, so that ``want`` is a piece of the passage) / words.

    Myers' bit vectors: bit i of ``up`` and ``down`` tells whether a prefix of i + 1 words costs one more or one less
    than the prefix before it, at the current word of the passage; a match may start anywhere.
    """
    n = len(want)
    at: dict[int, int] = {}
    for i, w in enumerate(want):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, cost, least = full, 0, n, n
    for w in passage:
        same = at.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        more = down | (full & ~(across | up))
        less = up & across
        if more & top:
            cost += 1
        elif less & top:
            cost -= 1
            least = min(least, cost)
        more, less = (more << 1) & full, (less << 1) & full
        kept = same | down
        up = less | (full & ~(kept | more))
        down = more & kept
    return 1 - least / n


def overlaps(index: Index, i: int, passage: np.ndarray, groups: dict[int, set[int]], overlap: float) -> tuple[float, float] | None:
    """Overlaps of question and answer of a leaked item; ``groups`` keeps the passage's word groups by size."""
    shares = []
    for want, size in zip((index.question[i], index.answer[i]), index.sizes[i]):
        if size and size not in groups:
            k = np.arange(max(0, len(passage) - size + 1))
            groups[size] = set(span_hashes(passage, k, k + size).tolist())
        shares.append(len(want & groups[size]) / len(want) if size else 1.0)
    if min(shares) < overlap:
        own, cut, text = index.words[i], index.cut[i], passage.tolist()
        for k, part in enumerate((own[:cut], own[cut:])):
            if part:
                shares[k] = max(shares[k], in_order(part, text))
        mostly = shares[0] >= overlap and (shares[1] >= overlap or 2 * cut > len(own))
        if not mostly and in_order(own, text) < overlap:
            return None
    return shares[0], shares[1]


def leaks_of(index: Index, texts: list[str], threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item number) -> (score, question overlap, answer overlap) of the verified items of some texts."""
    hashes, first, _ = low_words(texts)
    if not len(hashes):
        return {}
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    place = np.flatnonzero(index.terms[at] == hashes)
    term = at[place]
    row = np.searchsorted(first, place, side="right") - 1
    # windows: the n-th of a row holds words [n * stride, (n + 2) * stride); of each row one more than strides
    strides = np.diff(first) // index.stride + 1
    base = np.cumsum(strides) - strides
    own = base[row] + (place - first[row]) // index.stride
    inner = (place - first[row]) >= index.stride
    pair = np.unique(np.concatenate([own, own[inner] - 1]).astype(np.int64) * len(index.terms) + np.concatenate([term, term[inner]]))
    window, term = pair // len(index.terms), pair % len(index.terms)
    rare = index.rare[term]
    n = (index.begin[1:] - index.begin[:-1])[term[rare]]
    posting = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.begin[term[rare]], n)
    key, slot = np.unique(np.repeat(window[rare], n) * len(index.items) + index.item[posting], return_inverse=True)
    reach = np.bincount(slot, index.weight[posting], len(key)) + index.slack[key % len(index.items)]
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    edges = np.searchsorted(window, np.arange(int(strides.sum()) + 1))
    for w in np.unique(key[reach >= threshold] // len(index.items)).tolist():
        r = int(np.searchsorted(base, w, side="right")) - 1
        begin = int(first[r]) + (w - int(base[r])) * index.stride
        passage = hashes[begin : min(begin + 2 * index.stride, int(first[r + 1]))]
        groups: dict[int, set[int]] = {}
        for i, score in block_max_wand(index, term[edges[w] : edges[w + 1]].tolist(), threshold):
            shares = overlaps(index, i, passage, groups, overlap)
            if shares:
                out[r, i] = max(out.get((r, i), (0.0, 0.0, 0.0)), (score, *shares))
    return out


def item_blocks(items: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """``(block, item_id, text)`` of the different test items, in blocks of about equal bytes, and how many there are."""
    rows = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).filter("item_id is not null and text is not null")
    rows = written(rows.distinct())
    n = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    return rows.withColumn("block", F.expr(f"pmod(xxhash64(item_id, text), {max(n, 1)})").cast("int")), n


def item_terms(blocks: DataFrame) -> DataFrame:
    """``(block, n_words, terms)`` of every item with words: its different terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, _ in slices(b):
                hashes, first, _ = low_words(rows_of(b, "text", lo, hi).to_pylist())
                own = [np.unique(hashes[x:y]).view(np.int64) for x, y in zip(first, first[1:])]
                columns = [rows_of(b, "block", lo, hi), pa.array(np.diff(first).astype(np.int64)), pa.array(own, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "n_words", "terms"])

    return map_batches(blocks.select("block", "text"), run, "block int, n_words long, terms array<long>").filter("n_words > 0")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` of every verified leak."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    for shared in indexes(items, threshold):

        def work(batch, lo, hi, data, offsets, shared=shared):
            hits = leaks_of(shared.value, [t or "" for t in rows_of(batch, "text", lo, hi).to_pylist()], threshold, overlap)
            if not hits:
                return None
            rows, numbers = (np.array([k[j] for k in hits]) for j in (0, 1))
            values = np.array(list(hits.values()))
            return {"doc_id": rows_of(batch, "doc_id", lo, hi).take(pa.array(rows)), "item_id": shared.value.items[numbers], "score": values[:, 0], "question_overlap": values[:, 1], "answer_overlap": values[:, 2]}

        found = found.unionByName(map_slices(narrow, schema, work))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def indexes(items: DataFrame, threshold: float):
    """A broadcast index for each block of items, one after another; the driver holds one block while its index is built."""
    blocks, n = item_blocks(items, "item_id", "text")
    if not n:
        return
    terms = written(item_terms(blocks))
    count, total, longest = terms.agg(F.count(F.lit(1)), F.sum("n_words"), F.max("n_words")).first()
    # counted per block first, so a frequent term is one row per block
    counts = terms.select("block", F.explode("terms").alias("term")).groupBy("term", "block").agg(F.count(F.lit(1)).alias("df"))
    counts = written(counts.withColumn("df", F.sum("df").over(Window.partitionBy("term"))))
    for k in range(n):
        known = counts.filter(F.col("block") == k).select("term", "df").toArrow()
        term, df = (known.column(c).to_numpy() for c in ("term", "df"))
        order = np.argsort(term.view(np.uint64))
        whole = Whole(count, total, longest, term.view(np.uint64)[order], df[order])
        index = build(sorted((r["item_id"], r["text"]) for r in blocks.filter(F.col("block") == k).collect()), threshold, whole)
        if index is not None:
            yield items.sparkSession.sparkContext.broadcast(index)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows, with all their columns, that hold no item; a filter where the rows are, once per block of items."""
    for shared in indexes(items, threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, hi, _, _ in slices(b, text):
                    keep[[lo + r for r, _ in leaks_of(shared.value, [t or "" for t in rows_of(b, text, lo, hi).to_pylist()], threshold, overlap)]] = False
                yield b.filter(pa.array(keep))

        docs = map_batches(docs, run, docs.schema)
    return docs


def op3(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items)
