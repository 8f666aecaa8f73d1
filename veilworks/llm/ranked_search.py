"""Ranked lexical search over a length-stratified index, in whole numbers.

A document's score for an item is the sum of ``w * ((SCALE * tf) div (1000 * tf + 20 * m))`` over the item's terms; ``m`` is
the document's length normaliser and ``w`` a term's weight. So a term's impact depends on two small numbers only. The
index groups documents by equal ``m``, and inside such a stratum each term's postings by ``tf``: an impact is computed
once per tf and holds for a whole run of postings.

1. One pass over the documents counts their terms and keeps those that items hold (terms of a block of items, broadcast;
   matches are compared byte by byte). Statistics are aggregates over all documents.
2. Rows are shuffled by ``(m, doc_id)`` ranges, so a stratum that holds a third of the documents is many tasks, and each
   task writes blocks of one stratum of at most ``BLOCK_DOCS`` documents: the index, a table.
3. A block's bound for an item is what its greatest tf of each term would give together. The ``FIRST`` blocks of greatest
   bound are visited first for each item; the score of the last place there is a limit for all others.
4. Every other block whose bound reaches the limit is visited, those of one task in the order of their bounds, and the
   limit rises as places fill. No document that could be in the result is left out: bounds are never below a score.

Items are taken in blocks of ``BLOCK_BYTES`` of terms, so what is sent to the tasks does not grow with their number.

Defined cases: a null or empty text has no term and is in no result; an item without terms, or whose terms no document
holds, has no row; rows of items with one id are one item with all their terms; rows of documents with one id, or equal
rows, are documents of their own, each with a rank; equal scores go by ascending id; documents of null id count in the
statistics and are not returned, items of null id are not searched; a very long text is one row of one task; extra
columns are not read; empty tables give no row.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import lowered, map_slices, rows_of, runs, span_hashes
from .tables import written

TOP = 50
SCALE = 1_000_000_000
FIRST = 4  # blocks of greatest bound that are visited first for each item
BLOCK_DOCS = 8192
BLOCK_BYTES = 4 << 20
BATCH_BLOCKS = 32  # index blocks in one Arrow batch
# terms are runs of digits, Latin letters and non-ASCII characters
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Terms:
    """The terms of a block of items: found by hash, compared by bytes."""

    hashes: np.ndarray  # ascending
    code: np.ndarray  # of each hash
    data: np.ndarray  # bytes of the terms in the order of their codes
    begin: np.ndarray  # of each code in data, one more at the end
    seed: int


@dataclass
class Items:
    """Items as ranges of term codes."""

    ids: np.ndarray
    begin: np.ndarray
    code: np.ndarray
    weight: np.ndarray  # of each code


def vocabulary(terms: list[str]) -> Terms:
    """Terms with hashes that differ: another seed is taken if two agree."""
    data = [t.encode() for t in terms]
    begin = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(t) for t in data], out=begin[1:])
    flat = np.frombuffer(b"".join(data), np.uint8)
    seed = 1
    while len(np.unique(hashes := span_hashes(flat, begin[:-1], begin[1:], seed))) < len(data):
        seed += 2
    order = np.argsort(hashes)
    return Terms(hashes[order], order, flat, begin, seed)


def known_words(terms: Terms, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are terms, and the code of each of these."""
    if not len(terms.hashes) or not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = span_hashes(low, starts, ends, terms.seed)
    at = np.minimum(np.searchsorted(terms.hashes, key), len(terms.hashes) - 1)
    word = np.flatnonzero(terms.hashes[at] == key)
    code = terms.code[at[word]]
    size = ends[word] - starts[word]
    same = size == terms.begin[code + 1] - terms.begin[code]
    word, code, size = word[same], code[same], size[same]
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    differ = low[np.repeat(starts[word], size) + inside] != terms.data[np.repeat(terms.begin[code], size) + inside]
    same = np.ones(len(word), bool)
    same[np.repeat(np.arange(len(word)), size)[differ]] = False
    return word[same], code[same]


def small_ints(values: np.ndarray) -> bytes:
    """One byte each if they fit, four otherwise."""
    return values.astype(np.uint8 if not len(values) or values.max() < 256 else "<u4").tobytes()


def ints(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == count else "<u4").astype(np.int64)


def counted(docs: DataFrame, terms: Terms, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, codes, tfs)`` of every document: its number of terms, and how often it holds each known one."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batch, lo, hi, data, offsets):
        starts, ends, first = runs(IN_TERM[data], offsets)
        word, code = known_words(shared.value, lowered(data), starts, ends)
        row = np.searchsorted(first, word, "right") - 1
        size = max(len(shared.value.code), 1)
        pair, tf = np.unique(row * size + code, return_counts=True)
        cut = np.searchsorted(pair, np.arange(hi - lo + 1) * size)
        codes = (pair % size).astype("<u4").tobytes()
        out = [(codes[4 * a : 4 * b], small_ints(tf[a:b])) for a, b in zip(cut.tolist(), cut[1:].tolist())]
        return {"doc_id": rows_of(batch, "doc_id", lo, hi), "n": np.diff(first).astype(np.int64), "codes": [x[0] for x in out], "tfs": [x[1] for x in out]}

    return map_slices(narrow, "doc_id long, n long, codes binary, tfs binary", work)


def document_frequencies(table: DataFrame) -> DataFrame:
    """``(code, df)``: one row per code and task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            now = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").astype(np.int64))
            if len(now) > len(total):
                total, now = now, total
            total[: len(now)] += now
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "df"])

    return table.select("codes").mapInArrow(run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df"))


INDEX = "block long, m long, n_docs int, ids binary, terms binary, tops binary, term_runs binary, run_tfs binary, run_begin binary, docs binary"


def index_block(block: int, m: int, ids: list[int], codes: list[bytes], tfs: list[bytes]) -> tuple:
    """Documents of one stratum as postings by term, by falling tf inside a term."""
    count = np.array([len(c) // 4 for c in codes])
    term = np.frombuffer(b"".join(codes), "<u4").astype(np.int64)
    tf = np.concatenate([ints(t, n) for t, n in zip(tfs, count.tolist())])
    doc = np.repeat(np.arange(len(ids)), count)
    order = np.lexsort((doc, -tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    new_term = np.diff(term, prepend=-1) != 0
    run = np.flatnonzero(new_term | (np.diff(tf, prepend=-1) != 0))
    head = np.flatnonzero(new_term)
    as_bytes = [np.asarray(a).astype(t).tobytes() for a, t in ((ids, "<i8"), (term[head], "<u4"), (tf[head], "<u4"), (np.append(np.searchsorted(run, head), len(run)), "<u4"), (tf[run], "<u4"), (np.append(run, len(doc)), "<u4"), (doc, "<u2"))]
    return (block, m, len(ids), *as_bytes)


def stratified(table: DataFrame) -> DataFrame:
    """The index of ``(doc_id, m, codes, tfs)``: rows are blocks of one stratum."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, held = TaskContext.get().partitionId() << 32, None, ([], [], [])

        def done() -> pa.RecordBatch:
            row = index_block(number, now, *held)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for b in batches:
            for m, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held[0] and (m != now or len(held[0]) == BLOCK_DOCS):
                    yield done()
                    number, held = number + 1, ([], [], [])
                now = m
                for column, value in zip(held, row):
                    column.append(value)
        if held[0]:
            yield done()

    rows = table.select("m", "doc_id", "codes", "tfs").repartitionByRange("m", "doc_id").sortWithinPartitions("m", "doc_id", "codes", "tfs")
    return rows.mapInArrow(run, INDEX)


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """What a term of weight one gives; computed once per distinct tf."""
    each, place = np.unique(tf, return_inverse=True)
    return ((SCALE * each) // (1000 * each + 20 * m))[place]


def bounds(items: Items, m: int, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """The most that a document of the block can score for each item."""
    at = np.minimum(np.searchsorted(terms, items.code), len(terms) - 1)
    most = np.where(terms[at] == items.code, items.weight[items.code] * impacts(tops, m)[at], 0)
    sums = np.concatenate([[0], np.cumsum(most)])
    return sums[items.begin[1:]] - sums[items.begin[:-1]]


class Places:
    """The best documents of each item so far."""

    def __init__(self, limits: np.ndarray, top: int):
        self.limit, self.top = limits.copy(), top
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        if item in self.held:
            score, ids = np.concatenate([self.held[item][0], score]), np.concatenate([self.held[item][1], ids])
        order = np.lexsort((ids, -score))[: self.top]
        self.held[item] = score[order], ids[order]
        if len(order) == self.top:
            self.limit[item] = max(self.limit[item], score[order[-1]])


def visit(block: dict, items: Items, i: int, places: Places) -> None:
    """Score the documents of a block for item i."""
    code = items.code[items.begin[i] : items.begin[i + 1]]
    at = np.minimum(np.searchsorted(block["terms"], code), len(block["terms"]) - 1)
    has = block["terms"][at] == code
    at, code = at[has], code[has]
    n_runs = block["term_runs"][at + 1] - block["term_runs"][at]
    run = np.repeat(block["term_runs"][at] - (np.cumsum(n_runs) - n_runs), n_runs) + np.arange(int(n_runs.sum()))
    gain = np.repeat(items.weight[code], n_runs) * block["impact"][run]
    size = block["run_begin"][run + 1] - block["run_begin"][run]
    posting = np.repeat(block["run_begin"][run] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    score = np.zeros(block["n_docs"], np.int64)
    np.add.at(score, block["docs"][posting], np.repeat(gain, size))
    found = np.flatnonzero(score >= places.limit[i])
    if len(found) > places.top:
        least = np.partition(score[found], len(found) - places.top)[len(found) - places.top]
        found = found[score[found] >= least]
    if len(found):
        places.add(i, score[found], block["ids"][found])


def visits(index: DataFrame, items: Items, limits: np.ndarray, top: int, skip: set[tuple[int, int]] = frozenset(), only: set[tuple[int, int]] | None = None) -> DataFrame:
    """``(item, doc_id, score)``: the best of each task, from its blocks in the order of their bounds."""
    shared = index.sparkSession.sparkContext.broadcast((items, limits, skip, only))
    whole = {"ids": "<i8", "terms": "<u4", "tops": "<u4", "term_runs": "<u4", "run_tfs": "<u4", "run_begin": "<u4", "docs": "<u2"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, limits, skip, only = shared.value
        places = Places(limits, top)
        for b in batches:
            blocks, pairs = [], []
            for row in b.to_pylist():
                block = row | {k: np.frombuffer(row[k], t).astype(np.int64) for k, t in whole.items()}
                block["impact"] = impacts(block["run_tfs"], row["m"])
                most = bounds(items, row["m"], block["terms"], block["tops"])
                some = np.flatnonzero((most >= places.limit) & (most > 0)).tolist()
                pairs += [(-int(most[i]), len(blocks), i) for i in some if (row["block"], i) not in skip and (only is None or (row["block"], i) in only)]
                blocks.append(block)
            for most, k, i in sorted(pairs):
                if -most >= places.limit[i]:
                    visit(blocks[k], items, i, places)
        for i, (score, ids) in places.held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids), pa.array(score)], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def first_blocks(index: DataFrame, items: Items) -> set[tuple[int, int]]:
    """(block, item) of the blocks of greatest bound of each item: the best of each task, then the best of these."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = np.zeros((0, len(items.ids)), np.int64)
        name = np.zeros((0, len(items.ids)), np.int64)
        for b in batches:
            for block, m, terms, tops in zip(*(c.to_pylist() for c in b.columns)):
                now = bounds(items, m, np.frombuffer(terms, "<u4").astype(np.int64), np.frombuffer(tops, "<u4").astype(np.int64))
                best, name = np.vstack([best, now]), np.vstack([name, np.full(len(now), block)])
                if len(best) > 16 * FIRST:
                    order = np.argsort(-best, axis=0, kind="stable")[:FIRST]
                    best, name = np.take_along_axis(best, order, 0), np.take_along_axis(name, order, 0)
        order = np.argsort(-best, axis=0, kind="stable")[:FIRST]
        best, name = np.take_along_axis(best, order, 0), np.take_along_axis(name, order, 0)
        place, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(name[place, item]), pa.array(best[place, item])], names=["item", "block", "bound"])

    found = index.select("block", "m", "terms", "tops").mapInArrow(run, "item long, block long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= FIRST)
    return {(r["block"], r["item"]) for r in best.select("item", "block").collect()}  # FIRST rows an item of this block of items


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of few rows for the steps that run inside, where a row is a block of an index."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``(item_id, term)``."""
    low = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    rows = items.select(F.col(key).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    return rows.filter("item_id is not null").distinct()


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of the best documents of every item."""
    spark = docs.sparkSession
    terms = written(item_terms(items))
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found, totals = None, None
    for k in range(blocks):
        rows = sorted((r[0], r[1]) for r in terms.filter(F.expr(f"pmod(xxhash64(item_id), {blocks})") == k).collect())
        words = sorted({t for _, t in rows})
        number = {t: i for i, t in enumerate(words)}
        ids, begin = np.unique(np.array([i for i, _ in rows], np.int64), return_index=True)
        table = written(counted(docs, vocabulary(words), key, text))
        if totals is None:
            totals = table.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        n_docs, length = totals
        if not rows or not n_docs:
            continue
        weight = np.zeros(len(words), np.int64)
        for code, df in document_frequencies(table).collect():  # a row per term of this block of items
            weight[code] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        own = Items(ids, np.append(begin, len(rows)), np.array([number[t] for _, t in rows], np.int64), weight)
        held = table.filter("doc_id is not null and octet_length(codes) > 0")
        index = written(stratified(held.withColumn("m", F.expr(f"50L + (50L * n * {n_docs}L) div {length}L"))))
        with batch_rows(spark, BATCH_BLOCKS):
            first = first_blocks(index, own)
            ones = np.ones(len(ids), np.int64)
            chosen = index.filter(F.col("block").isin(sorted({b for b, _ in first})))
            wave = written(visits(chosen, own, ones, top, only=first))
            order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
            limits = ones.copy()
            for r in wave.withColumn("r", F.row_number().over(order)).filter(F.col("r") == top).collect():  # at most one an item
                limits[r["item"]] = r["score"]
            rest = written(visits(index, own, limits, top, skip=first))
        name = F.broadcast(spark.createDataFrame(list(enumerate(ids.tolist())), "item long, item_id long"))  # one row an item of this block
        part = wave.unionByName(rest).join(name, "item").select("item_id", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)
