"""Many terms against many texts: batch search, and audits whose forbidden terms are a table.

A text holds a term if it contains it, whatever the case of ASCII letters. Two ways give the same pairs:

* **Automaton.** Distinct terms are taken in blocks of measured bytes; each block is broadcast, a task builds one
  Aho-Corasick automaton of it and walks every text once, whatever the number of terms. Nothing but hits is shuffled.
  More than eight blocks share passes: blocks are cut in the order of their terms' rarest groups (see below), and a text is
  walked by those blocks of a pass of which it holds a group.
* **Postings.** Where the terms are too many for a few such passes, each term is filed under the rarest of its
  three-character groups (by how many texts hold it) and meets only texts that hold this group; the pairs are then verified
  on the texts, where the terms are broadcast if their measured bytes allow it, else by a join. Groups that no term is filed under are dropped where they arise, by a bitmap of fixed size. Terms of fewer
  than three characters have no group and go through the automaton.

Defined cases: a null text holds no term; an empty text holds the empty term only; the empty term is in every text that
is not null; a null term is in none; texts that share a key are one document, which holds what any of them holds; equal
terms are found for each of their ids; a pair comes once; a very long text is walked in one pass, in time linear in its
length and hits; empty tables give no pair.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import broadcast_if_small
from .catalog import lower_ascii

AUTOMATON_BYTES = 1 << 20  # of terms in one automaton; its states take some fifty times as much in a worker
PASSES = 8  # automata, each a pass over the texts; more terms go through postings
POSTED_BYTES = 16 << 20  # of filed terms that one pass of postings holds in a worker; more than eight passes are joined
GROUP = 3
BITMAP_BITS = 23  # one mebibyte
BATCH_ROWS = 1000
MANY = 64  # terms of a group, beyond which it is walked by an automaton

_automata: dict[str, object] = {}


def numbered_terms(terms: DataFrame, term: str) -> DataFrame:
    """Distinct ``(term, bytes, block_key)`` in lower case, without nulls."""
    low = terms.select(lower_ascii(F.col(term).cast("string")).alias("term")).where("term is not null").distinct()
    return low.select("term", F.octet_length("term").alias("bytes"), F.xxhash64("term").alias("block_key"))


def _automaton(shared):
    """The automaton of a broadcast block, built once in each worker; only the last one is kept."""
    import ahocorasick

    if shared.id not in _automata:
        _automata.clear()
        built = ahocorasick.Automaton()
        for t in shared.value:
            if t:
                built.add_word(t, t)
        if len(built):
            built.make_automaton()
        _automata[shared.id] = built
    return _automata[shared.id]


class _Shared:
    """A broadcast and a name for it that is the same in every worker."""

    def __init__(self, spark: SparkSession, values: list):
        self._broadcast, self.id = spark.sparkContext.broadcast(values), uuid.uuid4().hex

    @property
    def value(self) -> list:
        return self._broadcast.value


def _terms_in(shared, text: str) -> list[str]:
    found = {t for _, t in built.iter(text)} if text and len(built := _automaton(shared)) else set()
    return [*found, ""] if "" in shared.value[:1] else [*found]


def _walk(docs: DataFrame, shared, terms_in=_terms_in) -> DataFrame:
    """``(key, term)`` of the terms of one block in each text of ``(key, text)``."""
    key_type = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t is not None:
                    own = terms_in(shared, t)
                    rows += [i] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["key", "term"])

    return docs.mapInArrow(run, f"key {key_type}, term string")


def _blocks(terms: DataFrame, limit: int) -> list[DataFrame]:
    """Terms in blocks of at most about ``limit`` bytes; a single longer term is a block's own weight."""
    size = terms.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n = max(1, -(-size // limit))
    return [terms.where(F.pmod("block_key", F.lit(n)) == k) for k in range(n)]


def by_automata(docs: DataFrame, terms: DataFrame, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """``(key, term)``: one pass over ``(key, text)`` per block of ``numbered_terms``."""
    spark, found = docs.sparkSession, None
    blocks = _blocks(terms, limit)
    if len(blocks) > PASSES:
        short = terms.where(F.char_length("term") < GROUP)
        entry = entries(docs, terms)
        parts = [_walk(docs, _Shared(spark, _cut(filed, limit)), _terms_by_blocks) for filed in _filed(entry, AUTOMATON_BYTES)]
        found, blocks = functools.reduce(DataFrame.unionByName, parts) if parts else None, _blocks(short, max(limit, AUTOMATON_BYTES))
    for block in blocks:
        values = sorted(r[0] for r in block.select("term").collect())  # a block of bounded bytes
        if not values:
            continue
        part = _walk(docs, _Shared(spark, values))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"key {docs.schema['key'].dataType.simpleString()}, term string")
    return found


def groups_of(text: str) -> np.ndarray:
    """The distinct groups of three characters of a text: 21 bits each, so equal codes are equal groups."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < GROUP:
        return np.zeros(0, np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def _slot(groups: np.ndarray) -> np.ndarray:
    return ((groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _exploded(rows: DataFrame, out: str, kept: np.ndarray | None = None) -> DataFrame:
    """``(out, gram)`` of each row ``(out, text)``; with a bitmap only the groups it may hold."""
    kind = rows.schema[out].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, counts = [], []
            for t in b.column(1).to_pylist():
                own = groups_of(t or "")
                if kept is not None:
                    at = _slot(own)
                    own = own[kept[at >> 3] >> (at & 7) & 1 == 1]
                grams.append(own)
                counts.append(len(own))
            if counts:
                row = np.repeat(np.arange(len(counts)), counts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.concatenate(grams), pa.int64())], names=[out, "gram"])

    return rows.mapInArrow(run, f"{out} {kind}, gram long")


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Which slots the groups fall into, as bits: of one size whatever the number of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP_BITS, bool)
        for b in batches:
            bits[_slot(b.column(0).to_numpy(zero_copy_only=False))] = True
        words = np.packbits(bits, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    words = np.zeros((1 << BITMAP_BITS) // 64, np.int64)
    for r in grams.select("gram").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():
        words[r["at"]] = r["bits"]
    return words.view(np.uint8)


def entries(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, gram)``: the rarest group of each term that has one; terms with a group that no text holds are left out."""
    long = cut_lineage(terms.where(F.char_length("term") >= GROUP).select("term"))
    grams = cut_lineage(_exploded(long.select("term", F.col("term").alias("t")), "term"))
    seen = _exploded(docs.where("text is not null"), "key", _bitmap(grams)).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a group that no text holds rules its term out; among the others the rarest one is the term's entry
    entry = grams.join(seen, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("e"))
    return cut_lineage(entry.where("e.n > 0").select("term", F.col("e.gram").alias("gram")))


def _filed(entry: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Filed terms in parts of about ``limit`` bytes, each sorted by group and term."""
    for part in _blocks(entry.select("gram", "term", F.octet_length("term").alias("bytes"), F.xxhash64("term").alias("block_key")), limit):
        if rows := sorted(tuple(r) for r in part.select("gram", "term").collect()):  # a part of bounded bytes
            yield rows


def _cut(filed: list[tuple[int, str]], limit: int) -> list[list[tuple[int, str]]]:
    """Consecutive filed terms in blocks of at most ``limit`` bytes; a single longer term is a block of its own."""
    out, size = [], limit
    for gram, term in filed:
        own = len(term.encode("utf-8", "surrogatepass"))
        if size + own > limit:
            out.append([])
            size = 0
        out[-1].append((gram, term))
        size += own
    return out


def _once(shared, build):
    """What a worker builds of a broadcast, once; only the last one is kept."""
    if shared.id not in _automata:
        _automata.clear()
        _automata[shared.id] = build(shared.value)
    return _automata[shared.id]


def _at(grams: np.ndarray, text: str) -> np.ndarray:
    """Which of the sorted groups the text holds."""
    own = groups_of(text)
    at = np.searchsorted(grams, own)
    inside = at < len(grams)
    return at[inside][grams[at[inside]] == own[inside]]


def _automaton_of(terms: list[str]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for t in terms:
        built.add_word(t, t)
    built.make_automaton()
    return built


def _terms_by_blocks(shared, text: str) -> list[str]:
    """Terms of the blocks of which the text holds a group: each such block walks the text once."""

    def build(blocks):
        of: dict[int, list[int]] = {}
        for k, block in enumerate(blocks):
            for gram in {g for g, _ in block}:
                of.setdefault(gram, []).append(k)
        grams = np.array(sorted(of), np.int64)
        return grams, [of[g] for g in grams.tolist()], [_automaton_of([t for _, t in block]) for block in blocks]

    grams, of, built = _once(shared, build)
    near = {k for i in _at(grams, text).tolist() for k in of[i]}
    return [*{t for k in near for _, t in built[k].iter(text)}]


def _terms_by_groups(shared, text: str) -> list[str]:
    """Terms that are filed under a group of the text, and that it holds; groups of many terms have an automaton."""

    def build(filed):
        of: dict[int, list[str]] = {}
        for gram, term in filed:
            of.setdefault(gram, []).append(term)
        grams = np.array(sorted(of), np.int64)
        return grams, [of[g] if len(of[g]) <= MANY else _automaton_of(of[g]) for g in grams.tolist()]

    grams, of = _once(shared, build)
    found: list[str] = []
    for i in _at(grams, text).tolist():
        found += [t for t in of[i] if t in text] if isinstance(of[i], list) else {t for _, t in of[i].iter(text)}
    return found


def by_postings(docs: DataFrame, terms: DataFrame, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """The same pairs by the rarest group of each term."""
    short = terms.where(F.char_length("term") < GROUP)
    held = docs.where("text is not null")
    entry = entries(docs, terms)
    size = entry.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    found = by_automata(docs, short, limit)
    if size <= PASSES * POSTED_BYTES:
        for filed in _filed(entry, POSTED_BYTES):
            found = found.unionByName(_walk(held, _Shared(docs.sparkSession, filed), _terms_by_groups))
        return found
    near = _exploded(held, "key", _bitmap(entry)).join(entry, "gram").select("key", "term").distinct()
    return found.unionByName(held.join(near, "key").where(F.contains("text", "term")).select("key", "term"))


def pairs(docs: DataFrame, terms: DataFrame, way: str | None = None, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """Distinct ``(key, term)`` of ``(key, text)`` and ``numbered_terms``; ``way`` is measured unless given."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(name)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(name, str(BATCH_ROWS))
    if way is None:
        size = terms.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        way = "automata" if size <= PASSES * limit else "postings"
    return (by_automata if way == "automata" else by_postings)(docs, terms, limit).distinct()


def search_many(
    docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query", way: str | None = None, limit: int = AUTOMATON_BYTES
) -> DataFrame:
    """``(query_id, key)``: which documents each query finds. The single query is ``catalog.search``."""
    rows = docs.select(F.col(key).alias("key"), lower_ascii(F.col(text).cast("string")).alias("text")).where("key is not null")
    asked = cut_lineage(queries.select(F.col(query_id).alias("asked"), lower_ascii(F.col(query).cast("string")).alias("term")).where("term is not null").distinct())
    found = pairs(rows, cut_lineage(numbered_terms(asked, "term")), way, limit)
    return found.join(broadcast_if_small(asked), "term").select(F.col("asked").alias(query_id), F.col("key").alias(key))


def forbidden_terms(df: DataFrame, terms: DataFrame, by: str, key: str, text: str, term: str = "term", way: str | None = None) -> DataFrame:
    """``(by, term, n_rows)``: how many rows of each group hold each forbidden term (in lower case). Rows have one key each."""
    rows = df.select(F.struct(F.col(by).alias("by"), F.col(key).alias("row")).alias("key"), lower_ascii(F.col(text).cast("string")).alias("text"))
    found = pairs(rows, cut_lineage(numbered_terms(terms, term)), way)
    return found.groupBy(F.col("key.by").alias(by), "term").agg(F.count(F.lit(1)).alias("n_rows"))


def audit(df: DataFrame, terms: DataFrame, by: str, key: str, text: str, term: str = "term", json_from_brace: bool = False, way: str | None = None) -> DataFrame:
    """``deid.privacy_audit`` with the forbidden terms of a table: rows with any of them are counted once."""
    from .deid import privacy_audit

    rows = df.select(F.struct(F.col(by).alias("by"), F.col(key).alias("row")).alias("key"), lower_ascii(F.col(text).cast("string")).alias("text"))
    found = pairs(rows, cut_lineage(numbered_terms(terms, term)), way).select("key").distinct()
    counts = found.groupBy(F.col("key.by").alias("__by")).agg(F.count(F.lit(1)).alias("forbidden_literal"))
    report = privacy_audit(df, by, text, json_from_brace=json_from_brace)
    return report.join(counts, report[by].eqNullSafe(counts["__by"]), "left").select(*report.columns, F.coalesce("forbidden_literal", F.lit(0)).cast("long").alias("forbidden_literal"))


def words_of(text: Column, least: int = 1) -> Column:
    """Distinct runs of letters and digits, as a source of terms."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), lambda w: F.char_length(w) >= least)
