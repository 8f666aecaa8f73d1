"""Language identification by interpolated Kneser-Ney character models, one per language.

Text is read as words of letters in lower case, each between word marks; a character is predicted from the three before
it. Counts of all learning documents are gathered by Spark; discounts, continuation counts and interpolation weights
are Spark aggregates. The tables are keyed by the whole gram (64 bits hold four characters) and grow with the input. Of
at most ``BROADCAST_BYTES``, as measured, they are sent to the tasks as sorted arrays. Larger ones stay Spark tables: the
texts are written in blocks with the distinct grams of each, the distinct grams of all blocks are joined order by order
with the tables, and each block gets back the probabilities of its grams. Both ways give equal results.

A document goes to the language of least cross-entropy per character (ties: first by name). Rejection is calibrated:
``accepted`` is false if the cross-entropy is above mean + 4 deviations of all learning documents of that language (the
deviation of a single one is 0), or if another language is as likely.

Defined cases: a null text or one without a letter is ``und`` with score 0 and not accepted, as is everything if nothing
can be learnt; null languages and ids teach nothing; repeated rows count as often as they occur and are predicted alike;
characters above U+FFFF are one letter; columns other than the named ones are not read.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrays import map_batches, map_slices, mix, rows_of, runs, slices, span_hashes
from .quality_classifier import bucket
from .tables import written

ORDER = 4
BROADCAST_BYTES = 64 << 20  # of model tables that are sent to every task; larger ones are joined
BLOCK_BYTES = 4 << 20  # of texts that are scored together where the tables are joined
MARK = 0x20
UNKNOWN = "und"
CERTAIN = 50  # characters up to which evidence adds up in the score


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case letter of each code point as 16 bits; MARK for what is no letter."""

    def one(c: str) -> int:
        low = c.lower()
        return MARK if not c.isalpha() else ord(low) if len(low) == 1 and ord(low) < 0xFFFF else ord(c) if ord(c) < 0xFFFF else 0xFFFF

    return np.fromiter((one(chr(c)) for c in range(0x110000)), np.uint16, 0x110000)


def distinct_words(data: np.ndarray, offsets: np.ndarray, salt: np.ndarray | None = None):
    """(row and number of each word, characters of the distinct words, their starts and ends).

    ``salt``: words of rows with different salts are different.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low = letters()[points]
    starts, ends, first = runs(low != MARK, upto)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    key = span_hashes(low, starts, ends)
    number, kinds = pd.factorize(key if salt is None else key ^ salt[row])
    at = np.empty(len(kinds), np.int64)
    at[number[::-1]] = np.arange(len(number))[::-1]
    return row, number, low, starts[at], ends[at], row[at]


def grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ORDER characters (16 bits each) that predict each character and the end of each word; word of each."""
    size = ends - starts
    full = size + ORDER  # ORDER - 1 marks before, one behind
    word = np.repeat(np.arange(len(size)), full)
    place = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full) - (ORDER - 1)
    inside = (place >= 0) & (place < size[word])
    text = np.full(len(place), MARK, np.uint64)
    text[inside] = low[(starts[word] + place)[inside]]
    code = text.copy()
    for k in range(1, ORDER):
        code[k:] |= text[:-k] << np.uint64(16 * k)
    real = place >= 0
    return code[real], word[real]


def slot(code: np.ndarray, order: int) -> np.ndarray:
    """Key of a gram in the table of its order: the gram itself, so no two grams share one."""
    return tail(code, order).view(np.int64)


def tail(code: np.ndarray, n: int) -> np.ndarray:
    return code & np.uint64((1 << (16 * n)) - 1) if n < 4 else code


@dataclass
class Models:
    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted keys, discounted share by language
    contexts: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted keys, weight of the lower order by language
    floor: np.ndarray  # by language: probability that an unseen character gets
    limits: np.ndarray | None = None  # by language: largest accepted cross-entropy

    def log2(self, code: np.ndarray) -> np.ndarray:
        """log2 of the interpolated probability of the last character of each gram, by language."""
        p = np.broadcast_to(self.floor, (len(code), len(self.languages)))
        for n in range(1, ORDER + 1):
            share = self.at(self.grams[n - 1], slot(tail(code, n), n), 0.0)
            weight = self.at(self.contexts[n - 1], slot(tail(code >> np.uint64(16), n - 1), n), 1.0) if n > 1 else 1.0
            p = share + weight * p
        return np.log2(np.maximum(p, 1e-12))

    def at(self, table: tuple[np.ndarray, np.ndarray], slots: np.ndarray, missing: float) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.full((len(slots), len(self.languages)), missing)
        i = np.minimum(np.searchsorted(keys, slots), len(keys) - 1)
        return np.where((keys[i] == slots)[:, None], values[i], missing)

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text by language, and its number of predicted characters."""
        row, number, low, starts, ends, _ = distinct_words(data, offsets)
        n = len(offsets) - 1
        bits = np.zeros((n, len(self.languages)))
        if not len(row):
            return bits, np.zeros(n)
        code, word = grams(low, starts, ends)
        which, kinds = pd.factorize(code)
        table = -self.log2(kinds)
        begin = np.searchsorted(word, np.arange(len(starts)))
        for k in range(len(self.languages)):
            own = np.add.reduceat(table[:, k][which], begin)
            bits[:, k] = np.bincount(row, own[number], n)
        return bits, np.bincount(row, (ends - starts + 1)[number], n)


@dataclass
class Scores(Models):
    """The probabilities of some grams as they come from the joined tables: ``grams`` holds one table of whole grams."""

    def log2(self, code: np.ndarray) -> np.ndarray:
        return np.log2(np.maximum(self.at(self.grams[0], code.view(np.int64), np.nan), 1e-12))


@dataclass
class Tables:
    """The same models as Spark tables ``(order, lang, code, value)``; ``lang`` is the number of the language."""

    languages: list[str]
    grams: DataFrame
    contexts: DataFrame
    floor: np.ndarray
    limits: np.ndarray | None = None

    def size(self) -> int:
        """Most bytes of the sorted arrays: as if no two languages shared a gram."""
        return (self.grams.count() + self.contexts.count()) * (8 + 4 * len(self.languages))

    def collected(self) -> Models:
        return Models(self.languages, arrays_of(self.grams, self.languages, 0.0), arrays_of(self.contexts, self.languages, 1.0), self.floor, self.limits)

    def scored(self, codes: DataFrame) -> DataFrame:
        """``(code, p)``: the probabilities by language of distinct grams, as ``Models.log2`` computes them."""

        def by_code(table: DataFrame, n: int, missing: float, name: str) -> DataFrame:
            own = table.filter(F.col("order") == n).groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("lang", "value"))).alias("m"))
            values = F.transform(F.sequence(F.lit(0), F.lit(len(self.languages) - 1)), lambda k: F.coalesce(F.try_element_at("m", k).cast("double"), F.lit(missing)))
            return own.select("code", values.alias(name))

        def constant(values) -> F.Column:
            return F.array(*[F.lit(float(v)) for v in values])

        none, whole = constant([0.0] * len(self.languages)), constant([1.0] * len(self.languages))
        levels = [codes]
        for n in range(ORDER - 1, 0, -1):
            levels.append(levels[-1].select(F.col("code").bitwiseAND(F.lit((1 << (16 * n)) - 1)).alias("code")).distinct())
        lower = None
        for n, level in zip(range(1, ORDER + 1), reversed(levels)):
            rows = level.join(by_code(self.grams, n, 0.0, "share"), "code", "left").withColumn("share", F.coalesce("share", none))
            if lower is None:
                rows = rows.withColumn("weight", whole).withColumn("p", constant(self.floor))
            else:
                back = by_code(self.contexts, n, 1.0, "weight").withColumnRenamed("code", "context")
                rows = rows.withColumn("context", F.shiftrightunsigned(F.col("code"), 16)).join(back, "context", "left").withColumn("weight", F.coalesce("weight", whole))
                rows = rows.withColumn("tail", F.col("code").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1))).join(lower.select(F.col("code").alias("tail"), "p"), "tail")
            weighed = F.zip_with("weight", "p", lambda w, p: w * p)
            lower = rows.select("code", F.zip_with("share", weighed, lambda a, b: a + b).alias("p"))
        return lower


def counted(learn: DataFrame) -> DataFrame:
    """``(lang, code, n)``: summed per task over its slices; learn has ``(text, lang)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            lang_number, langs = pd.factorize(batch.column(1).to_pandas())
            for lo, hi, data, offsets in slices(batch):
                own = lang_number[lo:hi].astype(np.uint64)
                row, number, low, starts, ends, at_row = distinct_words(data, offsets, mix(own + np.uint64(1)))
                if not len(row):
                    continue
                code, word = grams(low, starts, ends)
                frame = pd.DataFrame({"lang": lang_number[lo:hi][at_row][word], "code": code.view(np.int64), "n": np.bincount(number, minlength=len(starts)).astype(np.int64)[word]})
                frame = frame.groupby(["lang", "code"], sort=False, as_index=False)["n"].sum()
                parts.append(frame.assign(lang=np.asarray(langs, object)[frame["lang"]]))
                held += len(frame)
                if held > 2_000_000:
                    parts = [pd.concat(parts).groupby(["lang", "code"], sort=False, as_index=False)["n"].sum()]
                    held = len(parts[0])
                    if held > 1_500_000:  # so many kinds that they are handed on
                        yield pa.RecordBatch.from_pandas(parts.pop(), preserve_index=False)
                        held = 0
        if parts:
            yield pa.RecordBatch.from_pandas(pd.concat(parts).groupby(["lang", "code"], sort=False, as_index=False)["n"].sum(), preserve_index=False)

    return map_batches(learn, run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(learn: DataFrame) -> Models:
    """The tables of ``(text, lang)`` rows as sorted arrays, of any size."""
    return tables(learn).collected()


def tables(learn: DataFrame) -> Tables:
    """Kneser-Ney tables of ``(text, lang)`` rows, from all of them."""
    types = cut_lineage(counted(learn))
    every, back, floors = [], [], {}
    level = types
    for n in range(ORDER, 0, -1):
        if n < ORDER:  # continuation counts: in how many contexts one character longer a gram occurs
            level = level.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << (16 * n)) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        context = F.shiftrightunsigned(F.col("code"), 16) if n > 1 else F.lit(0).cast("long")
        rows = level.withColumn("context", context)
        ones = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
        discount = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("one") / F.greatest(F.lit(1), F.col("one") + 2 * F.col("two"))))
        ones = ones.select("lang", discount.alias("d"), "kinds", "all")
        sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("followers"))
        sums = sums.join(ones, "lang").select("lang", "context", "total", "d", (F.col("d") * F.col("followers") / F.col("total")).alias("weight"))
        every.append(rows.join(sums, ["lang", "context"]).select(F.lit(n).alias("order"), "lang", "code", ((F.col("n") - F.col("d")) / F.col("total")).alias("value")))
        if n > 1:
            back.append(sums.select(F.lit(n).alias("order"), "lang", F.col("context").alias("code"), F.col("weight").alias("value")))
        else:
            floors = {r["lang"]: r for r in ones.collect()}
    languages = sorted(floors)
    vocabulary = max([r["kinds"] for r in floors.values()], default=0) + 1
    floor = np.array([floors[k]["d"] * floors[k]["kinds"] / floors[k]["all"] / vocabulary for k in languages])
    return Tables(languages, numbered(every, languages), numbered(back, languages), floor)


def numbered(parts: list[DataFrame], languages: list[str]) -> DataFrame:
    """``(order, lang, code, value)`` of all orders, languages by number, values in single precision."""
    whole = parts[0]
    for t in parts[1:]:
        whole = whole.unionByName(t)
    names = F.array(*[F.lit(k) for k in languages]).cast("array<string>")
    return cut_lineage(whole.select("order", (F.array_position(names, F.col("lang")) - 1).cast("int").alias("lang"), "code", F.col("value").cast("float").alias("value")))


def arrays_of(table: DataFrame, languages: list[str], missing: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and values by language for each order."""
    whole = table.toArrow()
    order, lang, code, value = (whole.column(k).to_numpy() for k in ("order", "lang", "code", "value"))
    out = []
    for n in range(1, ORDER + 1):
        own = order == n
        keys, number = np.unique(code[own].astype(np.int64), return_inverse=True)
        values = np.full((len(keys), len(languages)), missing, np.float32)
        values[number, lang[own]] = value[own]
        out.append((keys, values))
    return out


def over_texts(rows: DataFrame, models: Models | Tables, schema: str, work: Callable[..., dict[str, object]]) -> DataFrame:
    """The columns of ``work(models, batch, lo, hi, bytes, offsets)`` for every slice of the texts."""
    if isinstance(models, Models):
        shared = rows.sparkSession.sparkContext.broadcast(models)
        return map_slices(rows, schema, lambda *x: work(shared.value, *x))
    return over_blocks(rows, models, schema, work)


def over_blocks(rows: DataFrame, models: Tables, schema: str, work: Callable[..., dict[str, object]]) -> DataFrame:
    """The same with joined tables: a block of texts meets the probabilities of its own grams."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    languages, floor, limits = models.languages, models.floor, models.limits

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, limit=BLOCK_BYTES):
                row, _, low, starts, ends, _ = distinct_words(data, offsets)
                codes = np.unique(grams(low, starts, ends)[0]) if len(row) else np.zeros(0, np.uint64)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as stream:
                    stream.write_batch(batch.slice(lo, hi - lo))
                packed = zlib.compress(sink.getvalue().to_pybytes(), 1)
                name = int.from_bytes(os.urandom(8), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([packed], pa.binary()), pa.array([codes.view(np.int64)], pa.list_(pa.int64()))], names=["block", "packed", "codes"])

    blocks = written(map_batches(rows, cut, "block long, packed binary, codes array<long>"))
    pairs = blocks.select("block", F.explode("codes").alias("code"))
    scored = pairs.join(models.scored(pairs.select("code").distinct()), "code")
    texts = blocks.select("block", F.lit(0).alias("role"), F.lit(0).cast("long").alias("code"), "packed", F.lit(None).cast("array<double>").alias("p"))
    both = texts.unionByName(scored.select("block", F.lit(1).alias("role"), "code", F.lit(None).cast("binary").alias("packed"), "p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, packed, codes, values = None, None, [], []

        def finished() -> Iterator[pa.RecordBatch]:
            if packed is None:
                return
            table = (np.concatenate(codes), np.concatenate(values)) if codes else (np.zeros(0, np.int64), np.zeros((0, len(languages))))
            scores = Scores(languages, [table], [], floor, limits)
            for batch in pa.ipc.open_stream(zlib.decompress(packed)):
                for lo, hi, data, offsets in slices(batch):
                    out = work(scores, batch, lo, hi, data, offsets)
                    yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) and out[f.name].type == f.type else pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

        for b in batches:
            names, roles = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if names[lo] != block or roles[lo] == 0:
                    yield from finished()
                    block, packed, codes, values = names[lo], b.column(3)[lo].as_py(), [], []
                    lo += 1
                if lo < hi:
                    codes.append(b.column(2).slice(lo, hi - lo).to_numpy())
                    values.append(b.column(4).slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1))
        yield from finished()

    dealt = both.repartition("block").sortWithinPartitions("block", "role", "code")
    return map_batches(dealt.select("block", "role", "code", "packed", "p"), run, schema)


def calibrate(models: Models | Tables, learn: DataFrame) -> None:
    """Set the limits from the cross-entropies of learning documents under their own language."""

    def work(m, batch, lo, hi, data, offsets):
        bits, chars = m.entropies(data, offsets)
        lang = rows_of(batch, "lang", lo, hi)
        at = np.searchsorted(m.languages, lang.to_numpy(zero_copy_only=False).astype(str))
        return {"lang": lang, "h": np.where(chars > 0, bits[np.arange(hi - lo), at] / np.maximum(chars, 1), np.nan)}

    rows = over_texts(learn.select("text", "lang"), models, "lang string, h double", work).filter("not isnan(h)")
    found = {r["lang"]: r["m"] + 4 * (r["s"] or 0) for r in rows.groupBy("lang").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s")).collect()}
    models.limits = np.array([found.get(k, np.inf) for k in models.languages])


def fit(docs: DataFrame, folds: int = 4, held: int = 2) -> Models | Tables:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learn = rows.filter("doc_id is not null and lang is not null and text is not null").filter(bucket(F.col("doc_id"), folds) != held)
    models = tables(learn.select("text", "lang"))
    if models.size() <= BROADCAST_BYTES:
        models = models.collected()
    calibrate(models, learn)
    return models


def identified(docs: DataFrame, models: Models | Tables, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, cross_entropy, accepted)`` of every document."""
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(m, batch, lo, hi, data, offsets):
        out = {"doc_id": rows_of(batch, "doc_id", lo, hi)}
        if not m.languages:
            return out | {"lang_pred": [UNKNOWN] * (hi - lo), "score": np.zeros(hi - lo), "cross_entropy": np.zeros(hi - lo), "accepted": np.zeros(hi - lo, bool)}
        bits, chars = m.entropies(data, offsets)
        h = bits / np.maximum(chars, 1)[:, None]
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        score = np.where(chars > 0, 1 / np.exp2(-(h - least[:, None]) * np.minimum(chars, CERTAIN)[:, None]).sum(1), 0.0)
        limits = m.limits if m.limits is not None else np.full(len(m.languages), np.inf)
        names = np.where(chars > 0, np.array(m.languages, object)[best], UNKNOWN)
        return out | {"lang_pred": names, "score": score, "cross_entropy": least, "accepted": (chars > 0) & (least <= limits[best]) & (score > 0.5)}

    return over_texts(narrow, models, "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean", work)


def op4(docs: DataFrame) -> DataFrame:
    out = identified(docs, fit(docs))
    return out.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
