"""Secret scans: three base patterns, and high entropy in windows of candidate strings; DataFrame functions only.

Candidates are runs of key characters of at least a window's length. A window slides over the candidate in each class
of characters (hexadecimal digits of either case; letters, digits and ``+/_=-``). It keeps the count of each character and the sum of
``c * log2(c)``; a step adds one character and drops one, so the Shannon entropy ``log2(W) - sum / W`` costs the same at
every place. Sums are whole micro-bits, so results are exact. Touching windows over the class's limit make one span.
Candidates that have no digit, or letters of one case and few digits (words, numbers), are suppressed, and so are windows
that touch a match of the allow-list; the rest of such a candidate is scanned. Base matches are never suppressed.

Positions are code points, ends exclusive. Defined cases: a null or empty text has no span; of spans that start together
the kinds go in the order listed; rows are scanned one by one, so repeated rows repeat their result; a very long text is one
row of one task, positions take time linear in its matches in blocks of 256; null ids stay; other columns are not read,
whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fold_blocks

WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_key")  # the order of spans that start together
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# a run that is too short fails as a whole, so the least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
# class -> (alphabet, least entropy in micro-bits)
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 3_000_000),
    "entropy_key": ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3_700_000),
}
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|test_?key|0123456789|abcdefghij|x{6,}|0{8,}"
MICRO = [round(c * math.log2(c) * 1_000_000) if c else 0 for c in range(WINDOW + 1)]
SPAN = "struct<start:int,kind:int,end:int>"


def placed(text: Column, pattern: str) -> Column:
    """Start and end of every match, from the lengths of the pieces between the matches and of the matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    lengths = F.zip_with(pieces, found, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("size")))

    def go_on(done: Column, x: Column) -> Column:
        begin = done["at"] + x["gap"]
        end = begin + x["size"]
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    return fold_blocks(lengths, "struct<start:int,end:int>", go_on)


def spans(places: Column, kind: str) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def none() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds; the patterns run only behind a cheap look for their fixed parts."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(F.zip_with(placed(text, ASSIGN), values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), (F.char_length(v) >= 12).alias("long"))), lambda x: x["long"])
    has_word = text.rlike(r"(?i)password|passwd|secret|token|api_?key")
    return {
        "assign": F.when(has_word, spans(assign, "assign")).otherwise(none()),
        "access": F.when(text.contains("AKIA"), spans(placed(text, ACCESS), "access")).otherwise(none()),
        "hex": F.when(text.rlike(HEX), spans(placed(text, HEX), "hex")).otherwise(none()),
    }


def hot_windows(codes: Column, least: int) -> Column:
    """Start and end (from 0) of the merged windows of at least that entropy; a code of 0 is outside the class."""
    micro = F.array(*[F.lit(m).cast("long") for m in MICRO])
    limit = (math.floor(math.log2(WINDOW) * 1_000_000) - least) * WINDOW  # of the sum of c * log2(c)
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.array_repeat(F.lit(0), 80).alias("counts"), F.lit(0).cast("long").alias("total"), empty.alias("out"))

    def step(s: Column, code: Column) -> Column:
        i, old = s["i"], s["counts"]
        run = F.when(code == 0, 0).otherwise(s["run"] + 1)  # characters of the class up to here
        gone = F.when(s["run"] >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(0))
        came = code
        # a character from outside starts the counts anew
        counts = F.when(came == 0, F.array_repeat(F.lit(0), 80)).otherwise(
            F.transform(old, lambda c, k: c + F.when(k == came, 1).otherwise(0) - F.when((gone > 0) & (k == gone), 1).otherwise(0))
        )
        plus, minus = F.get(old, came), F.get(old, gone)
        change = F.when(gone == came, F.lit(0)).otherwise(
            F.get(micro, plus + 1) - F.get(micro, plus) - F.when(gone > 0, F.get(micro, minus) - F.get(micro, minus - 1)).otherwise(0)
        )
        total = F.when(came == 0, F.lit(0).cast("long")).otherwise(s["total"] + change)
        begin, end = i + 1 - WINDOW, i + 1
        last = F.element_at(s["out"], -1)
        joins = (F.size(s["out"]) > 0) & (last["end"] >= begin)
        grown = F.when(
            joins, F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        ).otherwise(F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))))
        out = F.when((run >= WINDOW) & (total <= limit), grown).otherwise(s["out"])
        return F.struct((i + 1).alias("i"), run.alias("run"), counts.alias("counts"), total.alias("total"), out.alias("out"))

    return F.aggregate(codes, start, step, lambda s: s["out"])


def without_allowed(value: Column) -> Column:
    """The candidate with blanks, which are in no class, in place of what the allow-list matches."""
    found = F.regexp_extract_all(value, F.lit(ALLOWED), F.lit(0))
    blanks = F.zip_with(F.split(value, ALLOWED, -1), found, lambda piece, m: F.concat(piece, F.coalesce(F.repeat(F.lit(" "), F.char_length(m)), F.lit(""))))
    return F.when(value.rlike(ALLOWED), F.array_join(blanks, "")).otherwise(value)


def entropy_spans(text: Column, kind: str) -> Column:
    alphabet, least = CLASSES[kind]
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    candidates = F.zip_with(placed(text, CANDIDATE), found, lambda p, v: F.struct(p["start"].alias("at"), v.alias("value")))

    def suspicious(c: Column) -> Column:
        v = c["value"]
        mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ((v.rlike("[a-z]") & v.rlike("[A-Z]")) | v.rlike("([0-9][^0-9]*){4}"))
        return mixed

    def windows(c: Column) -> Column:
        codes = F.transform(F.split(without_allowed(c["value"]), ""), lambda ch: F.instr(F.lit(alphabet), ch))
        hot = F.flatten(F.transform(F.array(codes), lambda ks: hot_windows(ks, least)))
        return F.transform(hot, lambda w: F.struct((c["at"] + w["start"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (c["at"] + w["end"]).alias("end")))

    return F.when(text.rlike(CANDIDATE), F.flatten(F.transform(F.filter(candidates, suspicious), windows))).otherwise(none())


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the columns ``base`` and ``all_spans`` (arrays of start, kind number, end; sorted) added."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = base_spans(whole)
    out = docs.withColumn("__base", F.array_sort(F.concat(*base.values())))
    method = F.concat(*[entropy_spans(whole, k) for k in CLASSES])
    return out.withColumn("__all", F.array_sort(F.concat(F.col("__base"), method)))


def listed(column: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every covered stretch replaced by the mark; overlapping spans count as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def go_on(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        grown = F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), grown.alias("out"))

    whole = F.aggregate(found, start, go_on, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def without_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span in the text replaced, hexadecimal keys of either case too; other columns, of any name, pass as they are."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.array_sort(F.concat(*base_spans(whole).values(), *[entropy_spans(whole, k) for k in CLASSES]))
    once = F.transform(F.array(found), lambda spans_: redacted(F.col(text), spans_))[0]  # the spans are computed once
    return docs.select(*[once.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op7(docs: DataFrame) -> DataFrame:
    rows = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(F.col("__all")).alias("spans"))
