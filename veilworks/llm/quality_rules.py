"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule, so a policy
is a mask, a new policy version needs no second look at the texts, and an ablation is a bitwise aggregate.

Defined cases: a null or empty text, or one of white space only, has zero words and fails ``few_words`` alone. Rows are
judged one by one, so repeated rows give repeated results. Only the two named columns are read: other columns, of any
name, are ignored. An empty table gives an empty ledger. Null ids stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import map_slices, rows_of
from .measures import NAMES, measure

# rule -> condition on the measurements that fails a document; integers only, so every engine agrees
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "100 * n_upper > 50 * word_chars",
    "digits": "100 * n_digits > 50 * word_chars",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
# version -> rules that reject; a published version is never changed, a new one is added
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "capitals", "digits"),
}


def policy_mask(version: str) -> int:
    return sum(BITS[r] for r in POLICIES[version])


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, measurements ..., failed)``: ``failed`` has the bit of each rule that the document fails."""
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batch, lo, hi, data, offsets):
        return {"doc_id": rows_of(batch, "doc_id", lo, hi)} | measure(data, offsets)

    counts = map_slices(narrow, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES), work)
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return counts.withColumn("failed", failed.cast("long"))


def fails(version: str) -> Column:
    """Whether the policy rejects a ledger row."""
    return F.col("failed").bitwiseAND(F.lit(policy_mask(version))) != 0


def ablation(book: DataFrame, version: str = "v2") -> DataFrame:
    """One row per rule of a policy: documents that fail it, that fail nothing else, and kept without the rule.

    One bitwise pass: the ledger is reduced to its distinct masks (at most 2 ** rules) before rules are looked at.
    """
    mask = policy_mask(version)
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count(F.lit(1)).alias("docs"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[version]]))
    m, bit = F.col("m"), F.col("r.bit")
    return (
        masks.select("m", "docs", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(m.bitwiseAND(bit) != 0, F.col("docs")).otherwise(0)).alias("failed"),
            F.sum(F.when(m == bit, F.col("docs")).otherwise(0)).alias("failed_only_this"),
            F.sum(F.when(m.bitwiseAND(F.bitwise_not(bit)) == 0, F.col("docs")).otherwise(0)).alias("kept_without"),
        )
    )


def op5(docs: DataFrame, version: str = "v2") -> DataFrame:
    book = ledger(docs)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails("base").alias("base_failed"), (~fails("base") & ~fails(version)).alias("kept"), F.col("failed").alias("failed_bits")
    )
