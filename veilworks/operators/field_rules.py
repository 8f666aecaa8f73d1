"""Field kinds by a table of rules: ``(rule_no, op, needle, kind, without, unless)``, the first rule that fits wins.

``op`` is equals, contains, prefix or suffix. A name is framed by two marks, so each op is "the framed name contains the framed
needle", and all rules together are one search of many terms (``term_search``): no rule meets every name. Distinct names
are decided once and joined back, sent to the tasks only if they are measured to be small.

Defined cases: a null name has no kind and keeps its row; an empty needle of ``contains`` fits every name; a rule with a null kind
says "none" and ends the search; of rules with one number and different kinds the least kind wins, none first; a name that
no rule fits has no kind; an empty table of rules gives none to all; names of any length are walked once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.field_kinds import DEFAULT_RULES, FieldRule, normalize
from ..session import cut_lineage
from ..sources.tables import broadcast_if_small
from .term_search import numbered_terms, pairs

RULES = "rule_no int, op string, needle string, kind string, without string, unless string"
BEGIN, END = "\x02", "\x03"


def rule_rows(rules: list[FieldRule] | None = None) -> list[tuple]:
    """The rules of ``field_kinds`` as rows."""
    out = []
    for no, r in enumerate(rules or DEFAULT_RULES):
        needles = [("equals", n) for n in r.names] + [("contains", w) for w in r.words]
        for part in filter(None, r.pattern.split("|")):
            op = {(True, True): "equals", (True, False): "prefix", (False, True): "suffix", (False, False): "contains"}[part.startswith("^"), part.endswith("$")]
            needles.append((op, part.removeprefix("^").removesuffix("$")))
        out += [(no, op, n, r.kind, None, r.unless or None) for op, n in needles]
        if r.word_without:
            out.append((no, "contains", r.word_without[0], r.kind, r.word_without[1], r.unless or None))
    return out


def rules_table(spark: SparkSession, rules: list[FieldRule] | None = None) -> DataFrame:
    return spark.createDataFrame(rule_rows(rules), RULES)


def kinds_of_names(names: DataFrame, rules: DataFrame, name: str = "field", way: str | None = None) -> DataFrame:
    """``(name, kind)`` of each distinct name that a rule fits."""
    distinct = names.select(F.col(name).alias("key")).where("key is not null").distinct()
    low = cut_lineage(distinct.select("key", normalize(F.col("key")).alias("low")))
    framed = {"equals": (BEGIN, END), "prefix": (BEGIN, ""), "suffix": ("", END), "contains": ("", "")}
    needle = F.lit(None).cast("string")
    for op, (before, after) in framed.items():
        needle = F.when(F.col("op") == op, F.concat(F.lit(before), normalize(F.col("needle")), F.lit(after))).otherwise(needle)
    table = cut_lineage(rules.select("rule_no", "kind", needle.alias("term"), normalize(F.col("without")).alias("without"), normalize(F.col("unless")).alias("unless")))
    framed_names = low.select("key", F.concat(F.lit(BEGIN), F.col("low"), F.lit(END)).alias("text"))
    hits = pairs(framed_names, cut_lineage(numbered_terms(table, "term")), way)
    fits = hits.join(broadcast_if_small(table), "term").join(low, "key")
    fits = fits.where("(without is null or not contains(low, without)) and (unless is null or low != unless)")
    return fits.groupBy(F.col("key").alias(name)).agg(F.min(F.struct("rule_no", "kind")).alias("r")).select(name, F.col("r.kind").alias("kind"))


def classify(fields: DataFrame, rules: DataFrame, name: str = "field", way: str | None = None) -> DataFrame:
    """The rows with the ``kind`` of their field name; the same as ``field_kinds.kind_of`` for the same rules."""
    decided = cut_lineage(kinds_of_names(fields, rules, name, way)).withColumnRenamed(name, "__name")
    return fields.join(broadcast_if_small(decided), fields[name] == F.col("__name"), "left").drop("__name")
