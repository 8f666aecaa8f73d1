"""De-identification of whole tables: find, classify, mask, pseudonymize, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.columns import NOT_AFTER_WORD, NOT_BEFORE_WORD, any_of, bind, count_of, marker, matches
from ..functions.field_kinds import FieldRule, kind_of, normalize
from ..functions.fields import may_hold_pair, pair_pattern, pairs
from ..functions.sanitize import CODE_FIELD_STORE, CONTROLS, mask_endpoints, sanitize
from ..functions.templates import TOKEN_MARKER, tokenize
from ..functions.timestamps import placed
from .dimensions import profile_attribute


def extract_fields(df: DataFrame, key: str, text: str, nested: bool = False, positions: bool = True) -> DataFrame:
    """``(key, field_no, pos, field, value, quoted)`` for every pair of every text; no shuffle.

    Positions cost two more passes of the pattern: leave them out where they are not needed (no ``pos`` then).
    """
    pattern = pair_pattern(nested)
    holding = df.where(may_hold_pair(F.col(text)))
    if not positions:
        rows = holding.select(key, F.posexplode(pairs(F.col(text), nested)).alias("field_no", "p"))
        return rows.select(key, "field_no", "p.field", "p.value", F.col("p.head").rlike("[:=] *[\"']$").alias("quoted"))
    both = F.arrays_zip(pairs(F.col(text), nested).alias("pair"), placed(F.col(text), pattern).alias("place"))
    rows = holding.select(key, F.posexplode(both).alias("field_no", "p"))
    return rows.select(
        key,
        "field_no",
        F.col("p.place.pos").alias("pos"),
        F.col("p.pair.field").alias("field"),
        F.col("p.pair.value").alias("value"),
        F.col("p.pair.head").rlike("[:=] *[\"']$").alias("quoted"),
    )


def classify_fields(fields: DataFrame, rules: list[FieldRule] | None = None) -> DataFrame:
    """Adds ``kind`` to field occurrences: a projection, so one frequent field name skews nothing."""
    return fields.withColumn("kind", kind_of(normalize(F.col("field")), rules))


def field_dictionary(fields: DataFrame, rules: list[FieldRule] | None = None) -> DataFrame:
    """Distinct field names with kind and occurrences. Counts are combined before the shuffle and the
    rules see each distinct name once."""
    return classify_fields(fields.groupBy("field").agg(F.count(F.lit(1)).alias("occurrences")), rules)


def sanitize_table(df: DataFrame, text: str, out: str | None = None, **options) -> DataFrame:
    return df.withColumn(out or text, sanitize(F.col(text), **options))


def mask_endpoints_table(df: DataFrame, text: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or text, mask_endpoints(F.col(text)))


def tokenize_column(df: DataFrame, text: str, out: str | None = None, **options) -> DataFrame:
    return df.withColumn(out or text, tokenize(F.col(text), **options))


def token_counts(df: DataFrame, by: str, text: str, **options) -> DataFrame:
    """How many tokens of each kind each ``by`` group holds after sanitizing: ``(by, kind, tokens, rows)``."""
    found = df.select(by, bind(sanitize(F.col(text), **options), lambda t: matches(t, TOKEN_MARKER)).alias("m"))
    # counted per row first: a row sends one record per kind, not one per token. The outer form keeps the optimizer from
    # inferring a filter on the array, which would rewrite every text a second time
    per_row = found.select(
        by,
        F.explode_outer(F.transform(F.array_distinct("m"), lambda k: F.struct(
            F.substr(k, F.lit(3), F.length(k) - 4).alias("kind"),
            F.size(F.filter("m", lambda x: x == k)).alias("n"),
        ))).alias("c"),
    )
    return per_row.where("c is not null").groupBy(by, F.col("c.kind").alias("kind")).agg(
        F.sum("c.n").alias("tokens"), F.count(F.lit(1)).alias("rows")
    )


# ----------------------------------------------------------------------------------------------------
# pseudonyms


def profile_of(*keys: Column, seed: int = 0) -> Column:
    """Profile number 0..49 as a pure function of seed and keys: same result on every run and layout."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(V.PROFILE_COUNT)).cast("int")


def replace_tokens(text: Column, profile_idx: Column) -> Column:
    """Every marker of a row from one identity, so that person, account and mail agree."""

    def replaced(t: Column) -> Column:
        out = t
        for kind in V.KINDS:
            out = F.replace(out, F.lit(marker(kind)), profile_attribute(kind, profile_idx))
        return out

    return bind(text, lambda t: F.when(t.contains("{{"), replaced(t)).otherwise(t))


def pseudonymize(
    df: DataFrame, key: str, text: str, out: str | None = None, seed: int = 0, profile: Column | None = None
) -> DataFrame:
    """Markers become synthetic values. The identity is an expression of its number: no join, no shuffle."""
    idx = profile if profile is not None else profile_of(F.col(key), seed=seed)
    return df.withColumn("profile_idx", idx).withColumn(out or text, replace_tokens(F.col(text), F.col("profile_idx")))


def stable_pseudonymize(df: DataFrame, column: str, kind: str, out: str | None = None, seed: int = 0) -> DataFrame:
    """Equal original values get equal synthetic values wherever they occur."""
    return df.withColumn(out or column, profile_attribute(kind, profile_of(F.col(column), seed=seed)))


# ----------------------------------------------------------------------------------------------------
# audit

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4 = r"(?:" + _OCTET + r"\.){3}" + _OCTET
# The character before an address is part of the match, as is a browser version prefix.
RESIDUAL_IPV4 = r"(Chrome/|^|[^0-9])" + IPV4 + r"(?:[^0-9]|$)"
_STALE_YEAR = r"(?:201[89]|202[0-6])"
_MONTH = r"(?:0[1-9]|1[0-2])"
_DAY = r"(?:0[1-9]|[12][0-9]|3[01])"
STALE_DATES = [
    NOT_AFTER_WORD + _STALE_YEAR + "[-/]" + _MONTH + "[-/]" + _DAY + NOT_BEFORE_WORD,
    "(?<![0-9])" + _STALE_YEAR + _MONTH + _DAY + "(?![0-9])",
    "(?<![0-9])" + _STALE_YEAR + _MONTH + "(?=_)",
]


def audit_flags(text: Column, forbidden: list[str] | None = None, json_from_brace: bool = False) -> dict[str, Column]:
    """One boolean per kind of leak."""
    flags = {
        "residual_ipv4": F.when(
            text.rlike(IPV4), F.exists(matches(text, RESIDUAL_IPV4, 1), lambda g: g != "Chrome/")
        ).otherwise(False),
        "control_chars": text.rlike(CONTROLS),
        "line_breaks": text.contains("\n") | text.contains("\r"),
        "leaked_marker": text.contains("{{"),
        "stale_date": text.rlike("|".join(STALE_DATES)),
        "store_in_code_field": text.rlike(CODE_FIELD_STORE),
        "synthetic_path": text.contains("C:/ProgramData/Your-Company/SecurityData/event-"),
    }
    if forbidden:
        flags["forbidden_literal"] = text.rlike("(?i)" + any_of([_quote(w) for w in forbidden]))
    if json_from_brace:
        payload = F.regexp_extract(text, r"(?s)\{.*$", 0)
        flags["invalid_json"] = (payload != "") & F.try_parse_json(payload).isNull()
    return flags


def _quote(word: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in word)


def privacy_audit(
    df: DataFrame, by: str, text: str, forbidden: list[str] | None = None, json_from_brace: bool = False
) -> DataFrame:
    """Leak report: rows with each kind of leak per ``by`` group. One map-side combined aggregation."""
    flags = audit_flags(F.col(text), forbidden, json_from_brace)
    return df.select(by, *[c.alias(n) for n, c in flags.items()]).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(n)).alias(n) for n in flags]
    )


def mapped_path_mismatches(templates: DataFrame, token: str = "FILE_PATH") -> DataFrame:
    """Templates whose mapped value count differs from the markers in the sample, or that map empty values."""
    values = F.coalesce(F.try_element_at("test_case", F.lit(token)), F.array().cast("array<string>"))
    n = count_of(F.col("sample"), F.lit(marker(token)))
    return templates.select("id", n.alias("markers"), F.size(values).alias("values"), values.alias("v")).where(
        (F.col("markers") != F.col("values")) | F.exists("v", lambda x: x == "")
    ).drop("v")


def dictionary_terms(df: DataFrame, mask: str) -> Column:
    """Search vocabulary of all kinds in a bit mask, in kind order."""
    return bind(
        F.col(mask),  # named once: a pushed-down filter repeats what computes it for every mention
        lambda m: F.concat_ws(
            " ", *[F.when(m.bitwiseAND(F.lit(1 << i)) != 0, F.lit(V.SEARCH_TERMS[k])) for i, k in enumerate(V.KINDS)]
        ),
    )


__all__ = [n for n in dir() if not n.startswith("_")]
