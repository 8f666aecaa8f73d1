"""Catalog jobs: validate, edit, tokenize, compile, analyze, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_of
from ..functions.templates import analysis, restored, segments, tokenize
from ..session import stored_step
from ..sources.tables import spread
from .deid import dictionary_terms
from .ordering import dense_index

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# ----------------------------------------------------------------------------------------------------
# validation


def _violations(df: DataFrame, rules: dict[str, Column], *keep: str) -> DataFrame:
    hit = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return df.select(*keep, F.explode(hit).alias("rule"))


def _duplicates(df: DataFrame, *extra: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per id that occurs more than once; counts are combined before the shuffle."""
    return (
        df.where(F.col("id").isNotNull())
        .groupBy(*by, "id")
        .agg(F.count(F.lit(1)).alias("n"), *extra)
        .where("n > 1")
        .withColumn("rule", F.lit("duplicate_id"))
    )


def _bad_id(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("0")).rlike("^[0-9]+$")  # a missing id is missing text


def _entry_rules() -> dict[str, Column]:
    pairs = F.map_entries("test_case")
    return {
        "missing_text": F.col("id").isNull() | F.col("name").isNull() | F.col("sample").isNull(),
        "missing_test_case": F.col("test_case").isNull(),
        "id_not_digits": _bad_id(F.col("id")),
        "empty_name": F.col("name") == "",
        "empty_sample": F.col("sample") == "",
        "token_name": F.exists(pairs, lambda e: ~e["key"].rlike("^[A-Z_]+$")),
        "value_count": F.exists(
            pairs,
            lambda e: count_of(F.col("sample"), F.concat(F.lit("{{"), e["key"], F.lit("}}"))) != F.size(e["value"]),
        ),
    }


def catalog_violations(templates: DataFrame) -> DataFrame:
    """``(id, rule)`` for a table of templates. Empty when the catalog is valid."""
    return _violations(templates, _entry_rules(), "id").unionByName(_duplicates(templates).select("id", "rule"))


def save_violations(templates: DataFrame) -> DataFrame:
    """What must hold before a catalog is written."""
    rules = {n: t for n, t in _entry_rules().items() if n in ("missing_text", "missing_test_case", "id_not_digits", "empty_name", "empty_sample")}
    return _violations(templates, rules, "id").unionByName(_duplicates(templates).select("id", "rule"))


def catalog_file_violations(raw: DataFrame, *by: str) -> DataFrame:
    """``(*by, pos, id, rule)`` for entries as read from files (see ``read_raw_catalog``); ``"file"`` checks many at once."""
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    is_object = F.coalesce(F.col("is_object"), F.lit(False))
    has_map = F.col("test_case_type").startswith("OBJECT")
    values = F.map_entries("test_case_raw")
    as_array = lambda e: F.schema_of_variant(F.try_parse_json(e["value"]))
    rules = {
        "schema_version": first & ~F.coalesce(F.col("schema_version") == 1, F.lit(False)),
        "logs_missing": first & ~F.col("has_logs"),
        "entry_not_object": F.col("pos").isNotNull() & ~is_object,
        "missing_text": is_object & (F.col("id").isNull() | F.col("name").isNull() | F.col("sample").isNull()),
        "source_not_text": is_object & ~F.col("source_type").isin("MISSING", "STRING"),
        "test_case_not_object": is_object & ~has_map & (F.col("test_case_type") != "MISSING"),
        "test_case_not_array": has_map & F.exists(values, lambda e: (e["key"] == "") | ~F.coalesce(
            as_array(e).startswith("ARRAY"), F.lit(False))),
        "test_case_not_text": has_map & F.exists(values, lambda e: F.coalesce(
            as_array(e).startswith("ARRAY") & ~as_array(e).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
            | F.coalesce((as_array(e) == "ARRAY<VOID>") & (F.regexp_replace(e["value"], r"\s", "") != "[]"), F.lit(False))),
        "id_not_digits": _bad_id(F.col("id")),
        "empty_name": F.col("name") == "",
        "empty_sample": F.col("sample") == "",
    }
    doubles = _duplicates(raw, F.max("pos").alias("pos"), by=by).select(*by, "pos", "id", "rule")
    return _violations(raw, rules, *by, "pos", "id").unionByName(doubles)


# ----------------------------------------------------------------------------------------------------
# edits


def padded_id(number: Column) -> Column:
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0"))


def next_id(templates: DataFrame) -> DataFrame:
    """One row ``(next_id)``: largest id + 1. Fails when an id does not fit."""
    number = F.col("id").try_cast("long")
    checked = F.when(number.isNull(), F.raise_error(F.concat(F.lit("id out of range: "), "id"))).otherwise(number)
    return templates.agg(F.coalesce(F.max(checked), F.lit(0)).alias("m")).select(
        padded_id(F.col("m") + 1).alias("next_id")
    )


def delete(templates: DataFrame, ids: DataFrame) -> DataFrame:
    return templates.join(ids.select("id").distinct(), "id", "left_anti")


def edit_problems(templates: DataFrame, edits: DataFrame) -> DataFrame:
    """``(id, rule, edits)``: edits of ids that the catalog does not hold, and ids that are edited more than once."""
    counts = edits.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("edits"))
    known = templates.select("id", F.lit(True).alias("known")).distinct()
    rows = counts.join(known, "id", "left")
    unknown = rows.where(F.col("known").isNull()).select("id", F.lit("unknown_id").alias("rule"), "edits")
    return unknown.unionByName(rows.where("edits > 1").select("id", F.lit("edited_twice").alias("rule"), "edits"))


def upsert(templates: DataFrame, edits: DataFrame, strict: bool = True) -> DataFrame:
    """Rows with an id replace the row of that id in place; rows without one are appended with new ids.

    Ids of deleted rows below the maximum are never used again. ``strict`` raises on an unknown id or a second edit
    of one; otherwise the edit of largest ``pos`` counts, and ``edit_problems`` tells what was left out.
    """
    if strict and (bad := edit_problems(templates, edits).first()):
        raise ValueError(f"edit of {bad['id']}: {bad['rule']}")
    columns = ["pos", "id", "name", "sample", "source", "test_case"]
    last = edits.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("name", "sample", "source", "test_case"), "pos").alias("e"))
    known = last.select("id", "e.*")
    replaced = templates.select("pos", "id").join(known, "id")
    kept = templates.join(known.select("id"), "id", "left_anti")
    fresh = dense_index(edits.where(F.col("id").isNull()), "pos", name="n")
    top = templates.agg(
        F.coalesce(F.max(F.col("id").cast("long")), F.lit(0)).alias("max_id"),
        F.coalesce(F.max("pos"), F.lit(-1)).alias("max_pos"),
    ).withColumn("one", F.lit(1))
    added = (
        fresh.drop("id", "pos")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(top), "one")  # exactly one row
        .withColumn("id", padded_id(F.col("max_id") + F.col("n") + 1))
        .withColumn("pos", (F.col("max_pos") + F.col("n") + 1).cast("int"))
    )
    return kept.select(columns).unionByName(replaced.select(columns)).unionByName(added.select(columns))


# ----------------------------------------------------------------------------------------------------
# tokenize, restore, compile, analyze


def tokenize_table(templates: DataFrame, **options) -> DataFrame:
    """Tokenize the sample and every mapped value."""
    return templates.withColumn("sample", tokenize(F.col("sample"), **options)).withColumn(
        "test_case",
        F.transform_values("test_case", lambda k, values: F.transform(values, lambda v: tokenize(v, **options))),
    )


def restore_mapped_values(templates: DataFrame, out: str = "restored", **options) -> DataFrame:
    """NULL where a token name or a value count is wrong; ``catalog_violations`` says which."""
    return templates.withColumn(out, restored(F.col("sample"), F.col("test_case"), **options))


def fingerprint(sample: Column, test_case: Column) -> Column:
    """Never NULL: a missing sample has keys of its own, a missing test case counts as an empty one."""
    entries = F.to_json(F.array_sort(F.map_entries(_mapped(test_case))))
    missing = F.concat(F.lit("missing:"), F.sha2(entries, 256))
    return F.coalesce(F.sha2(F.concat(sample, F.lit("\x1f"), entries), 256), missing)


def _mapped(test_case: Column) -> Column:
    return F.coalesce(test_case, F.create_map().cast("map<string,array<string>>"))


def compile_templates(templates: DataFrame, **options) -> DataFrame:
    """Adds ``segments`` and the analysis columns; the sample and the mapped values come back tokenized."""
    rows = tokenize_table(templates.withColumn("test_case", _mapped(F.col("test_case"))), **options)
    return _analyzed(rows)


def _analyzed(tokenized: DataFrame) -> DataFrame:
    rows = tokenized.withColumn("segments", segments(restored(F.col("sample"), F.col("test_case"), tokenized=True)))
    return rows.select("*", *[c.alias(n) for n, c in analysis(F.col("segments")).items()])


def compile_distinct(templates: DataFrame, **options) -> DataFrame:
    """``compile_templates`` run once per distinct (sample, test case); no template is lost, NULLs included.

    The raw fingerprint finds equal originals, the tokenized one finds originals that become equal. Copies
    collapse by partial aggregation before the shuffle; the join back may be split by adaptive execution.
    Tokenized texts and compiled templates are each computed once and cut off the plan.
    """
    keyed = templates.withColumn("fp", fingerprint(F.col("sample"), F.col("test_case")))
    once = keyed.groupBy("fp").agg(F.any_value("sample").alias("sample"), F.any_value(_mapped(F.col("test_case"))).alias("test_case"))
    tokenized = stored_step(tokenize_table(spread(once, "fp"), **options))
    tokenized = tokenized.withColumn("compiled_fp", fingerprint(F.col("sample"), F.col("test_case")))
    distinct = tokenized.groupBy("compiled_fp").agg(F.any_value("sample").alias("sample"), F.any_value("test_case").alias("test_case"))
    built = stored_step(_analyzed(spread(distinct, "compiled_fp")))
    links = keyed.drop("sample", "test_case").join(tokenized.select("fp", "compiled_fp"), "fp")
    return links.drop("fp").join(built, "compiled_fp")


def copies(df: DataFrame, key: str, sample: Column, test_case: Column) -> DataFrame:
    """``(fp, leader, copies)``: one row per distinct template with its first key."""
    return df.select(key, fingerprint(sample, test_case).alias("fp")).groupBy("fp").agg(
        F.min(key).alias("leader"), F.count(F.lit(1)).alias("copies")
    )


def coverage(compiled: DataFrame) -> DataFrame:
    """How many templates have at least one of each category."""
    return compiled.agg(
        F.count(F.lit(1)).alias("n_templates"),
        F.count_if(F.col("n_timestamps") > 0).alias("with_timestamp"),
        F.count_if(F.col("n_src") > 0).alias("with_source_ip"),
        F.count_if(F.col("n_dst") > 0).alias("with_destination_ip"),
        F.count_if(F.col("n_privacy") > 0).alias("with_privacy"),
        F.count_if(F.col("kind_mask").bitwiseAND(F.lit(1)) != 0).alias("with_person"),
        F.bit_or("kind_mask").alias("all_kinds"),
    )


def coverage_shortfalls(coverage_row: DataFrame, required: dict[str, int]) -> DataFrame:
    """``(category, found, required)`` for every threshold that is missed."""
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("category"), F.col(n).cast("long").alias("found"), F.lit(v).cast("long").alias("required"))
            for n, v in required.items()
        ]
    )
    return coverage_row.select(F.inline(pairs)).where("found < required")


# ----------------------------------------------------------------------------------------------------
# listing and search


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def preview(text: Column, limit: int = 180) -> Column:
    """The first ``limit`` bytes (a character cut in two is dropped), with ``...`` when shortened."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(text.cast("binary"), 1, limit).cast("string")), "�$", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def search_text(*parts: Column) -> Column:
    return lower_ascii(F.concat_ws(" ", *parts))


def with_search_text(templates: DataFrame) -> DataFrame:
    """Adds ``search_text``: name, source, sample, mapped tokens and values, vocabulary of the kinds found."""
    mapped = F.flatten(
        F.transform(
            F.array_sort(F.map_entries("test_case")), lambda e: F.concat(F.array(e["key"]), e["value"])
        )
    )
    terms = dictionary_terms(templates, "kind_mask") if "kind_mask" in templates.columns else F.lit("")
    # an empty last part adds no separator
    text = F.concat_ws(" ", F.concat_ws(" ", "name", "source", "sample", F.array_join(mapped, " ")), F.nullif(terms, F.lit("")))
    return templates.withColumn("search_text", lower_ascii(text)).withColumn("preview", preview(F.col("sample")))


def search(df: DataFrame, query: str, text: str = "search_text") -> DataFrame:
    """Rows whose text contains the query, whatever the case of ASCII letters; an empty query keeps all."""
    wanted = query.translate(str.maketrans(_UPPER, _UPPER.lower()))
    return df if wanted == "" else df.where(F.col(text).contains(wanted))


def list_catalog(templates: DataFrame) -> DataFrame:
    return templates.select("id", "name")


def select_templates(templates: DataFrame, ids: list[str] | DataFrame | None = None) -> DataFrame:
    """All templates, or the requested ones in catalog order. A list with an unknown id is an error."""
    if ids is None:
        return templates
    if isinstance(ids, DataFrame):
        return templates.join(ids.select("id").distinct(), "id", "left_semi")
    wanted = templates.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    missing = unknown_ids(templates, wanted).first()
    if missing:
        raise ValueError(f"not in the catalog: {missing['id']}")
    return templates.where(F.col("id").isin(list(dict.fromkeys(ids))))


def unknown_ids(templates: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("id").distinct().join(templates.select("id"), "id", "left_anti")
