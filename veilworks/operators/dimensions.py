"""The small fixed dimensions: token kinds, timestamp styles, synthetic identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V


def token_kinds(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, k, 1 << i, "{{" + k + "}}", V.SEARCH_TERMS[k]) for i, k in enumerate(V.KINDS)]
    return spark.createDataFrame(rows, "ordinal int, kind string, bit int, marker string, terms string")


def styles(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, k, n) for i, (k, n) in enumerate(V.STYLES.items())]
    return spark.createDataFrame(rows, "ordinal int, style string, display_name string")


def profiles(spark: SparkSession) -> DataFrame:
    """50 synthetic identities, one column per token kind; ``profile_idx`` is 0..49."""
    n = (F.col("id") + 1).cast("int")
    return spark.range(V.PROFILE_COUNT).select(
        F.col("id").cast("int").alias("profile_idx"),
        *[
            (F.format_string(f, n) if "%" in f else F.lit(f)).alias(kind)
            for kind, f in V.PROFILE_FORMATS.items()
        ],
    )


def profile_values(spark: SparkSession) -> DataFrame:
    """The same identities as ``(profile_idx, kind, value)``."""
    return profiles(spark).unpivot("profile_idx", V.KINDS, "kind", "value")


def profile_attribute(kind: str, profile_idx) -> "F.Column":
    """One attribute of a profile as an expression of its number; no join needed."""
    f = V.PROFILE_FORMATS[kind]
    return F.format_string(f, (profile_idx + 1).cast("int")) if "%" in f else F.lit(f)
