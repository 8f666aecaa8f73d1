"""Registered queries of the pipeline operators over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import best_fit_packing, bpe, decontamination, embedding_whitening, jaccard_join, language_id, quality_classifier, quality_rules, ranked_search, secret_scan, substring_dedup, toxicity, training_order


def vocabulary() -> str:
    """The word-level public vocabulary; the path is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    """The byte-level public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": lambda s, d: substring_dedup.op1(docs(s, d)),
    "op2_toxicity": lambda s, d: toxicity.op2(docs(s, d), read_table(s, d, "labels")),
    "op3_decontamination": lambda s, d: decontamination.op3(docs(s, d), read_table(s, d, "benchmark")),
    "op4_language_id": lambda s, d: language_id.op4(docs(s, d)),
    "op5_quality_rules": lambda s, d: quality_rules.op5(docs(s, d)),
    "op6_training_order": lambda s, d: training_order.op6(docs(s, d), vocabulary()),
    "op7_secret_scan": lambda s, d: secret_scan.op7(docs(s, d)),
    "op8_jaccard_join": lambda s, d: jaccard_join.op8(docs(s, d)),
    "op9_bpe": lambda s, d: bpe.op9(docs(s, d), vocabulary()),
    "op10_quality_classifier": lambda s, d: quality_classifier.op10(docs(s, d), read_table(s, d, "labels")),
    "op11_ranked_search": lambda s, d: ranked_search.op11(docs(s, d), read_table(s, d, "benchmark")),
    "op12_best_fit_packing": lambda s, d: best_fit_packing.op12(docs(s, d), byte_vocabulary()),
    "op13_embedding_whitening": lambda s, d: embedding_whitening.op13(read_table(s, d, "embeddings")),
}
