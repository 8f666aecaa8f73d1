"""From raw documents to token ids: five stages, each a table of its own.

Every stage works on all rows that the one before it kept, returns the columns of ``documents`` (the last one returns
token ids) and is written as Parquet before the next begins, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm import bpe, decontamination, jaccard_join, quality_classifier, secret_scan
from veilworks.llm.queries import vocabulary
from veilworks.llm.tables import written
from veilworks.sources.tables import read_table

NEAR_GROUP = 5  # words; the near-duplicate rule of the pipeline, op8 has its own
NEAR_SIMILAR = 80  # percent


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is trained here, without the held-out fold of the labels."""
    labels = quality_classifier.train_labels(read_table(spark, sf_dir, "labels"), "quality", 5, 0)
    model = quality_classifier.fit(quality_classifier.document_statistics(docs), labels)
    return quality_classifier.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of similar documents: five-word groups, similarity 0.8 or more."""
    found = jaccard_join.components(docs, group=NEAR_GROUP, similar=NEAR_SIMILAR)
    return docs.join(found.filter("component_id != doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and ``n_chars`` counted anew."""
    return secret_scan.without_secrets(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of the text that they decode to."""
    out = bpe.encoded(docs, vocabulary(), decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", good_quality),
    ("jaccard_join", one_of_each),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("bpe", token_ids),
]

# models and merges have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
