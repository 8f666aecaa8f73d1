import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

CLASHING = ("n", "row", "one", "two", "rank", "anchor", "place", "packed", "part", "copies", "windows", "head", "component", "slot", "n_words", "score", "label", "x", "at", "__base", "failed")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd(spark, docs):
    """Nulls, empty, blank and very long texts, equal and repeated rows, and columns with names that operators use."""
    some = [r.text for r in docs.orderBy("doc_id").limit(12).collect()]
    long = " ".join(f"w{i % 7001}x{i // 7001}" for i in range(40_000)) + " token=abcdefghijklmnop " + some[0]
    texts = {i: t for i, t in enumerate(some)} | {20: None, 21: "", 22: " \n\t ", 23: long, 24: some[0], 25: some[0], 26: "a b c", 27: "A B C", 28: "tok", 29: "\n" * 50, 30: "é" * 300, 31: "#" * 500, 32: "x y " * 60}
    rows = [Row(doc_id=i, text=t, lang=None if i % 5 == 0 else "en", source="s", n_chars=len(t or "")) for i, t in texts.items()]
    rows += [rows[3], rows[3], Row(doc_id=None, text=some[1], lang="en", source=None, n_chars=None), Row(doc_id=None, text=None, lang=None, source=None, n_chars=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("extra"))
    return df.repartition(4).cache()
