"""Reading corpora: any table with a key and a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_corpus(
    spark: SparkSession, path: str, key: str, text: str, fmt: str = "parquet", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(row_id, text, *keep)`` from parquet, JSON lines or text; only these columns are read."""
    df = use_utc(spark).read.format(fmt).load(path)
    return df.select(F.col(key).alias("row_id"), F.col(text).alias("text"), *keep)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for file scans that is the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on a small input.

    A few megabytes arrive as one row group and so as one busy task. Regex work is worth a shuffle then. An input
    of more splits than half the cores, by its bytes or its files, is returned unchanged: it is never shuffled here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark.sparkContext._jvm.org.apache.spark.sql.internal.SQLConf.get().filesMaxPartitionBytes())
    if 2 * (plan_bytes(df) // split) > cores or 2 * len(df.inputFiles()) > cores:
        return df
    return df.repartition(cores, key)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows that costly work waits for, over all cores: adaptive execution and file splits go by bytes, not by work."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, key)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint only after counting the rows and bytes; otherwise leave the join to Spark."""
    width = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), width).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df
