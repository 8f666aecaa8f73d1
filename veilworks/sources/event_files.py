"""Event files: one logical file per event, stored once as partitioned rows; the manifest is read from them."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.framing import newline_framed
from ..operators.ordering import prefix_sums
from ..session import cut_lineage

MAX_STEPS = 1 << 20  # runs of taken indexes that are sent to the tasks; beyond that indexes are joined


def file_stamp(moment: datetime) -> str:
    return moment.strftime("%Y%m%d_%H%M%S_") + f"{moment.microsecond // 1000:03d}"


def file_name(stamp: str, index: Column) -> Column:
    """``stamp.log`` for index 0, then ``stamp_0002.log``, ``stamp_0003.log``, ..."""
    number = (index + 1).cast("string")
    padded = F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))
    suffix = F.when(index > 0, F.concat(F.lit("_"), padded)).otherwise("")
    return F.concat(F.lit(stamp), suffix, F.lit(".log"))


def free_indexes(events: DataFrame, taken: DataFrame, idx: str = "event_idx") -> DataFrame:
    """Adds ``file_index``: the event_idx-th index that is not in ``taken(file_index)``.

    The j-th taken index t (from 0) pushes every event from t - j on by one, so the push of an event is a
    running count over events and taken indexes in one order.
    """
    used = taken.select(F.col("file_index").cast("long")).distinct()
    used = prefix_sums(used, "file_index", {"j": F.lit(1)})
    pushes = cut_lineage(used.groupBy((F.col("file_index") - F.col("j_before")).alias("at")).agg(F.count(F.lit(1)).alias("push")))
    if pushes.count() <= MAX_STEPS:
        return _looked_up(events, pushes, idx)
    marks = pushes.select((F.col("at") * 2).alias("o"), "push").unionByName(
        events.select((F.col(idx) * 2 + 1).alias("o"), F.lit(0).cast("long").alias("push"))
    )
    pushed = prefix_sums(marks, "o", {"push": F.col("push")}).where("o % 2 = 1")
    return events.join(
        pushed.select(F.shiftright("o", 1).alias(idx), "push_before"), idx
    ).withColumn("file_index", F.col(idx) + F.col("push_before")).drop("push_before")


def _looked_up(events: DataFrame, pushes: DataFrame, idx: str) -> DataFrame:
    """The step function sent to the tasks (two numbers per run of taken indexes): only ``idx`` goes through Python, bodies stay."""
    steps = pushes.orderBy("at").toPandas()
    at, total = steps["at"].to_numpy(), np.append(0, steps["push"].to_numpy().cumsum())

    @F.pandas_udf("long")
    def index(i: pd.Series) -> pd.Series:
        return i + total[np.searchsorted(at, i.to_numpy(), "right")]

    return events.withColumn("file_index", index(F.col(idx).cast("long")))


def event_files(
    events: DataFrame, stamp: str, body: str = "body", taken: DataFrame | None = None, idx: str = "event_idx", keep: list[str] | None = None
) -> DataFrame:
    """``(event_idx, file_name, bytes, content, *keep)``: newline-framed content and the name it goes by."""
    rows = free_indexes(events, taken, idx) if taken is not None else events.withColumn("file_index", F.col(idx))
    content = newline_framed(F.col(body))
    return rows.select(
        idx,
        file_name(stamp, F.col("file_index")).alias("file_name"),
        F.octet_length(content).alias("bytes"),
        content.alias("content"),
        *(keep or []),
    )


def write_event_files(files: DataFrame, path: str, part: Column | None = None, events_per_file: int = 0) -> DataFrame:
    """Write the events once, by ``part`` (a day, a template; one part if none), and return the manifest of what is there.

    A row is one logical file: its name, size and content, so name and content cannot disagree. Existing output is an
    error, never overwritten; ``append_event_files`` goes on in a folder. ``events_per_file=1`` gives one physical file
    per event: for small runs only.
    """
    return _write(files, path, part, events_per_file, "error")


def append_event_files(files: DataFrame, path: str, part: Column | None = None, events_per_file: int = 0) -> DataFrame:
    """The same into a folder that may hold files already; take ``taken_indexes`` first."""
    return _write(files, path, part, events_per_file, "append")


def _write(files: DataFrame, path: str, part: Column | None, events_per_file: int, mode: str) -> DataFrame:
    rows = files.withColumn("part", part if part is not None else F.lit("all"))
    writer = rows.write.mode(mode).partitionBy("part")
    if events_per_file:
        writer = writer.option("maxRecordsPerFile", events_per_file)
    writer.parquet(path)
    return manifest(files.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(part, event_idx, file_name, bytes)`` of a folder; contents are not read."""
    return spark.read.option("basePath", path).parquet(path).select(F.col("part").cast("string").alias("part"), "event_idx", "file_name", "bytes")


def taken_indexes(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    """``(file_index)`` of the names with this stamp in a folder, for ``event_files``; empty if the folder is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "file_index long")
    name = F.regexp_extract("file_name", "^" + stamp + r"(?:_([0-9]+))?\.log$", 1)
    names = manifest(spark, path).where(F.col("file_name").startswith(stamp))
    return names.select(F.when(name == "", F.lit(0)).otherwise(name.cast("long") - 1).cast("long").alias("file_index"))
