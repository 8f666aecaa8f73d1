"""A sink that holds every micro-batch exactly once, whatever is stopped and started again.

A stream that restarts from its checkpoint gives the batch it had not finished once more, with the same number and the same
rows. So a batch is written to a folder named by its number, which a repetition replaces, and then entered in a ledger,
which is what readers go by: a batch that a stopped run left half-written has no entry, and one that has an entry is not written again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Ledger:
    """Which batches of a sink are complete: one small file each, through the cluster's file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._where = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._where(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        where = self._where(f"{self.folder}/ledger")
        if not self._fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(where) if s.getPath().getName().isdigit())

    def holds(self, batch: int) -> bool:
        return bool(self._fs.exists(self._where(f"{self.folder}/ledger/{batch:012d}")))

    def enter(self, batch: int, about: dict) -> None:
        """The entry appears whole: written aside, then renamed."""
        draft, name = (self._where(f"{self.folder}/ledger/{n}") for n in (f".{batch:012d}", f"{batch:012d}"))
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(about, sort_keys=True).encode()))
        finally:
            out.close()
        self._fs.rename(draft, name)


def exactly_once(stream: DataFrame, folder: str, trigger: dict | None = None, before_entry: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start (or go on with) a stream into ``folder``: its batches, their ledger and the stream's checkpoint.

    ``before_entry`` is called between a batch's data and its entry, where a process may die.
    """
    folder = folder.rstrip("/")

    def keep(rows: DataFrame, batch: int) -> None:
        ledger = Ledger(rows.sparkSession, folder)
        if ledger.holds(batch):
            return
        rows.write.mode("overwrite").parquet(f"{folder}/data/batch={batch}")
        if before_entry:
            before_entry(batch)
        ledger.enter(batch, {"batch": batch})

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def read_committed(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all entered batches, with the column ``batch``; what is not entered is not there."""
    folder = folder.rstrip("/")
    batches = Ledger(spark, folder).batches()
    if not batches:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    # one entry per micro-batch: names only, pruned to the folders of these batches
    rows = spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(*[f"{folder}/data/batch={b}" for b in batches])
    return rows.withColumn("batch", F.col("batch").cast("long"))
