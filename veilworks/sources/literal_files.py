"""One physical file per event, under listed names, as a Spark data source.

Tasks stage files in a folder of their own attempt; nothing has a final name while the job runs. The commit publishes the
staged files of the successful attempts in the order of ``event_idx``: the next file takes the next index whose name is free,
exclusively, so a name that somebody else took meanwhile is passed over and never overwritten. A failed job, or a failed
commit, leaves no name behind, and a repeated task leaves no double: only committed attempts are published. The manifest
of a run is written last, from what was published.

One file per event is for runs of at most ``max_files`` events, as a directory of names is: names pass the driver one by
one. ``event_files.write_event_files`` has no such limit. The folder must be one that driver and executors mount.

Defined cases: a null body is an empty event, whose file holds the line feed of its frame; events of one index are published
in the order of their contents; no event gives an empty manifest; a very long body is one row of one task; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.framing import newline_framed

FORMAT = "veilworks_event_files"
SCHEMA = "event_idx long, content string"
MANIFEST = "event_idx long, file_name string, bytes long"
MAX_FILES = 1_000_000


def local_path(path: str) -> str:
    """The folder on a mounted file system."""
    if "://" in path.removeprefix("file://"):
        raise ValueError(f"{path}: one file per event needs a mounted folder")
    return "/" + path.removeprefix("file:").lstrip("/")


def name_of(stamp: str, index: int) -> str:
    return f"{stamp}.log" if index == 0 else f"{stamp}_{index + 1:04d}.log"


@dataclass
class Staged(WriterCommitMessage):
    """What one attempt of a task has staged."""

    folder: str
    files: int


class EventFileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, stamp: str, max_files: int):
        self.folder, self.stamp, self.max_files, self.run = folder, stamp, max_files, uuid.uuid4().hex
        self.staging = f"{folder}/_staging/{self.run}"

    def write(self, iterator: Iterator) -> Staged:
        own, files = f"{self.staging}/{uuid.uuid4().hex}", 0
        os.makedirs(own)
        for batch in iterator:
            for idx, content in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("event_idx", "content"))):
                # the name sorts by event, then by arrival
                with open(f"{own}/{idx:020d}-{files:012d}", "xb") as f:
                    f.write((content or "").encode())
                files += 1
        return Staged(own, files)

    def commit(self, messages: list[Staged | None]) -> None:
        done = [m for m in messages if m is not None]
        files = sum(m.files for m in done)
        if files > self.max_files:
            raise ValueError(f"{files} events: one file each is limited to {self.max_files}")
        published: list[str] = []
        try:
            self.publish(done, published)
        except BaseException:
            for name in published:
                os.unlink(f"{self.folder}/{name}")
            raise
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def publish(self, done: list[Staged], published: list[str]) -> None:
        index = 0
        os.makedirs(f"{self.folder}/_manifests", exist_ok=True)
        draft = f"{self.folder}/_manifests/.{self.run}"
        ordered = heapq.merge(*([(n, m.folder) for n in sorted(os.listdir(m.folder))] for m in done))
        with open(draft, "x") as manifest:
            for staged, folder in ordered:
                while True:
                    name, index = name_of(self.stamp, index), index + 1
                    try:
                        os.link(f"{folder}/{staged}", f"{self.folder}/{name}")
                        break
                    except FileExistsError:
                        continue
                published.append(name)
                size = os.stat(f"{self.folder}/{name}").st_size
                manifest.write(json.dumps({"event_idx": int(staged.split("-")[0]), "file_name": name, "bytes": size}) + "\n")
        os.rename(draft, f"{self.folder}/_manifests/{self.run}.json")

    def abort(self, messages: list[Staged | None]) -> None:
        for _ in range(10):  # tasks of the job may still be ending
            shutil.rmtree(self.staging, ignore_errors=True)
            time.sleep(0.1)


class EventFileSource(DataSource):
    """``df.write.format(FORMAT).option("path", ...).option("stamp", ...)``; rows are ``event_idx, content``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> EventFileWriter:
        if overwrite:
            raise ValueError("event files are never overwritten: use the mode append")
        return EventFileWriter(local_path(self.options["path"]), self.options["stamp"], int(self.options.get("max_files", MAX_FILES)))


def write_literal_files(events: DataFrame, folder: str, stamp: str, body: str = "body", idx: str = "event_idx", max_files: int = MAX_FILES) -> DataFrame:
    """Write each event as a file of newline-framed content and return the manifest of all runs in the folder."""
    spark = events.sparkSession
    spark.dataSource.register(EventFileSource)
    rows = events.select(F.col(idx).cast("long").alias("event_idx"), newline_framed(F.coalesce(body, F.lit(""))).alias("content"))
    rows.write.format(FORMAT).mode("append").option("path", folder).option("stamp", stamp).option("max_files", max_files).save()
    return literal_manifest(spark, folder)


def literal_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(event_idx, file_name, bytes)`` of what was published in a folder; contents are not read."""
    if not os.path.isdir(f"{local_path(folder)}/_manifests"):
        return spark.createDataFrame([], MANIFEST)
    # names that begin with an underscore are hidden from Spark unless a path names them
    return spark.read.schema(MANIFEST).json(f"file://{local_path(folder)}/_manifests/")


def read_literal_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(file_name, content)`` of the files themselves."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(f"file://{local_path(folder)}")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("content").cast("string").alias("content"))
