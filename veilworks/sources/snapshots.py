"""Versions of a table in one folder: immutable data, one small pointer per version, no reader ever sees half a save.

``data/<name>/`` holds what one writer wrote and is never changed. ``versions/<number>.json`` names the data of a version and is
published whole and only if that number does not exist yet, so of two writers that start from one version the
second fails, and overwrites nothing. A version may name more data that it consists of (``parts``). A reader takes the highest number once and goes on with its data, whatever is
saved meanwhile. A save that dies leaves data that no version names; ``expire`` removes it.

Publishing needs a store that refuses to replace: a hard link on a file system, a rename on HDFS. On a store whose rename
replaces silently two writers must be kept apart otherwise.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

LOCAL = "file"


class SaveConflict(RuntimeError):
    """Another writer has saved since the version that this save starts from."""


@dataclass(frozen=True)
class Version:
    number: int
    data: str  # folder of the data
    about: dict


class Snapshots:
    """The versions under a folder; works through the cluster's file systems, on the driver, on names only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._where = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._where(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        where = self._where(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._list("versions") if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int:
        """The number of the last version, 0 before the first."""
        return max(self.numbers(), default=0)

    def version(self, number: int | None = None) -> Version:
        number = self.current() if number is None else number
        if number not in self.numbers():
            raise FileNotFoundError(f"{self.path} has no version {number or ''}".rstrip())
        stream = self._fs.open(self._where(self._pointer(number)))
        try:
            about = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, f"{self.path}/data/{about['data']}", about)

    def _pointer(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def fresh(self) -> str:
        """A folder for the data of a save, named by nobody yet."""
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def publish(self, data: str, base: int, about: dict | None = None) -> Version:
        """Make ``data`` the version after ``base``; a ``SaveConflict`` if there is one already."""
        number = base + 1
        text = json.dumps({**(about or {}), "version": number, "data": data.rsplit("/", 1)[-1]}, sort_keys=True)
        draft, target = f"{self.path}/versions/.{uuid.uuid4().hex}", self._pointer(number)
        if base != self.current():
            raise SaveConflict(f"{self.path}: version {self.current()} was saved after {base}")
        out = self._fs.create(self._where(draft), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if not self._claim(draft, target):
                raise SaveConflict(f"{self.path}: version {number} was saved by another writer")
        finally:
            self._fs.delete(self._where(draft), False)
        return self.version(number)

    def _claim(self, draft: str, target: str) -> bool:
        """Give the draft the name of the pointer, if it is free: one step, by the file system."""
        if self._fs.getScheme() == LOCAL:
            source, name = (self._where(p).toUri().getPath() for p in (draft, target))
            try:
                os.link(source, name)
            except FileExistsError:
                return False
            return True
        return bool(self._fs.rename(self._where(draft), self._where(target)))

    def expire(self, keep: int = 2, grace_seconds: float = 86_400.0) -> list[str]:
        """Remove all but the last ``keep`` versions and the data no version names; younger data may be a save under way."""
        numbers = self.numbers()
        kept = numbers[-keep:] if keep else []
        named = {name for n in kept for name in (lambda a: [a["data"], *a.get("parts", [])])(self.version(n).about)}
        for n in numbers:
            if n not in kept and n != self.current():
                self._fs.delete(self._where(self._pointer(n)), False)
        gone = []
        for name in self._list("data"):
            where = self._where(f"{self.path}/data/{name}")
            old = time.time() - self._fs.getFileStatus(where).getModificationTime() / 1000.0 >= grace_seconds
            if name not in named and old:
                self._fs.delete(where, True)
                gone.append(name)
        return sorted(gone)
