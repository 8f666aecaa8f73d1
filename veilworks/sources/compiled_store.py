"""Compiled templates kept between runs: a run compiles only what no run with the same code has compiled before.

Compiled forms are filed by the fingerprint of the raw template under the version of the code (a hash of the modules that decide the
result, and of the options). They are parts of a table of snapshots: each run adds the part it compiled, another code version begins
anew. Of two runs at once the second keeps its part to itself; its result is the same.

Defined cases: as ``catalog.compile_distinct``: templates with missing samples or test cases keep their rows, equal ones share a
form; an empty table compiles and saves nothing.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns, field_kinds, fields, fixed, sanitize, templates, timestamps
from ..operators import catalog as C
from .snapshots import SaveConflict, Snapshots
from .tables import spread


def code_version(options: dict | None = None) -> str:
    """Of the code that compiles, and of the options it is given."""
    text = "".join(inspect.getsource(m) for m in (columns, field_kinds, fields, fixed, sanitize, templates, timestamps, C))
    return hashlib.sha256((text + repr(sorted((options or {}).items()))).encode()).hexdigest()


def compile_stored(rows: DataFrame, path: str, **options) -> DataFrame:
    """``catalog.compile_distinct`` with its compiled forms at ``path``: known ones are read, others compiled and added."""
    spark, store, version = rows.sparkSession, Snapshots(rows.sparkSession, path), code_version(options)
    base = store.current()
    about = store.version(base).about if base else {}
    parts = about["parts"] if about.get("code") == version else []
    keyed = rows.withColumn("fp", C.fingerprint(F.col("sample"), F.col("test_case")))
    todo = keyed.groupBy("fp").agg(F.any_value("sample").alias("sample"), F.any_value(C._mapped(F.col("test_case"))).alias("test_case"))
    if parts:
        known = spark.read.parquet(*[f"{store.path}/data/{p}" for p in parts]).select("fp")
        todo = todo.join(known, "fp", "left_anti")
    folder = store.fresh()
    made = C.tokenize_table(spread(todo, "fp"), **options).withColumn("compiled_fp", C.fingerprint(F.col("sample"), F.col("test_case")))
    C._analyzed(made).write.parquet(folder)
    own = folder.rsplit("/", 1)[-1]
    if spark.read.parquet(folder).limit(1).count() or not parts:
        parts = [*parts, own]
        try:
            store.publish(folder, base, {"code": version, "parts": parts})
        except SaveConflict:
            pass
    forms = spark.read.parquet(*[f"{store.path}/data/{p}" for p in parts])
    return keyed.drop("sample", "test_case").join(forms, "fp").drop("fp")
