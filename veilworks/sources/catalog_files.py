"""The template catalog as a file: ``{"schema_version": 1, "logs": [...]}`` with comments allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored_step
from .snapshots import Snapshots
from .tables import dealt

TEST_CASE = "map<string,array<string>>"
LOG = f"struct<id:string,name:string,sample:string,source:string,test_case:{TEST_CASE}>"
CATALOG = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("logs", T.ArrayType(T.StringType())),
    ]
)


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per catalog file; entries stay JSON text so that wrong types can be reported, not coerced."""
    return (
        spark.read.schema(CATALOG)
        .option("multiLine", True)
        .option("allowComments", True)
        .json(path)
        .select("schema_version", "logs", F.input_file_name().alias("file"))
    )


def _type_of(entry: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(entry, f"$.{name}", "variant"))


def read_raw_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries as read, for validation: ``(file, schema_version, pos, entry, is_object, id, ..., types)``.

    A file without a ``logs`` array yields one row with a NULL ``pos``.
    """
    exploded = _documents(spark, path).select(
        "file", "schema_version", F.col("logs").isNotNull().alias("has_logs"),
        F.posexplode_outer("logs").alias("pos", "entry"),
    )
    return described(exploded)


def described(exploded: DataFrame) -> DataFrame:
    """Entries of files, with the types of their members."""
    v = F.try_parse_json("entry")
    parsed = exploded.withColumn("v", v)
    texts = {n: F.try_variant_get("v", f"$.{n}", "string") for n in ("id", "name", "sample", "source")}
    return parsed.select(
        "file",
        "schema_version",
        "has_logs",
        "pos",
        "entry",
        F.schema_of_variant("v").startswith("OBJECT").alias("is_object"),
        *[F.when(_type_of(F.col("v"), n) == "STRING", c).alias(n) for n, c in texts.items()],
        F.coalesce(_type_of(F.col("v"), "source"), F.lit("MISSING")).alias("source_type"),
        F.coalesce(_type_of(F.col("v"), "test_case"), F.lit("MISSING")).alias("test_case_type"),
        F.from_json(F.get_json_object("entry", "$.test_case"), "map<string,string>").alias("test_case_raw"),
    )


def read_catalog(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``(pos, id, name, sample, source, test_case)`` in file order. ``strict`` raises on the first violation."""
    if strict:
        from ..operators.catalog import catalog_file_violations

        bad = catalog_file_violations(read_raw_catalog(spark, path)).orderBy("pos").first()
        if bad:
            raise ValueError(f"catalog {path}: {bad['rule']} (entry {bad['pos']}, id {bad['id']})")
    rows = _documents(spark, path).select(F.posexplode("logs").alias("pos", "entry"))
    return catalog_columns(rows)


def catalog_columns(rows: DataFrame) -> DataFrame:
    """The columns of a catalog, of ``(pos, entry)``."""
    return rows.select("pos", F.from_json("entry", LOG).alias("log")).select("pos", *_columns("log"))


def _columns(log: str) -> list[Column]:
    return [
        F.col(f"{log}.id"),
        F.col(f"{log}.name"),
        F.col(f"{log}.sample"),
        F.coalesce(f"{log}.source", F.lit("")).alias("source"),
        F.coalesce(f"{log}.test_case", F.create_map().cast(TEST_CASE)).alias("test_case"),
    ]


def catalog_entry() -> Column:
    """One entry as JSON; an empty source or test case is left out."""
    return F.to_json(F.struct(*_fields()), {"ignoreNullFields": "true"})


def _fields() -> list[Column]:
    return [
        F.col("id"),
        F.col("name"),
        F.col("sample"),
        F.when(F.col("source") != "", F.col("source")).alias("source"),
        F.when(F.size("test_case") > 0, F.col("test_case")).alias("test_case"),
    ]


ENTRY = f"struct<pos:int,{LOG.removeprefix('struct<')}"


def write_catalog(df: DataFrame, path: str, base: int | None = None) -> int:
    """Tokenize, then save as the next version of the catalog at ``path``; raw text never reaches storage.

    The entries are JSON lines with their place in the catalog (``pos``), written by tasks that share the rows evenly
    into a folder of their own. They become the catalog when their version is published, so ``df`` may read the catalog it
    is saved to, a save that fails leaves the version before it, and a save that does not start from the last version (``base``,
    by default the last one when this call begins) raises ``SaveConflict``. Returns the number of the version.
    """
    from ..operators.catalog import tokenize_table

    at = Snapshots(df.sparkSession, path)
    base = at.current() if base is None else base
    _check(df)
    folder = at.fresh()
    tokenize_table(dealt(df, "pos")).select(F.to_json(F.struct("pos", *_fields()), {"ignoreNullFields": "true"}).alias("value")).write.text(folder)
    return at.publish(folder, base, {"schema_version": 1}).number


def read_entries(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a catalog that ``write_catalog`` saved, the last one by default; ``pos`` is the order of the catalog.

    The table reads this version for good, also if others are saved before it is computed.
    """
    at = Snapshots(spark, path).version(version)
    if at.about.get("schema_version") != 1:
        raise ValueError(f"catalog {path}: schema_version")
    rows = spark.read.schema("value string").text(at.data).select(F.from_json("value", ENTRY).alias("log"))
    return rows.select("log.pos", *_columns("log"))


def export_document(df: DataFrame, path: str, max_bytes: int | None = None) -> None:
    """The catalog as one JSON document, for tools that read that form; an error above ``max_bytes``, if given.

    One task writes it, entry by entry, from ranges of ``pos`` that are sorted one after the other, so its memory does not
    grow with the catalog. Tokenizing is dealt over all cores before.
    """
    from ..operators.catalog import tokenize_table

    _check(df)
    rows = stored_step(tokenize_table(dealt(df, "pos")).select("pos", catalog_entry().alias("entry")))
    size, last = rows.agg(F.coalesce(F.sum(F.octet_length("entry")), F.lit(0)), F.max(F.struct("pos", "entry"))).first()
    if max_bytes is not None and size > max_bytes:
        raise ValueError(f"a document of {size} bytes: write_catalog has no limit")
    frame = [(0, '{\n  "schema_version": 1,\n  "logs": ['), (2, "  ]\n}")] + ([(1, "")] if last is None else [])
    ends = F.lit(True) if last is None else F.col("pos").eqNullSafe(F.lit(last["pos"])) & (F.col("entry") == last["entry"])
    lines = rows.withColumn("part", F.lit(1)).unionByName(df.sparkSession.createDataFrame(frame, "part int, entry string"), allowMissingColumns=True)
    line = F.when(F.col("part") != 1, F.col("entry")).otherwise(F.concat(F.lit("    "), "entry", F.when(ends, "").otherwise(",")))
    lines.orderBy("part", "pos", "entry").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _check(df: DataFrame) -> None:
    from ..operators.catalog import save_violations

    bad = save_violations(df).first()
    if bad:
        raise ValueError(f"catalog not written: {bad['rule']} (id {bad['id']})")
