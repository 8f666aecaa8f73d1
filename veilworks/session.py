"""Session set-up and the few run-time settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "veilworks", master: str | None = None, shuffle_partitions: int | None = None, folder: str | None = None) -> SparkSession:
    """A session with adaptive execution and a UTC clock; ``folder`` is shared by all executors. The rest is left to the cluster."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites are not recorded per column expression: large expressions are built twice as fast
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master)
    if folder:
        b = b.config("spark.checkpoint.dir", folder)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Rendering and parsing format wall-clock strings through the session zone; it must be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="veilworks-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/veilworks-{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove_folders(spark: SparkSession) -> None:
    """Delete what this application's jobs have written between their steps. Tables that read it are gone then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so lost executors do not replay the whole plan."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored_step(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder: as ``cut_lineage``, but smaller, and later steps read only the columns they need."""
    path = fresh_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
