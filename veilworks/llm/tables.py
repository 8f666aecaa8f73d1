"""Tables between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import fresh_folder


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage is cut, and columns take less room than a checkpoint."""
    folder = fresh_folder(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt_anew(df: DataFrame) -> DataFrame:
    """An aggregate that is to be joined by its keys, without its partitioning.

    Spark then shuffles it for the join. Only between two such shuffles does adaptive execution split a hot key of the
    other side; an aggregate joined in place would leave all rows of the key to one task. No partition is merged here.
    """
    return df.coalesce(1 << 20)
