"""Results that later steps read more than once, kept in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from planloom.operators.shared_folder import new_folder


def saved(frame: DataFrame, name: str) -> DataFrame:
    """`frame` written to the shared folder and read back: its lineage ends there.

    A lost executor costs nothing, as the files are in the folder named by
    spark.checkpoint.dir. They stay until that folder is cleared, since the result is lazy.
    """
    path = new_folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
