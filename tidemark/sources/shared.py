"""Written tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; on one machine, where none is set, a folder below /tmp."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/tidemark"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written once and read back."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(df: DataFrame, tag: str) -> DataFrame:
    """``written``, for a table that grows with its input: it is joined by sorting.

    Its files are packed so well that by their size alone hundreds of MB in memory would be broadcast, through the driver and to every executor.
    """
    return written(df, tag).hint("merge")
