"""Incremental builds: only what is new or changed is built again, in a batch or as a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.schema import DOCUMENT


def listed(spark: SparkSession, path: str, build_key: str) -> DataFrame:
    """(file, key) of the input files: size, modification time and the version of code and places."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "modificationTime")
    return files.select("file", F.sha2(F.concat_ws("|", F.col("length").cast("string"), F.col("modificationTime").cast("string"), F.lit(build_key)), 256).alias("key"))


def changes(now: DataFrame, built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to build: new or with another key; files whose matches go: no longer there)."""
    return now.join(built.select("file", "key"), ["file", "key"], "left_anti"), built.join(now.select("file"), "file", "left_anti")


def merged_manifest(now: DataFrame) -> DataFrame:
    return now.select("file", "key")


def stream_documents(
    spark: SparkSession, path: str, checkpoint: str, build: Callable[[DataFrame], None], files_per_batch: int = 1000
):
    """Every document that landed since the last call goes to ``build`` once, in bounded batches; then the query ends.

    A match is complete when its file lands, so no watermark is needed; the checkpoint makes a restart go on where
    it stopped. ``build`` must be idempotent for a batch, as writing by match is.
    """
    docs = spark.readStream.schema(DOCUMENT).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)
    return (
        docs.writeStream.foreachBatch(lambda batch, _: build(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def replace_matches(table: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The table with the fresh matches' rows in the place of their old ones, and without those that are gone."""
    kept = table.join(fresh.select("match_id").distinct(), "match_id", "left_anti")
    if gone is not None:
        kept = kept.join(gone.select("match_id"), "match_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
