"""Rescans that reuse what is unchanged: as a join with a cache table, and as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def work_list(files: DataFrame, cache: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Files that the cache doesn't hold with the same content."""
    return files.join(cache.select(key, digest).distinct(), [key, digest], "left_anti")


def reused(files: DataFrame, cached_findings: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Cached findings of files that are unchanged; findings of changed or vanished files go."""
    return cached_findings.join(files.select(key, digest).distinct(), [key, digest], "left_semi")


def rescan(files: DataFrame, cached_findings: DataFrame, cache: DataFrame, scan: Callable[[DataFrame], DataFrame], key: str = "path", digest: str = "sha256") -> DataFrame:
    """Findings of all files: new ones for the work list, cached ones for the rest."""
    return scan(work_list(files, cache, key, digest)).unionByName(reused(files, cached_findings, key, digest), allowMissingColumns=True)


def stream_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """A stream of the files below a folder; each file comes once for a checkpoint."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def scan_available(files: DataFrame, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Scan what is there now and not yet in the checkpoint; findings append to a Parquet table.

    A batch that is retried overwrites its own folder, so every file's findings are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        scan(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
