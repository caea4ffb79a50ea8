"""Text tables as files: one row is one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small table dealt out to all cores; a table that is read in as many parts as there are cores stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (file_path, text): the path is source/id."""
    return spread(read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), "text"))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("file_path"), "text")
