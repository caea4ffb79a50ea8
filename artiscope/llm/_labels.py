"""Labelled training rows and their split, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % parts).cast("int")


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(remainder(id_col, parts) == part, F.lit(False))


def training_labels(labels: DataFrame, label: str, parts: int, part: int, id_col: str = "doc_id") -> DataFrame:
    """id and label (0 or 1) of the rows that aren't held out; of repeated ids the larger label counts."""
    rows = labels.select(id_col, F.col(label).cast("int").alias("label")).where(f"{id_col} is not null and label in (0, 1)")
    return rows.where(~held_out(id_col, parts, part)).groupBy(id_col).agg(F.max("label").alias("label"))


def first_rows(rows: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows, the same ones every time: the first by a hash of the id."""
    return rows.orderBy(*_order(id_col)).limit(limit)


def _order(id_col: str) -> list[Column]:
    return [F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.col(id_col)]


def within(ids: DataFrame, texts: DataFrame, size: Column, most: int, id_col: str = "doc_id") -> DataFrame:
    """Of a bounded sample of ids, in its order, those whose texts' sizes add up to no more than ``most``: what is learnt from is bounded as a whole."""
    sizes = texts.join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.max(size).cast("long").alias("size"))
    upto = F.sum("size").over(W.orderBy(*_order(id_col)).rowsBetween(W.unboundedPreceding, 0))
    return sizes.withColumn("upto", upto).where(F.col("upto") <= most).select(id_col)
