"""From documents to training sequences: quality rules, near-duplicate removal, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
for the next one. All but the last return the columns of documents. Nulls: a document without text is
rejected by the quality rules, so later stages see texts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from artiscope.llm import decontaminate, jaccard_groups, packing, pii, quality_cascade
from artiscope.llm._scratch import cut, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    small_batches(spark)
    return quality_cascade.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    small_batches(spark)
    return jaccard_groups.keep_one(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    small_batches(spark)
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in training sequences."""
    small_batches(spark)
    return packing.pack(docs, packing.tokenizer_file())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("pii", private_data),
    ("best-fit packing", sequences),
]

#: Quality rules are SQL; the other stages aren't, so tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
