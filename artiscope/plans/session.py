"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from artiscope.sources.batches import small_batches

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_import(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies; on a cluster it is installed or shipped with --py-files. Rows go to them in small batches."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    small_batches(spark)
