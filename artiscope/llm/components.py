"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artiscope.llm._scratch import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """node and comp (the smallest node it is connected with) for each node of ``edges`` (a, b) but those smallest ones.

    Every round is a written table. A round's cost is that of its edges, whose number never grows.
    """
    now = edges.where("a <> b").select("a", "b")
    while True:
        nxt = cut(_small_star(_large_star(now)).where("a <> b").distinct(), tag)
        drop(now)
        now = nxt
        # done when every node has one edge, to a node without any
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
