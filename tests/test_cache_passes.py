"""How often an update of the cache reads the files."""

from pyspark.sql import functions as F

from artiscope.streaming.cache import FOUND, FindingCache


def test_an_update_hashes_each_file_once(spark, tmp_path):
    hashed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def digest(path):
        hashed.add(1)
        return path

    cache = FindingCache(spark, f"file://{tmp_path}/cache", buckets=4)
    scanned = spark.range(40).repartition(2).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit("m").alias("module"))
    cache.upsert(scanned.withColumn("sha256", digest.asNondeterministic()("path")), spark.createDataFrame([], FOUND))
    assert cache.entries().count() == 40
    assert hashed.value == 40
