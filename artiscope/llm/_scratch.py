"""Where operators of this subpackage cut lineage: tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset a local session gets a temporary folder; a cluster gets an error,
    as its machines would not see each other's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="artiscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def cut(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    A lost executor costs a re-read of the table, never of what was computed before it. ``batch_rows``
    bounds the rows that go to Python at a time meanwhile, for stages whose rows are long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/artiscope/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    if batch_rows:
        spark.conf.set(_BATCH, min(batch_rows, int(before)) if int(before) > 0 else batch_rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._artiscope_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing lazy reads any more."""
    for df in frames:
        path = getattr(df, "_artiscope_path", None)
        if path:
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session.sessionState().newHadoopConf()).delete(at, True)


def free_name(base: str, taken) -> str:
    """``base``, lengthened until no column of ``taken`` (case-insensitive) has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


#: Bits of a table that tells which keys are surely not among others.
KEY_BITS = 24


def among(rows: DataFrame, others: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose ``key`` may be one of those of ``others``, by a bit table of fixed size, or the rows whose key surely isn't.

    The table has at most 2 ** (KEY_BITS - 6) rows of 64 bits, however many keys there are; so it is broadcast,
    and long rows neither move nor go to Python. A null key is a key like any other.
    """
    word, bits = free_name("word", rows.columns), free_name("bits", rows.columns)
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - KEY_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    held = others.groupBy(F.shiftright(slot, 6).alias(word)).agg(F.bit_or(bit).alias(bits))
    fed = rows.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(held), word, "inner" if inside else "left")
    has = F.coalesce(F.col(bits).bitwiseAND(bit), F.lit(0)) != 0
    return fed.where(has if inside else ~has).select(*rows.columns)


#: Rows, and bytes, that go to Python at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in small batches: what a worker and its executor hold is bounded by a batch.

    The setting stays, as what an operator returns is computed later; a smaller one of the caller's is left alone.
    """
    for key, most in ((_BATCH, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; texts of it will go to Python in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
