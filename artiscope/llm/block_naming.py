"""Exact duplicates by deterministic block naming.

A text, lower-cased in A-Z only, is cut into blocks of a fixed number of bytes. All different blocks of the corpus are
sorted, and a block's place in that order is its name. Then the names of adjacent blocks are paired, the different pairs
are sorted and named alike, and so on until one name is left of each text. Texts of one number of blocks and one last name
are equal, and no others: a name stands for one block, or for one pair of names, and for nothing else.

How an occurrence learns its name: the bytes of a block travel once, to the sort, after equal blocks have been folded
within each task. Occurrences travel as handles of 128 bits. As the sort holds every handle beside the block's bytes, it
shows whether two different blocks share one; if so, all handles are drawn anew with another seed. So no answer rests on
a hash, and long texts neither move twice nor meet in one task.

Names of which an occurrence table holds more than one part in ``4 * partitions`` are hot; there are at most ``4 * partitions``
of them, so these are broadcast, and the others are joined by sorting. Only native expressions are used.

Odd input: a null text counts as empty, and empty texts are equal to one another. Rows without an id are rows like any
other, below every id; of rows that repeat id and text one stays. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artiscope.llm._scratch import cut, drop, table

#: Bytes of a block. Longer ones mean fewer levels of pairs, shorter ones smaller rows.
BLOCK_BYTES = 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: F.Column) -> F.Column:
    """``text`` with A-Z lower-cased and nothing else; null: empty. Where all characters are ASCII, ``lower`` does that, and faster."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def blocks(text: F.Column, size: int) -> F.Column:
    """The bytes of ``text`` in blocks of ``size``, the last one shorter; an empty text is one empty block."""
    raw = text.cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(raw) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(raw, i * size + 1, F.lit(size)))


def handle(block: F.Column, seed: int, bits: int = 64) -> list[F.Column]:
    """Two numbers of a block, ``bits`` bits each, drawn by ``seed``."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(2 * seed + k), block), 64 - bits).alias(name) for k, name in ((0, "a"), (1, "b"))]


def named(keys: DataFrame, tag: str) -> DataFrame:
    """The different rows of ``keys`` with how often they occur (n) and an integer name: their place in sorted order, part by part."""
    one = keys.groupBy(*keys.columns).agg(F.count("*").alias("n")).sortWithinPartitions(*keys.columns)
    return cut(one.withColumn("name", F.monotonically_increasing_id()).drop("block"), tag)


def look_up(refs: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """``refs`` with the columns of ``names``, which has one row and a count n for each key; hot keys are broadcast."""
    parts = 4 * int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = names.agg(F.sum("n")).first()[0] or 0
    hot, rest = F.broadcast(names.where(F.col("n") * parts > total)), names.where(F.col("n") * parts <= total)
    return refs.join(hot, on).unionByName(refs.join(hot.select(*on), on, "left_anti").join(rest, on))


def _base_names(docs: DataFrame, text: str, size: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Each row with its number and its blocks' handles, and the named handles, of which each stands for one block."""
    seed = 0
    while True:
        cut_up = blocks(F.col(text), size)
        handles = F.transform("blocks", lambda x: F.struct(*handle(x, seed, bits)))
        rows = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("sha", F.unhex(F.sha2(F.col(text).cast("binary"), 256))).withColumn("blocks", cut_up)
        rows = cut(rows.select("row", "id", "sha", handles.alias("handles")), "naming-rows")
        names = named(docs.select(F.explode(cut_up).alias("block")).select(*handle(F.col("block"), seed, bits), "block"), "naming-blocks")
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            return rows, names
        drop(rows, names)
        seed, bits = seed + 1, 64


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """For each row of ``docs``: row (a number of its own), id, sha (of the normalised text), n_blocks and name; the last two are the text's identity.

    ``bits`` is the width of the first handles' halves; tests make it small, so that handles must be drawn anew.
    """
    rows, names = _base_names(docs.select(F.col(id_col).alias("id"), lower_ascii(F.col(text_col)).alias("txt")), "txt", size, bits)
    refs = rows.select("row", F.size("handles").alias("n_blocks"), F.posexplode("handles").alias("at", "h")).select("row", "n_blocks", "at", "h.a", "h.b")
    found = look_up(refs, names, ["a", "b"])
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    one = found.where("n_blocks = 1").select("row", "n_blocks", F.array("name").alias("names"))
    now = cut(one.unionByName(found.where("n_blocks > 1").groupBy("row", "n_blocks").agg(gathered.alias("names"))), "naming-level")
    drop(names)
    done, tables = [], [now]
    while True:
        done.append(now.where("size(names) = 1").select("row", "n_blocks", F.element_at("names", 1).alias("name")))
        left = now.where("size(names) > 1")
        if left.isEmpty():
            break
        halves = F.transform(F.sequence(F.lit(0), F.floor(F.size("names") / 2).cast("int") - 1), lambda i: F.struct(F.get("names", 2 * i).alias("x"), F.get("names", 2 * i + 1).alias("y")))
        tail = F.when(F.size("names") % 2 == 1, F.element_at("names", -1))
        pairs = left.select("row", "n_blocks", tail.alias("tail"), F.posexplode(halves).alias("at", "p")).select("row", "n_blocks", "tail", "at", "p.x", "p.y")
        names = named(pairs.select("x", "y"), "naming-pairs")
        grown = look_up(pairs, names, ["x", "y"]).groupBy("row", "n_blocks", "tail").agg(gathered.alias("names"))
        now = cut(grown.select("row", "n_blocks", F.when(F.col("tail").isNull(), F.col("names")).otherwise(F.concat("names", F.array("tail"))).alias("names")), "naming-level")
        drop(names)
        tables.append(now)
    out = cut(reduce(DataFrame.unionByName, done).join(rows.select("row", "id", "sha"), "row"), "naming-identities")
    drop(rows, *tables)
    return out


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """Each row's id, keep_id (the largest id of an equal text), group_size, kept (one row a group) and text_sha256."""
    each = identities(docs, id_col, text_col, size, bits)
    groups = each.groupBy("n_blocks", "name").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("best"))
    return look_up(each, cut(groups, "naming-groups"), ["n_blocks", "name"]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op11_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_block_naming": op11_block_naming}
ORACLE_SQL = {
    "op11_block_naming": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(k) AS text_sha256
FROM t WINDOW w AS (PARTITION BY k)"""
}
