"""Archives as a source: listed first, judged against a budget for each root, then read in ranges of members.

A root is a file of the tree. A level of archives is listed (a directory of members is small), sums over the levels so far
decide which archives of a root still fit, and what fits is cut into ranges of members that are unpacked together; a range
is a row, so one large archive is read by many tasks, each of which seeks to its own members. Archives of a mounted folder
are opened where they lie, so no archive is ever a value; those that come with their content, as members of other archives
do, are read from it.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artiscope.binary import archives
from artiscope.sources.batches import file_rows, record_batches

#: Bytes of members that one range holds, unless a block or a member is larger.
RANGE_BYTES = 64 << 20
#: Members shorter than this are no archives.
LEAST_BYTES = 64
ENDS = (*archives.ZIP_LIKE, *archives.TAR_LIKE, *archives.UNREADABLE, *archives.OTHERS)
MEMBERS = "path string, content binary, extracted_from string, depth int, note string"


def is_candidate(path: str) -> F.Column:
    """A file whose name is that of an archive or of what may carry one."""
    return F.lower(F.col(path)).rlike(r"\.(" + "|".join(x[1:].replace(".", r"\.") for x in ENDS) + ")$")


def _open(path: str, content: bytes | None) -> BinaryIO:
    return open(path, "rb") if content is None else io.BytesIO(content)


def _name(path: str) -> str:
    return path.rsplit(" > ", 1)[-1].replace("\\", "/").rsplit("/", 1)[-1]


def _ranges(entries: list[archives.Entry], most: int) -> Iterator[list[int]]:
    """Numbers of entries, dealt into ranges of about ``most`` bytes that keep blocks whole."""
    order = sorted(range(len(entries)), key=lambda k: (entries[k].block, k))
    own, size = [], 0
    for n, k in enumerate(order):
        if own and size >= most and entries[k].block != entries[order[n - 1]].block:
            yield own
            own, size = [], 0
        own.append(k)
        size += entries[k].size
    if own:
        yield own


def _listed(most: int, limit: int):
    """For each archive a row with its total, and one for each range of its members."""
    schema = pa.schema([("root", pa.string()), ("path", pa.string()), ("total", pa.int64()), ("wanted", pa.list_(pa.int32())), ("note", pa.string())])

    def rows(root: str, path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            with _open(path, content) as f:
                found = archives.listing(_name(path), f, limit)
        except OSError as e:
            found = archives.Listing("", note=f"{_name(path)}: {type(e).__name__}")
        if found is not None:
            yield root, path, found.total, None, found.note
            yield from ((root, path, 0, r, None) for r in _ranges(found.entries, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches((r for row in file_rows(batches) for r in rows(*row)), schema.types, schema.names, lambda r: 4 * len(r[3] or ()))

    return run, "root string, path string, total long, wanted array<int>, note string"


def _unpacked(limit: int):
    """Members of ranges; a range that can't be read is a note."""
    schema = pa.schema([("root", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("extracted_from", pa.string()), ("note", pa.string())])

    def rows(root: str, path: str, content: bytes | None, wanted: list[int]) -> Iterator[tuple]:
        note = None
        try:
            with _open(path, content) as f:
                found = archives.listing(_name(path), f, limit)
                entries = [found.entries[k] for k in wanted]
                for e, body in zip(entries, archives.read(found.kind, f, entries), strict=True):
                    yield root, f"{path} > {e.path}", body, path, None
        except archives.BROKEN as e:
            note = f"{_name(path)}: {type(e).__name__}" + (f" ({e})" if isinstance(e, archives.sevenzip.Unsupported) else "")
        if note:
            yield root, path, None, path, note

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches((r for row in file_rows(batches) for r in rows(*row)), schema.types, schema.names, lambda r: len(r[2] or b""))

    return run, "root string, path string, content binary, extracted_from string, note string"


def _fitting(listed: DataFrame, spent: DataFrame, max_total: int) -> DataFrame:
    """root, spent and passed (archives that don't fit), in the order of paths: what doesn't fit is passed over, smaller ones after it may fit."""
    own = listed.where("wanted is null and note is null").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("path", "total"))).alias("all"))
    own = own.join(spent, "root", "left")
    start = F.struct(F.coalesce("spent", F.lit(0).cast("long")).alias("spent"), F.array().cast("array<string>").alias("passed"))

    def step(done, one):
        after = done["spent"] + one["total"]
        return F.when(after <= max_total, F.struct(after.alias("spent"), done["passed"].alias("passed"))).otherwise(F.struct(done["spent"].alias("spent"), F.array_append(done["passed"], one["path"]).alias("passed")))

    return own.select("root", F.aggregate("all", start, step).alias("a")).select("root", "a.*")


def expand(files: DataFrame, max_depth: int = 2, max_total: int = 2048 << 20, max_archives: int | None = 25, mounted: bool = False, range_bytes: int = RANGE_BYTES, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Members of archives, level by level, and notes of what wasn't unpacked.

    files: path, content. A member's path is archive > member. The first ``max_archives`` candidates by path (None: all) are
    roots; of each root at most ``max_total`` bytes are unpacked, over all levels. Archives in archives are opened down to
    ``max_depth`` levels below their root. mounted: all machines see the files' paths, so roots are opened there and their
    content isn't read as a value. keep: what holds on to each level's listing and members, by default Spark's cache. Levels are
    computed one after another, as far as there are archives.
    """
    keep = keep or (lambda df: df.persist(StorageLevel.MEMORY_AND_DISK))
    rows = files.where(is_candidate("path"))
    if max_archives is not None:
        first = rows.select("path").orderBy("path").limit(max_archives)
        rows = rows.join(F.broadcast(first), "path", "left_semi")
    level = rows.select(F.col("path").alias("root"), "path", F.lit(None).cast("binary").alias("content") if mounted else F.col("content"))
    lister, listed_schema = _listed(range_bytes, max_total)
    reader, read_schema = _unpacked(max_total)
    spark = files.sparkSession
    spent = spark.createDataFrame([], "root string, spent long")
    members = [spark.createDataFrame([], "path string, content binary, extracted_from string, depth int")]
    notes = [spark.createDataFrame([], "path string, note string")]
    for depth in range(max_depth + 1):
        opened = mounted and depth == 0
        # paths alone are dealt out, contents stay where they are
        listed = keep((level.repartition("path") if opened else level).mapInArrow(lister, listed_schema))
        if listed.isEmpty():
            break
        judged = keep(_fitting(listed, spent, max_total))
        over = judged.select(F.explode("passed").alias("path"))
        ranges = listed.where("wanted is not null").join(over, "path", "left_anti").select("path", "wanted")
        if opened:
            parts = ranges.withColumn("root", F.col("path")).withColumn("content", F.lit(None).cast("binary")).repartition("path", "wanted")
        else:
            parts = level.join(ranges, "path")
        out = keep(parts.select("root", "path", "content", "wanted").mapInArrow(reader, read_schema))
        members.append(out.where("note is null").select("path", "content", "extracted_from", F.lit(depth + 1).alias("depth")))
        name = F.element_at(F.split("path", r"[/\\]| > "), -1)
        notes += [listed.where("note is not null").select("path", "note"), over.select("path", F.concat(name, F.lit(": larger than the limit when unpacked")).alias("note")), out.where("note is not null").select("path", "note")]
        spent = judged.select("root", "spent").unionByName(spent).groupBy("root").agg(F.max("spent").alias("spent"))
        level = out.where(f"note is null and length(content) >= {LEAST_BYTES}").select("root", "path", "content")
    else:
        deeper = level.mapInArrow(lister, listed_schema).where("wanted is not null").select("path").distinct()
        notes.append(deeper.withColumn("note", F.lit("deeper than the limit")))
    return reduce(DataFrame.unionByName, members), reduce(DataFrame.unionByName, notes)
