"""Windows services from registry exports and service listings, and unquoted paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from artiscope.functions.findings import findings

NAME_RE = r"(?i)^\s*(?:SERVICE_NAME|Name)\s*[:=]\s*(\S+)"
PATH_RE = r"(?i)(\"?[A-Za-z]:\\[^\r\n]*?\.exe\b[^\r\n]*)"
EXE_RE = r"(?i)^(.*?\.exe)"
KEY_RE = r"^\[.*\\([^\\\]]+)\]\s*$"


def _lines(texts: DataFrame, joined: Column) -> DataFrame:
    return texts.select("source", F.posexplode(F.split(joined, r"\r\n|\r|\n")).alias("n", "line"))


def _carried(lines: DataFrame, name: Column, otherwise: str) -> DataFrame:
    """The last name before each line of a source; the window's partition is one file."""
    w = W.partitionBy("source").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    found = F.when(name != "", name)
    return lines.withColumn("name", F.coalesce(F.last(found, ignorenulls=True).over(w), F.lit(otherwise)))


def from_listing(texts: DataFrame) -> DataFrame:
    """name, image_path, source of service listings (source, text): a path belongs to the last name above it."""
    lines = _carried(_lines(texts, F.col("text")), F.regexp_extract("line", NAME_RE, 1), "unknown-service")
    return lines.select("name", F.trim(F.regexp_extract("line", PATH_RE, 1)).alias("image_path"), "source").where("image_path <> ''")


def _utf16(hexes: Column) -> Column:
    """Text of comma-separated UTF-16 little-endian bytes, up to its end mark."""
    raw = F.unhex(F.regexp_replace(hexes, r"[^0-9A-Fa-f]", ""))
    return F.substring_index(F.decode(raw, "UTF-16LE"), "\0", 1)


def from_registry(texts: DataFrame) -> DataFrame:
    """name, image_path, source of registry exports (source, text): ImagePath as text or as hex(2), continued lines joined."""
    joined = F.regexp_replace("text", r"\\\r?\n\s*", "")
    lines = _carried(_lines(texts, joined), F.regexp_extract("line", KEY_RE, 1), "unknown-service")
    plain = F.regexp_extract("line", r'(?i)^\s*"ImagePath"="(.*)"\s*$', 1)
    hexes = F.regexp_extract("line", r'(?i)^\s*"ImagePath"=hex\(2\):([0-9a-f, ]+)', 1)
    unescaped = F.regexp_replace(F.regexp_replace(plain, r"\\\\", r"\\"), r'\\"', '"')
    path = F.when(plain != "", unescaped).when(hexes != "", _utf16(hexes))
    return lines.select("name", path.alias("image_path"), "source").where("image_path <> ''")


def executable(path: Column) -> Column:
    return F.regexp_extract(F.trim(path), EXE_RE, 1)


def is_unquoted(path: Column) -> Column:
    """The program part has a space and a directory, and no quote before it."""
    exe = executable(path)
    return ~F.trim(path).startswith('"') & exe.contains(" ") & (exe.contains("\\") | exe.contains("/"))


def candidates(path: Column) -> Column:
    """What a service manager tries for an unquoted path, in order."""
    parts = F.split(executable(path), " ")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), " "), F.lit(".exe")))).otherwise(F.array().cast("array<string>"))


def unquoted_findings(services: DataFrame) -> DataFrame:
    rows = services.where(is_unquoted(F.col("image_path")))
    c = F.col
    return findings(rows, module="dll_hijack", rule_id="unquoted-service-path", title=F.concat(F.lit("Unquoted service path: "), c("name")), severity="High", file_path=c("source"), evidence=c("image_path"), tags=["dll", "permissions"], confidence="High", extra=F.to_json(F.struct(candidates(c("image_path")).alias("candidates"))))
