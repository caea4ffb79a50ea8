"""File trees as DataFrames: contents, names, modes, and the members of archives."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from artiscope.functions import constants as C

# --- fixed values: kinds of files by extension, and names of credential files ---
TEXT_EXTENSIONS = (
    ".config", ".xml", ".json", ".ini", ".env", ".yaml", ".yml", ".sql", ".reg", ".txt", ".log", ".properties", ".conf", ".cfg", ".manifest", ".ps1", ".bat", ".cmd", ".vbs", ".js",
    ".toml", ".service", ".timer", ".socket", ".desktop", ".plist", ".entitlements", ".control", ".list", ".repo",
)
PE_EXTENSIONS, ELF_EXTENSIONS, MACHO_EXTENSIONS = (".exe", ".dll", ".sys", ".ocx"), (".so", ".ko"), (".dylib", ".bundle")
DB_EXTENSIONS = (".mdb", ".accdb", ".sqlite", ".sqlite3", ".db")
SECRET_NAMES = (
    ".env", ".npmrc", ".yarnrc", ".pypirc", ".netrc", "_netrc", ".git-credentials", ".pgpass", ".my.cnf", ".dockercfg", ".htpasswd", ".s3cfg", ".boto", "credentials", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
)


def name_of(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; none for a name whose only dot comes first."""
    return F.lower(F.regexp_extract(name_of(path), r"[^.].*?(\.[^.]*)$", 1))


def is_secret_name(path: Column) -> Column:
    low = F.lower(name_of(path))
    return low.isin(*SECRET_NAMES) | low.startswith(".env.")


def file_class(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*TEXT_EXTENSIONS) | is_secret_name(path), "text").when(e.isin(*PE_EXTENSIONS), "pe").when(e.isin(*ELF_EXTENSIONS), "elf").when(e.isin(*MACHO_EXTENSIONS), "macho").when(e.isin(*DB_EXTENSIONS), "db").otherwise("unknown")


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, C.SKIP_DIRS)))


def binary_kind() -> Column:
    """pe, elf, macho or class by the first bytes of column content, in native expressions."""
    head = F.hex(F.substring("content", 1, 4))
    digits = F.hex(F.substring("content", 61, 4))  # little-endian place of the second header
    place = F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    mark = F.hex(F.substring(F.col("content"), (place + 1).cast("int"), F.lit(4)))
    arches = F.conv(F.hex(F.substring("content", 5, 4)), 16, 10).cast("bigint")
    macho = head.isin("FEEDFACE", "CEFAEDFE", "FEEDFACF", "CFFAEDFE") | ((head == "CAFEBABE") & arches.between(1, 39))
    pe = head.startswith("4D5A") & place.between(1, 16 << 20) & (mark == "50450000")
    return F.when(pe, "pe").when(head == "7F454C46", "elf").when(macho, "macho").when(head == "CAFEBABE", "class")


def read_files(spark: SparkSession, folder: str, max_bytes: int = C.MAX_FILE_BYTES, hidden: bool = True) -> DataFrame:
    """path, modificationTime, length, content of the files below a folder, without skipped folders and larger files.

    Spark's file sources pass over names that begin with a dot or an underscore; ``hidden`` adds those of a
    local or mounted folder, among them most credential files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    out = files.where((F.col("length") <= max_bytes) & ~in_skipped_dir(F.col("path"))).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    if hidden and os.path.isdir(folder):
        spark.dataSource.register(HiddenFiles)
        out = out.unionByName(spark.read.format("hidden_files").option("max_bytes", max_bytes).load(folder))
    return out


def names_beside(spark: SparkSession, path: str) -> DataFrame:
    """path of the files in a file's folder, not below it."""
    return spark.read.format("binaryFile").load(os.path.dirname(path) or ".").select("path")


def scannable(files: DataFrame) -> DataFrame:
    return files.where((file_class(F.col("path")) != "unknown") | is_secret_name(F.col("path")))


def as_text(files: DataFrame, limit: int = C.MAX_TEXT_BYTES) -> DataFrame:
    """file_path and text; bytes that aren't UTF-8 are left out, as are those beyond the limit."""
    valid = F.expr(f"replace(make_valid_utf8(cast(substring(content, 1, {limit}) as string)), '\\uFFFD', '')")
    return files.select(F.col("path").alias("file_path"), valid.alias("text"))


class _Modes(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.skip = options["path"], C.SKIP_DIRS

    def partitions(self) -> list[InputPartition]:
        """One for the files of the root, one for each folder in it."""
        try:
            entries = sorted(os.scandir(self.root), key=lambda e: e.name)
        except OSError:
            return []
        folders = [e.path for e in entries if e.is_dir(follow_symlinks=False) and e.name not in self.skip]
        return [InputPartition((self.root, False)), *(InputPartition((p, True)) for p in folders)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        top, deep = partition.value
        for folder, dirs, names in os.walk(top):
            dirs[:] = sorted(d for d in dirs if d not in self.skip and not os.path.islink(os.path.join(folder, d))) if deep else []
            for name in sorted(names):
                path = os.path.join(folder, name)
                try:
                    s = os.lstat(path)
                except OSError:
                    continue
                yield path, stat.S_IMODE(s.st_mode), stat.S_ISLNK(s.st_mode), s.st_size


class FileModes(DataSource):
    """``spark.read.format('file_modes').load(folder)``: path, mode, is_symlink, length. Symbolic links aren't followed."""

    @classmethod
    def name(cls) -> str:
        return "file_modes"

    def schema(self) -> str:
        return "path string, mode int, is_symlink boolean, length bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Modes(self.options)


class _Hidden(_Modes):
    def __init__(self, options: dict):
        super().__init__(options)
        self.max_bytes = int(options.get("max_bytes", C.MAX_FILE_BYTES))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, _, is_link, length in super().read(partition):
            below = os.path.relpath(path, self.root).split(os.sep)
            if not is_link and length <= self.max_bytes and any(p[0] in "._" for p in below):
                try:
                    with open(path, "rb") as f:
                        yield path, datetime.fromtimestamp(os.path.getmtime(path), timezone.utc), length, f.read(self.max_bytes)
                except OSError:
                    continue


class HiddenFiles(DataSource):
    """``spark.read.format('hidden_files').load(folder)``: files that Spark's own sources pass over by their names."""

    @classmethod
    def name(cls) -> str:
        return "hidden_files"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Hidden(self.options)


def read_modes(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(FileModes)
    return spark.read.format("file_modes").load(folder)

