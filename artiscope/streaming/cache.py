"""A table of what was scanned and found, keyed by path and module, that rescans update in place.

Entries (path, module, sha256) say what was scanned, with findings or without; findings belong to them. Both are dealt into
buckets by path. An update writes only the buckets that it touches, into a folder of its own, and then a manifest that names
each bucket's folder. A manifest appears by a rename that fails if its number is taken, so readers see the state before
or after an update and two writers can't both win. A batch that is retried after its manifest appeared changes nothing, one
that is retried before writes another folder; what no manifest names is left to ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artiscope.functions.findings import SCHEMA

ENTRIES = "path string, module string, sha256 string"
FOUND = f"{SCHEMA}, severity_rank int, fingerprint string"


class Conflict(RuntimeError):
    """Another writer's update came first."""


class FindingCache:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.buckets = self.manifest().get("n_buckets", buckets)

    # --- manifests ---

    def _versions(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        """The newest one: version, the last batch of each source, and the folder of each bucket's entries and findings."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "batches": {}, "entries": {}, "findings": {}}
        rows = self.spark.read.text(f"{self.folder}/manifests/{versions[-1]}.json").collect()
        return json.loads("\n".join(r.value for r in rows))

    def _publish(self, manifest: dict) -> None:
        temp = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temp)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        goal = self._path(f"{self.folder}/manifests/{manifest['version']}.json")
        if self._fs.exists(goal) or not self._fs.rename(temp, goal):
            self._fs.delete(temp, False)
            raise Conflict(f"version {manifest['version']} is there already")

    # --- reading ---

    def _read(self, kind: str, manifest: dict, only: list[int] | None = None) -> DataFrame:
        schema = ENTRIES if kind == "entries" else FOUND
        folders = {p for b, p in manifest[kind].items() if only is None or int(b) in only}
        none = self.spark.createDataFrame([], schema)
        if not folders:
            return none
        # a folder may hold buckets that a later update wrote anew
        wanted = [f"{self.folder}/{p}/{kind}/bucket={b}" for b, p in manifest[kind].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*wanted)

    def entries(self) -> DataFrame:
        return self._read("entries", self.manifest())

    def findings(self) -> DataFrame:
        return self._read("findings", self.manifest())

    def bucket(self, path: str) -> F.Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    # --- writing ---

    def upsert(self, scanned: DataFrame, found: DataFrame, gone: DataFrame | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Put ``scanned`` (path, module, sha256) and their findings in the place of what is held of these paths and modules; drop paths that are gone.

        batch: source and number; one that isn't newer than the source's last changes nothing. Says whether anything was written.
        """
        now = self.manifest()
        if batch and batch[1] <= now["batches"].get(batch[0], -1):
            return False
        gone = gone.select("path").distinct() if gone is not None else self.spark.createDataFrame([], "path string")
        # narrow rows that five joins and two writes read: files are read and hashed for them once
        keys = scanned.select("path", "module", "sha256").dropDuplicates(["path", "module"]).persist(StorageLevel.MEMORY_AND_DISK)
        gone = gone.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._write(now, keys, gone, found, batch)
        finally:
            keys.unpersist()
            gone.unpersist()

    def _write(self, now: dict, keys: DataFrame, gone: DataFrame, found: DataFrame, batch: tuple[str, int] | None) -> bool:
        touched = sorted(r[0] for r in keys.select("path").unionByName(gone).select(self.bucket("path")).distinct().collect())
        folder = f"data/{now['version'] + 1}-{uuid.uuid4().hex}"
        if touched:
            names = ["path", "module"]
            rest = self._read("entries", now, touched).join(keys, names, "left_anti").join(gone, "path", "left_anti").unionByName(keys)
            cols = [p.strip().split(" ")[0] for p in FOUND.split(",")]
            old = self._read("findings", now, touched).withColumn("path", F.col("file_path")).join(keys, names, "left_anti").join(gone, "path", "left_anti")
            both = old.select("path", *cols).unionByName(found.withColumn("path", F.col("file_path")).join(keys.select(*names), names, "left_semi").select("path", *cols))
            for kind, rows in (("entries", rest), ("findings", both)):
                rows.withColumn("bucket", self.bucket("path")).drop(*(["path"] if kind == "findings" else [])).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}/{kind}")
        new = {"version": now["version"] + 1, "n_buckets": self.buckets, "batches": now["batches"] | ({batch[0]: batch[1]} if batch else {})}
        for kind in ("entries", "findings"):
            held = {b: p for b, p in now[kind].items() if int(b) not in touched}
            new[kind] = held | {str(b): folder for b in touched if self._fs.exists(self._path(f"{self.folder}/{folder}/{kind}/bucket={b}"))}
        self._publish(new)
        return True

    def vacuum(self) -> None:
        """Delete older manifests and the folders that the newest one doesn't name. No reader may be at work on an older state."""
        now = self.manifest()
        used = {p for kind in ("entries", "findings") for p in now[kind].values()}
        data = self._path(f"{self.folder}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in used:
                self._fs.delete(s.getPath(), True)
        for v in self._versions()[:-1]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{v}.json"), False)


def cached_scan(cache: FindingCache, files: DataFrame, scan: Callable[[DataFrame], DataFrame], module: str) -> DataFrame:
    """Findings of ``module`` over ``files`` (path, sha256 and what ``scan`` needs): only files that are new or changed are scanned, files that are gone are forgotten."""
    held = cache.entries().where(F.col("module") == module)
    work = files.join(held.select("path", "sha256"), ["path", "sha256"], "left_anti")
    gone = held.select("path").join(files.select("path"), "path", "left_anti")
    found = scan(work).where(F.col("module") == module)
    cache.upsert(work.select("path", F.lit(module).alias("module"), "sha256"), found, gone)
    return cache.findings().where(F.col("module") == module)


def scan_stream(cache: FindingCache, files: DataFrame, scan: Callable[[DataFrame], DataFrame], module: str, checkpoint: str) -> None:
    """Scan what a stream of files (``incremental.stream_files``) has now and not yet in its checkpoint, into the cache. A retried batch is written once."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).withColumn("sha256", F.sha2("content", 256))
        found = scan(rows).where(F.col("module") == module)
        cache.upsert(rows.select("path", F.lit(module).alias("module"), "sha256"), found, batch=(checkpoint, number))

    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
