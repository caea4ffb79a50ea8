"""The cache of findings: updates by key, retries, conflicts, streams."""

import os

import pytest
from pyspark.sql import functions as F

from artiscope.functions.findings import findings
from artiscope.streaming import incremental
from artiscope.streaming.cache import Conflict, FindingCache, cached_scan, scan_stream


def scan(files):
    """A finding for every file that holds a needle."""
    text = F.col("content").cast("string")
    return findings(files.where(text.contains("needle")), module="own", rule_id="needle", title="Needle", severity="Low", file_path=F.col("path"), evidence=text)


def frame(spark, rows):
    return spark.createDataFrame([(p, bytearray(c.encode())) for p, c in rows.items()], "path string, content binary").withColumn("sha256", F.sha2("content", 256))


def state(cache):
    return {(r.path, r.module) for r in cache.entries().collect()}, {(r.file_path, r.evidence) for r in cache.findings().collect()}


def test_changes_deletions_and_work(spark, tmp_path):
    cache = FindingCache(spark, f"file://{tmp_path}/c", buckets=4)
    seen = []

    def counted(files):
        seen.append({r.path for r in files.collect()})
        return scan(files)

    files = {f"f{k}": f"needle {k}" if k % 2 else "hay" for k in range(8)}
    first = {(r.file_path, r.fingerprint) for r in cached_scan(cache, frame(spark, files), counted, "own").collect()}
    assert len(first) == 4
    again = {(r.file_path, r.fingerprint) for r in cached_scan(cache, frame(spark, files), counted, "own").collect()}
    assert again == first and seen[1] == set()
    files |= {"f0": "needle now", "f1": "hay now", "new": "needle new"}
    del files["f3"]
    cached_scan(cache, frame(spark, files), counted, "own")
    assert seen[2] == {"f0", "f1", "new"}
    assert state(cache) == ({(p, "own") for p in files}, {(p, c) for p, c in files.items() if "needle" in c})
    # another module's entries of the same paths are its own
    other = frame(spark, {"f0": "x"})
    cache.upsert(other.select("path", F.lit("else").alias("module"), "sha256"), scan(other.limit(0)))
    assert ("f0", "else") in state(cache)[0] and ("f0", "needle now") in state(cache)[1]
    before = state(cache)
    cache.vacuum()
    assert state(FindingCache(spark, cache.folder)) == before and FindingCache(spark, cache.folder).buckets == 4


def test_a_retried_batch_counts_once(spark, tmp_path):
    cache = FindingCache(spark, f"file://{tmp_path}/c", buckets=2)
    rows = frame(spark, {"a": "needle"})
    keys = rows.select("path", F.lit("own").alias("module"), "sha256")
    assert cache.upsert(keys, scan(rows), batch=("s", 0)) and not cache.upsert(keys, scan(rows), batch=("s", 0))
    assert cache.upsert(keys, scan(rows), batch=("t", 0)) and len(cache.findings().collect()) == 1
    version = cache.manifest()["version"]

    # a writer that dies before its manifest leaves no trace, and one that comes late is told
    publish = cache._publish
    cache._publish = lambda m: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        cache.upsert(keys, scan(rows), gone=rows.select("path"), batch=("s", 1))
    assert cache.manifest()["version"] == version and len(cache.findings().collect()) == 1
    cache._publish = publish
    with pytest.raises(Conflict):
        cache._publish(cache.manifest())
    assert cache.upsert(keys, scan(rows), batch=("s", 1))


def test_streams_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("needle a")
    cache, mark = FindingCache(spark, f"file://{tmp_path}/c"), str(tmp_path / "mark")
    run = lambda: scan_stream(cache, incremental.stream_files(spark, str(src)), scan, "own", mark)
    run()
    (src / "b.txt").write_text("hay")
    run()
    (src / "a.txt").write_text("needle changed")
    os.utime(src / "a.txt", (2_000_000_000, 2_000_000_000))
    run()
    run()
    entries, found = state(cache)
    assert {os.path.basename(p) for p, _ in entries} == {"a.txt", "b.txt"}
    assert {e for _, e in found} <= {"needle a", "needle changed"} and len(found) == 1
