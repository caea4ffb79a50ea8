"""User detectors as a Python table function."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from artiscope.functions.findings import findings

HIT = "rule_id string, title string, severity string, evidence string, line_number int, tags array<string>, confidence string"
_FIELDS = tuple(p.strip().split(" ")[0] for p in HIT.split(","))


def detector(scan_file: Callable[[str, bytes], Iterable[dict]]):
    """A table function of (path, content) out of a detector; what it raises or returns amiss gives no rows. Detectors are trusted code."""

    @udtf(returnType=HIT)
    class Detector:
        def eval(self, path: str, content: bytes):
            try:
                found = list(scan_file(path, bytes(content or b"")))
            except Exception:
                return
            for hit in found:
                if isinstance(hit, dict) and hit.get("rule_id"):
                    yield tuple(hit.get(f) for f in _FIELDS)

    return Detector


def run(files: DataFrame, scan_file: Callable[[str, bytes], Iterable[dict]], module: str = "plugins") -> DataFrame:
    """Findings of one detector over files (path, content)."""
    call = detector(scan_file)
    rows = files.select("path", "content").lateralJoin(call(F.col("path").outer(), F.col("content").outer()))
    c = F.col
    return findings(rows, module=module, rule_id=c("rule_id"), title=F.coalesce("title", "rule_id"), severity=F.coalesce("severity", F.lit("Info")), file_path=c("path"), evidence=F.coalesce("evidence", F.lit("")), line_number=c("line_number"), tags=c("tags"), confidence=F.coalesce("confidence", F.lit("Medium")))
