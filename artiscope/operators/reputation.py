"""Verdicts of binaries by hash, from a supplied table; nothing is looked up over a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artiscope.functions.findings import findings


def severity_of(malicious: Column, suspicious: Column, engines: Column) -> Column:
    """Critical from five engines or 15 % of them, High from one; Medium if only suspicious; else null."""
    ratio = malicious / F.greatest(engines, F.lit(1))
    return F.when((malicious >= 5) | ((malicious > 0) & (ratio >= 0.15)), "Critical").when(malicious >= 1, "High").when(suspicious >= 1, "Medium")


def vendors_text(vendors: Column, limit: int = 10) -> Column:
    more = F.size(vendors) - limit
    return F.concat(F.array_join(F.slice(vendors, 1, limit), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def reputation_findings(binaries: DataFrame, verdicts: DataFrame, max_lookups: int | None = 15, include_clean: bool = False) -> DataFrame:
    """binaries: path, sha256, seq. verdicts: sha256, malicious, suspicious, engines, vendors. The first ``max_lookups`` by seq are looked up."""
    work = binaries
    if max_lookups is not None:
        work = work.orderBy("seq", "path").limit(max_lookups)
    rows = work.join(verdicts, "sha256", "left").withColumn("sev", severity_of(F.col("malicious"), F.col("suspicious"), F.col("engines")))
    rule = F.when(F.col("engines").isNull(), "vt-unknown").when(F.col("sev").isNull(), "vt-clean").otherwise("vt-flagged")
    rows = rows.withColumn("rule", rule)
    if not include_clean:
        rows = rows.where("rule = 'vt-flagged'")
    evidence = F.when(F.col("rule") == "vt-unknown", F.lit("not known")).otherwise(F.concat(F.col("malicious").cast("string"), F.lit("/"), F.col("engines").cast("string"), F.lit(": "), vendors_text(F.coalesce("vendors", F.array().cast("array<string>")))))
    return findings(rows, module="reputation", rule_id=F.col("rule"), title=F.concat(F.lit("Reputation: "), F.col("rule")), severity=F.coalesce("sev", F.lit("Info")), file_path=F.col("path"), evidence=evidence, tags=["reputation"], confidence="High")
