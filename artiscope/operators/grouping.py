"""Findings to issues: dedup, grouping, counts, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from artiscope.functions import constants as C
from artiscope.functions.findings import is_inventory, severity_rank

ORDER = ("file_path", "rule_id", "line_number", "column_number", "offset", "evidence")


def first_by_fingerprint(findings: DataFrame, order=ORDER) -> DataFrame:
    """One finding for each module and fingerprint: the first by ``order``.

    The row travels as one aggregated struct, so copies fold before the shuffle.
    """
    cols = findings.columns
    row = F.struct(*[F.col(c) for c in cols])
    key = F.struct(*[F.col(c) for c in order])
    return findings.groupBy("module", "fingerprint").agg(F.min_by(row, key).alias("__row")).select("__row.*")


def issue_title(title: Column) -> Column:
    return F.lower(F.trim(title))


def location() -> Column:
    """Path with an offset, or a line and column."""
    line = F.concat(F.lit(" (line "), F.col("line_number"), F.coalesce(F.concat(F.lit(", column "), F.col("column_number")), F.lit("")), F.lit(")"))
    return F.concat("file_path", F.coalesce(F.concat(F.lit(" (offset 0x"), F.hex("offset"), F.lit(")")), F.when(F.col("line_number") > 0, line), F.lit("")))


def occurrences(findings: DataFrame, order=ORDER) -> DataFrame:
    """Distinct occurrences with their issue key; identity is rule, folded path, place and evidence."""
    rows = findings.withColumn("issue_title", issue_title(F.col("title"))).withColumn("location", location())
    place = ["module", "rule_id", "issue_title", "severity", F.lower("file_path").alias("__path"), "line_number", "column_number", "offset", F.sha2("evidence", 256).alias("__digest")]
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*place).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


#: Occurrences that an issue carries along, and parts that a hot issue's occurrences are dealt out to.
KEEP, SALTS = 50, 64
ISSUE = ("module", "rule_id", "issue_title", "severity", "severity_rank")


def group_issues(findings: DataFrame, order=ORDER, keep: int = KEEP, any_of: dict[str, Column] | None = None) -> DataFrame:
    """One row for each issue: header fields of its first occurrence, affected_count, and its first ``keep`` occurrences in order.

    An issue can have as many occurrences as the corpus: they are dealt out by a salt, each part keeps its first
    ``keep`` and counts the rest, and an issue is put together from ``SALTS`` such parts. locations_sum is a checksum
    over all locations in any order. any_of: more columns, true where any occurrence at all meets the condition.
    """
    any_of = any_of or {}
    occ = occurrences(findings, order).withColumn("__salt", F.pmod(F.xxhash64("location", "evidence"), F.lit(SALTS)))
    digest = F.conv(F.left(F.md5("location"), F.lit(8)), 16, 10).cast("long")
    part = W.partitionBy(*ISSUE, "__salt")
    dealt = occ.select(
        "*",
        F.row_number().over(part.orderBy(*order)).alias("__n"),
        F.count("*").over(part).alias("__all"),
        F.sum(digest).over(part).alias("__sum"),
        *[F.coalesce(F.bool_or(c).over(part), F.lit(False)).alias(name) for name, c in any_of.items()],
    ).where(F.col("__n") <= keep)
    item = F.struct(*[F.col(c) for c in order], "location", "confidence", "poc", "extra", "fingerprint")
    once = lambda c: F.sum(F.when(F.col("__n") == 1, F.col(c)))
    issues = dealt.groupBy(*ISSUE).agg(
        once("__all").alias("affected_count"),
        once("__sum").alias("locations_sum"),
        F.min_by(F.struct("title", "description", "remediation", "tags"), F.struct(*order)).alias("first"),
        F.slice(F.sort_array(F.collect_list(item)), 1, keep).alias("occurrences"),
        *[F.bool_or(name).alias(name) for name in any_of],
    )
    one = F.col("occurrences")[0]
    return issues.select(
        "module", "rule_id", "issue_title", "first.*", "severity", "severity_rank", "affected_count",
        *[one[c].alias(c) for c in ("file_path", "evidence", "confidence", "poc", "extra")],
        "occurrences", F.transform("occurrences", lambda o: o["location"]).alias("locations"), "locations_sum", *any_of,
    )


def issue_counts(findings: DataFrame) -> DataFrame:
    """Issues with their number of occurrences and their first path, without the lists."""
    return occurrences(findings).groupBy("module", "rule_id", "issue_title", "severity", "severity_rank").agg(F.count("*").alias("affected_count"), F.min("file_path").alias("first_path"))


def split_inventory(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that count, and inventory."""
    return findings.where(~is_inventory()), findings.where(is_inventory())


def severity_summary(issues: DataFrame) -> DataFrame:
    """Issues and instances by severity; severities without any have a row too."""
    spark = issues.sparkSession
    dim = spark.createDataFrame([(k, v) for k, v in C.SEVERITY_RANK.items()], "severity string, severity_rank int")
    counts = issues.groupBy("severity").agg(F.count("*").alias("n"), F.sum("affected_count").alias("k"))
    return dim.join(counts, "severity", "left").select("severity", "severity_rank", F.coalesce("n", F.lit(0)).cast("long").alias("unique_issues"), F.coalesce("k", F.lit(0)).cast("long").alias("instances"))


def risk_distribution(issues: DataFrame) -> DataFrame:
    """Share of each severity but Info, in percent of the issues."""
    counts = issues.where("severity <> 'Info'").groupBy("severity").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("severity", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


def areas(issues: DataFrame) -> DataFrame:
    """Modules by number of issues that aren't Info."""
    return issues.where("severity <> 'Info'").groupBy("module").agg(F.count("*").alias("n"))


def highest_severity(issues: DataFrame) -> DataFrame:
    return issues.agg(F.max_by("severity", "severity_rank").alias("highest"))


def ranked(issues: DataFrame, prefix: str = "W") -> DataFrame:
    """Issues numbered for the report: by severity, then occurrences, then name. There are as many as kinds of issues, not as findings."""
    order = W.orderBy(F.desc("severity_rank"), F.desc("affected_count"), "module", "rule_id", "issue_title")
    return issues.withColumn("rank", F.row_number().over(order)).withColumn("report_id", F.format_string(prefix + "-%03d", "rank"))


def top_priority(issues: DataFrame, limit: int = 5) -> DataFrame:
    """The first issues of Critical or High; if there is none, of Medium."""
    rows = ranked(issues)
    urgent = rows.where("severity_rank >= 3")
    any_urgent = urgent.agg((F.count("*") > 0).alias("any"))
    level = rows.join(F.broadcast(any_urgent)).where("(any and severity_rank >= 3) or (not any and severity = 'Medium')").drop("any")
    return level.orderBy("rank").limit(limit)


def files_scanned(findings: DataFrame, extracted_column: str = "extra") -> DataFrame:
    """Distinct paths, those from inside archives, and the rest."""
    inside = F.get_json_object(extracted_column, "$.extracted_from").isNotNull()
    path = F.lower("file_path")
    return findings.agg(F.countDistinct(path).alias("files"), F.countDistinct(F.when(inside, path)).alias("extracted")).withColumn("input", F.col("files") - F.col("extracted"))


def ui_filter(findings: DataFrame, severity: str | None = None, confidence: str | None = None, text: str | None = None, keep: int = KEEP) -> DataFrame:
    """Issues by severity, by confidence of any occurrence, and by text in title, location, rule or evidence of any."""
    low = (text or "").lower()
    inside = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(low)
    shown = inside(F.col("title")) | inside(F.col("rule_id")) | inside(F.col("location")) | inside(F.col("evidence"))
    rows = findings.where(F.col("severity") == severity) if severity else findings
    issues = group_issues(rows, keep=keep, any_of={"__sure": F.col("confidence") == confidence if confidence else F.lit(True), "__shown": shown})
    return issues.where("__sure and __shown").drop("__sure", "__shown")


# --- fixed values: tags to weakness and technique labels ---
CWE_BY_TAG = {
    "credential": "CWE-798 Hard-coded Credentials",
    "jwt": "CWE-522 Insufficiently Protected Credentials",
    "database": "CWE-200 Exposure of Sensitive Information",
    "weak-crypto": "CWE-327 Broken/Risky Cryptographic Algorithm",
    "permissions": "CWE-732 Incorrect Permission Assignment",
    "signature": "CWE-347 Improper Verification of Cryptographic Signature",
    "debug-setting": "CWE-489 Active Debug Code",
    "tls-setting": "CWE-295 Improper Certificate Validation",
    "tls": "CWE-295 Improper Certificate Validation",
    "outdated-component": "CWE-1104 Use of Unmaintained Third-Party Components",
    "webpreferences": "CWE-1188 Insecure Default Initialization",
    "navigation": "CWE-601 Open Redirect / Untrusted Navigation",
    "transport": "CWE-319 Cleartext Transmission of Sensitive Information",
    "environment": "CWE-489 Active Debug Code",
}
MITRE_BY_TAG = {
    "credential": "T1552 Unsecured Credentials",
    "jwt": "T1552 Unsecured Credentials",
    "database": "T1005 Data from Local System",
    "dll": "T1574 Hijack Execution Flow",
    "signature": "T1553 Subvert Trust Controls",
    "auto-update": "T1195 Supply Chain Compromise",
    "anti-debug": "T1497 Virtualization/Sandbox Evasion",
    "registry-key": "T1112 Modify Registry",
    "named-pipe": "T1559 Inter-Process Communication",
    "fuse": "T1218 System Binary Proxy Execution",
}


def labels(tags: Column, by_tag: dict[str, str]) -> Column:
    """Sorted distinct labels of tags."""
    table = F.create_map(*[F.lit(x) for pair in by_tag.items() for x in pair])
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: table[t]), lambda x: x.isNotNull())))


# --- fixed values: module labels of reports ---
MODULE_LABELS = {
    "secrets": "Secrets & Configuration",
    "dll_hijack": "DLL Hijacking",
    "signature": "Code Signing & Integrity",
    "re_exposure": "Binary Hardening & RE Exposure",
    "linux": "Linux Thick Client",
    "macos": "macOS Thick Client",
    "reputation": "Reputation (VirusTotal)",
}


def module_label(module: Column) -> Column:
    out = F.initcap(F.replace(module, F.lit("_"), F.lit(" ")))
    for name, label in MODULE_LABELS.items():
        out = F.when(module == name, F.lit(label)).otherwise(out)
    return out


def report_filter(issues: DataFrame, severity: str | None = None, module: str | None = None, text: str | None = None) -> DataFrame:
    """Issues of a report by severity, module and a part of their text."""
    out = issues.where(F.col("severity") == severity) if severity else issues
    out = out.where(F.col("module") == module) if module else out
    blob = F.lower(F.concat_ws(" ", "rule_id", "title", "severity", "module", "evidence", F.array_join("locations", " ")))
    return out.where(blob.contains(text.lower())) if text else out


def roll_up(findings: DataFrame, rule: str, keep: int = 20) -> DataFrame:
    """One finding for each module instead of one for each file: its number of files and the first ``keep`` of them."""
    rows = findings.where(F.col("rule_id") == rule).select("module", "rule_id", "severity", "file_path").distinct()
    part = W.partitionBy("module", F.pmod(F.xxhash64("file_path"), F.lit(SALTS)))
    dealt = rows.select("*", F.row_number().over(part.orderBy("file_path")).alias("__n"), F.count("*").over(part).alias("__all")).where(F.col("__n") <= keep)
    return dealt.groupBy("module", "rule_id", "severity").agg(F.sum(F.when(F.col("__n") == 1, F.col("__all"))).alias("n_files"), F.slice(F.sort_array(F.collect_list("file_path")), 1, keep).alias("files"))


def hardening_summary(findings: DataFrame) -> DataFrame:
    """The controls of each application as one text, without repeats."""
    rows = findings.where("rule_id = 'electron-hardening-summary'")
    return rows.groupBy(F.regexp_replace("file_path", r"[/\\][^/\\]*$", "").alias("app")).agg(F.array_join(F.sort_array(F.collect_set("evidence")), "; ").alias("controls"))
