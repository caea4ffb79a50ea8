"""Sinks: JSON, HTML, a table by application, and a line of summary."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artiscope.functions.paths import application_name
from artiscope.operators import grouping

#: Issues that an HTML page shows; the page says how many there are in all.
PAGE_ISSUES, PAGE_OCCURRENCES = 1000, 50


def write_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, one file a partition."""
    findings.write.mode("overwrite").json(path)


def write_by_application(findings: DataFrame, target: str, path: str) -> None:
    """Findings below a folder for the application."""
    findings.withColumn("app", application_name(F.lit(target))).write.mode("append").partitionBy("app").parquet(path)


def document(findings: DataFrame, inventory: DataFrame, keep: int = PAGE_OCCURRENCES) -> DataFrame:
    """One JSON document (column json) of summary, ranked issues with up to ``keep`` occurrences each, and inventory counts."""
    issues = grouping.group_issues(findings, keep=keep)
    summary = grouping.severity_summary(grouping.issue_counts(findings))
    rows = grouping.ranked(issues)
    head = summary.agg(F.sort_array(F.collect_list(F.struct("severity_rank", "severity", "unique_issues", "instances")), asc=False).alias("summary"))
    body = rows.agg(F.sort_array(F.collect_list(F.struct("rank", "report_id", "rule_id", "title", "severity", "affected_count", "file_path", "evidence", "confidence", "poc", "occurrences"))).alias("findings"))
    rest = inventory.groupBy("rule_id").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("rule_id", "n"))).alias("inventory"))
    return head.join(F.broadcast(body)).join(F.broadcast(rest)).select(F.to_json(F.struct("summary", "findings", "inventory")).alias("json"))


def summary_line(summary: DataFrame) -> str:
    rows = {r["severity"]: r for r in summary.collect()}
    return ", ".join(f"{k}: {rows[k]['unique_issues']} ({rows[k]['instances']})" for k in ("Critical", "High", "Medium", "Low", "Info") if k in rows)


def html_page(findings: DataFrame, title: str = "Scan report") -> str:
    """A self-contained page of the ranked issues; every value is escaped."""
    issues = grouping.ranked(grouping.group_issues(findings, keep=PAGE_OCCURRENCES))
    total = issues.count()
    rows = issues.orderBy("rank").limit(PAGE_ISSUES).select("report_id", "severity", "title", "rule_id", "affected_count", "evidence", "locations").collect()
    e = lambda x: html.escape(str(x if x is not None else ""))
    body = "".join(f"<tr><td>{e(r.report_id)}</td><td>{e(r.severity)}</td><td>{e(r.title)}<br><code>{e(r.rule_id)}</code></td><td>{r.affected_count}</td><td><code>{e(r.evidence)}</code><br>{'<br>'.join(map(e, r.locations))}</td></tr>" for r in rows)
    line = e(summary_line(grouping.severity_summary(grouping.issue_counts(findings))))
    return f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1><p>{line}. {len(rows)} of {total} issues.</p><table border=1><tr><th>No.<th>Severity<th>Issue<th>Occurrences<th>Evidence</tr>{body}</table>"
