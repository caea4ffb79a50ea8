"""Indicator findings of text frames (file_path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artiscope.functions import text as X
from artiscope.functions.findings import findings


HIT = "array<struct<rule_id:string,title:string,severity:string,evidence:string,line_number:int,column_number:int,tags:array<string>,confidence:string,poc:string>>"


def hit(rule_id, title, severity, evidence, tags=(), confidence="Medium", line_number=None, column_number=None, poc=None) -> Column:
    """One match as a struct; what isn't a column is a literal."""
    values = {"rule_id": rule_id, "title": title, "severity": severity, "evidence": evidence, "line_number": line_number, "column_number": column_number, "tags": tags, "confidence": confidence, "poc": poc}
    made = lambda v: v if isinstance(v, Column) else F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
    return F.struct(*[made(v).alias(k) for k, v in values.items()])


def gated(text: Column, gate: str, hits: Column) -> Column:
    """Matches of a text that passes a cheap test; others never meet the dear expressions."""
    return F.when(text.rlike(gate), hits.cast(HIT)).otherwise(F.array().cast(HIT))


def text_findings(texts: DataFrame, hits: list[Column], module: str = "secrets") -> DataFrame:
    """Findings of all ``hits`` from one pass over texts (file_path, text)."""
    # outer: for inner generators the optimizer adds a filter on the size of their input, which would extract everything twice
    rows = texts.select("file_path", F.inline_outer(F.flatten(F.array(*hits)))).where("rule_id is not null")
    return findings(rows, module=module, file_path=F.col("file_path"), **{c: F.col(c) for c in ("rule_id", "title", "severity", "evidence", "line_number", "column_number", "tags", "confidence", "poc")})


def address_hits(text: Column) -> Column:
    private = lambda v: X.is_private_ip(v)
    return gated(text, r"[0-9]\.[0-9]", F.transform(X.addresses(text), lambda v: hit(F.when(private(v), "private-ip").otherwise("hardcoded-ip"), F.when(private(v), "Private address").otherwise("Hard-coded address"), F.when(private(v), "Info").otherwise("Low"), v, ["network"])))


def email_hits(text: Column) -> Column:
    return gated(text, "@", F.transform(X.emails(text), lambda v: hit("embedded-email", "Embedded e-mail address", "Info", v, ["contact"], "High")))


def url_hits(text: Column) -> Column:
    internal = lambda v: X.is_internal_host(X.host_of(v))
    tag = lambda v: F.array(F.when(v.startswith("http://"), "transport").otherwise("network"))
    return gated(text, "https?://", F.transform(X.urls(text), lambda v: hit(F.when(internal(v), "internal-host").otherwise("extracted-urls"), F.when(internal(v), "Internal host").otherwise("URL"), F.when(internal(v), "Low").otherwise("Info"), v, tag(v))))


def api_hits(text: Column) -> Column:
    return gated(text, "/(?:api|v[0-9]+|rest)/", F.transform(X.api_endpoints(text), lambda v: hit("api-endpoint", "API endpoint", "Info", v, ["network"])))


def entropy_hits(text: Column) -> Column:
    return gated(text, r"[A-Za-z0-9+/_\-=]{20}", F.transform(X.high_entropy_tokens(text), lambda v: hit("high-entropy-string", "High-entropy string", "Medium", v, ["credential"], "Low")))


def address_findings(texts: DataFrame) -> DataFrame:
    return text_findings(texts, [address_hits(F.col("text"))])


def email_findings(texts: DataFrame) -> DataFrame:
    return text_findings(texts, [email_hits(F.col("text"))])


def url_findings(texts: DataFrame) -> DataFrame:
    return text_findings(texts, [url_hits(F.col("text"))])


def api_findings(texts: DataFrame) -> DataFrame:
    return text_findings(texts, [api_hits(F.col("text"))])


def entropy_findings(texts: DataFrame) -> DataFrame:
    return text_findings(texts, [entropy_hits(F.col("text"))])


def scan_text(texts: DataFrame, entropy: bool = True) -> DataFrame:
    """All indicator findings, from one pass."""
    text = F.col("text")
    hits = [address_hits(text), email_hits(text), url_hits(text), api_hits(text)]
    return text_findings(texts, [*hits, entropy_hits(text)] if entropy else hits)
