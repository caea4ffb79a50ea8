"""Declarative regex rules: packs from YAML, and their scan over lines of text."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from artiscope.functions.findings import findings
from artiscope.operators.indicators import HIT, hit, text_findings

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Rule:
    """A regex and what its matches mean. ``group`` is the part of the match that is evidence."""

    id: str
    description: str
    regex: str
    severity: str = "Medium"
    confidence: str = "Medium"
    group: int = 0
    tags: tuple = field(default=())


#: Our own pack; patterns are plain enough for RE2 as well as for Java.
DEFAULT_RULES = (
    Rule("aws-access-key-id", "Cloud access key id", r"(?:AKIA|ASIA)[0-9A-Z]{16}", "High", "High", 0, ("credential",)),
    Rule("generic-password-assignment", "Password in an assignment", r"(?i)(?:password|passwd|pwd)[\"']?\s*[=:]\s*[\"']?([^\s\"'`,;!]{2}[^\s\"'`,;]{4,})", "High", "Medium", 1, ("credential",)),
    Rule("token-assignment", "Token in an assignment", r"(?i)(?:token|api_key|apikey|secret)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_\-]{16,})", "High", "Medium", 1, ("credential",)),
    Rule("npm-access-token", "Package registry token", r"npm_[A-Za-z0-9]{36}", "High", "High", 0, ("credential",)),
    Rule("stripe-key", "Payment service key", r"[sr]k_(?:live|test)_[0-9A-Za-z]{20,}", "Critical", "High", 0, ("credential",)),
    Rule("jwt-token", "Signed web token", r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", "Medium", "High", 0, ("jwt", "credential")),
    Rule("db-connection-string", "Database URL with a password", r"(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:/@]+:[^\s@]+@[^\s\"'<>]+", "High", "High", 0, ("database", "credential")),
    Rule("internal-url", "URL of an internal host", r"(?i)https?://(?:[a-z0-9\-]+\.)*(?:dev|development|stage|staging|test|testing|internal|corp|local|sandbox|qa|uat)\.[a-z0-9\-]+\.[a-z0-9.\-]+[^\s\"'<>]*", "Low", "Medium", 0, ("environment",)),
    Rule("non-production-api-endpoint", "Endpoint of a non-production stage", r"(?i)https?://[^\s\"'<>/]+/(?:int|dev|test|qa|uat|stage|staging|sandbox)/[^\s\"'<>]*", "Low", "Medium", 0, ("environment",)),
    Rule("license-notice", "License notice", r"(?i)licensed under the [^\n]{3,80}", "Info", "High", 0, ("license",)),
)
#: Rules that need more than one line: a key block with a body.
PEM_RE = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s\\rn]{64,}-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
CERT_RE = r"-----BEGIN CERTIFICATE-----[A-Za-z0-9+/=\s]*-----END CERTIFICATE-----"


def load_rules(folder: str | Path) -> list[Rule]:
    """Packs of a folder: ``*.yml``, then ``*.yaml``, each by name; of a repeated id the first counts; a bad regex is left out."""
    import yaml

    out: dict[str, Rule] = {}
    paths = [*sorted(Path(folder).glob("*.yml")), *sorted(Path(folder).glob("*.yaml"))]
    for path in paths:
        for r in (yaml.safe_load(path.read_text(encoding="utf-8")) or {}).get("rules", ()):
            try:
                re.compile(r["regex"])
            except re.error as e:
                log.warning("rule %s of %s: %s", r.get("id"), path.name, e)
                continue
            if r["id"] in out:
                log.warning("rule %s of %s repeats an id", r["id"], path.name)
                continue
            out[r["id"]] = Rule(r["id"], r.get("description", ""), r["regex"], r.get("severity", "Medium"), r.get("confidence", "Medium"), int(r.get("group", 0)), tuple(r.get("tags") or ()))
    if not out:
        raise ValueError(f"no rules in {folder}")
    return list(out.values())


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    rows = [(r.id, r.description, r.regex, r.severity, r.confidence, r.group, list(r.tags)) for r in rules]
    return spark.createDataFrame(rows, "id string, description string, regex string, severity string, confidence string, group int, tags array<string>")


def line_hits(text: Column, path: Column | None = None, rules=DEFAULT_RULES) -> Column:
    """Matches of single-line rules in a text. A value that repeats on a line is one match at its first column.

    Only texts with a match of some rule are split, and only lines with one are looked at rule by rule.
    """
    path = F.col("file_path") if path is None else path
    any_of = lambda c: reduce(lambda a, b: a | b, [c.rlike(r.regex) for r in rules])
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.struct((i + 1).alias("n"), line.alias("line")))

    def of_line(x: Column) -> Column:
        def of_rule(r: Rule) -> Column:
            values = F.array_distinct(F.regexp_extract_all(x["line"], F.lit(r.regex), F.lit(r.group)))
            poc = lambda v: F.concat(F.lit("Select-String -SimpleMatch -Path '"), path, F.lit("' -Pattern '"), v, F.lit("'"))
            return F.transform(values, lambda v: hit(r.id, r.description, r.severity, v, F.array(*map(F.lit, r.tags)).cast("array<string>"), r.confidence, x["n"], F.instr(x["line"], v), poc(v)))

        return F.flatten(F.array(*[of_rule(r).cast(HIT) for r in rules]))

    found = F.flatten(F.transform(F.filter(numbered, lambda x: any_of(x["line"])), of_line))
    return F.when(any_of(text), found).otherwise(F.array().cast(HIT))


def scan(texts: DataFrame, rules=DEFAULT_RULES, path: str = "file_path", text: str = "text", module: str = "secrets") -> DataFrame:
    """Findings of single-line rules."""
    rows = texts.select(F.col(path).alias("file_path"), F.col(text).alias("text"))
    return text_findings(rows, [line_hits(F.col("text"), rules=rules)], module)


def scan_keys(texts: DataFrame, path: str = "file_path", text: str = "text", module: str = "secrets") -> DataFrame:
    """Private key blocks with a body; headers alone are no key."""
    hits = texts.where(F.col(text).contains("PRIVATE KEY-----")).select(F.col(path).alias("file_path"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PEM_RE), F.lit(0)))).alias("block"), F.col(text).alias("t"))
    line = F.size(F.split(F.substring("t", F.lit(1), F.instr("t", F.col("block"))), "\n"))
    return findings(hits, module=module, rule_id="pem-private-key", title="Private key block", severity="Critical", file_path=F.col("file_path"), evidence=F.left(F.sha2("block", 256), F.lit(32)), line_number=line, tags=["credential"], confidence="High")


def without_certificates(text):
    """Text in which certificate bodies can't look like secrets."""
    return F.regexp_replace(text, CERT_RE, "")
