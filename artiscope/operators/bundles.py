"""Secrets that stand together, and what tokens say: bundles by file and distance, claims as columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from artiscope.functions.findings import findings

#: Lines between two secrets of one bundle, at most.
GAP = 5
#: A signed token: header and payload are JSON objects, so both begin alike; the signature may be missing.
TOKEN_RE = r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*"


def bundles(found: DataFrame, gap: int = GAP) -> DataFrame:
    """file_path, first_line, last_line, n_secrets, rules and severity_rank of every run of two different secrets or more.

    found: findings with lines. A secret belongs to the run before it if no more than ``gap`` lines lie between their lines'
    numbers. Repeats of one text at one place count once. A window holds one file's findings.
    """
    rows = found.where("line_number is not null").select("file_path", "line_number", "column_number", "rule_id", "evidence", "severity_rank").distinct()
    order = W.partitionBy("file_path").orderBy("line_number", "column_number", "rule_id", "evidence")
    apart = F.coalesce(F.col("line_number") - F.lag("line_number").over(order) > gap, F.lit(True))
    runs = rows.withColumn("starts", apart.cast("int")).withColumn("run", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = runs.groupBy("file_path", "run").agg(
        F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line"),
        F.countDistinct("evidence").alias("n_secrets"),
        F.sort_array(F.collect_set("rule_id")).alias("rules"),
        F.max("severity_rank").alias("severity_rank"),
    )
    return whole.where("n_secrets >= 2").drop("run")


def bundle_findings(found: DataFrame, gap: int = GAP) -> DataFrame:
    """Bundles as findings of the first secret's line, as grave as the gravest of them."""
    rows = bundles(found, gap)
    severity = F.expr("case severity_rank when 4 then 'Critical' when 3 then 'High' when 2 then 'Medium' when 1 then 'Low' else 'Info' end")
    shown = F.concat(F.col("n_secrets").cast("string"), F.lit(" secrets: "), F.array_join("rules", ", "))
    extra = F.to_json(F.struct("first_line", "last_line", "n_secrets", "rules"))
    return findings(rows, module="secrets", rule_id="secret-bundle", title="Secrets that belong together", severity=severity, file_path=F.col("file_path"), evidence=shown, line_number=F.col("first_line"), tags=["credential", "bundle"], confidence="Medium", extra=extra)


def _part(part: Column) -> Column:
    """The text of a part that is base64 for URLs, without padding; null if it isn't."""
    plain = F.translate(part, "-_", "+/")
    padded = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, "=")
    return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def tokens(texts: DataFrame) -> DataFrame:
    """file_path, token, alg, iss, sub, aud, exp of the signed tokens in texts (file_path, text): claims as columns, null where a token doesn't say."""
    rows = texts.where(F.col("text").contains("eyJ")).select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN_RE), F.lit(0)))).alias("token"))
    parts = F.split("token", r"\.")
    read = rows.withColumn("head", _part(parts[0])).withColumn("body", _part(parts[1]))
    claims = [F.get_json_object("body", f"$.{k}").alias(k) for k in ("iss", "sub", "aud")]
    out = read.select("file_path", "token", F.get_json_object("head", "$.alg").alias("alg"), *claims, F.get_json_object("body", "$.exp").try_cast("bigint").alias("exp"))
    return out.where("alg is not null")


def token_findings(texts: DataFrame, as_of: datetime) -> DataFrame:
    """Signed tokens: High without a signature's algorithm, Low once expired, Medium otherwise."""
    rows = tokens(texts)
    expired = F.col("exp") <= F.lit(int(as_of.timestamp()))
    severity = F.when(F.lower("alg") == "none", "High").when(expired, "Low").otherwise("Medium")
    extra = F.to_json(F.struct("alg", "iss", "sub", "aud", "exp"))
    return findings(rows, module="secrets", rule_id="decoded-token", title="Signed token", severity=severity, file_path=F.col("file_path"), evidence=F.col("token"), tags=["credential", "token"], confidence="High", extra=extra)
