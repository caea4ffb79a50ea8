"""The findings schema: severities, identity, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artiscope.functions import constants as C

SCHEMA = (
    "module string, rule_id string, title string, severity string, file_path string, evidence string, description string, remediation string, poc string, "
    "line_number int, column_number int, offset bigint, tags array<string>, confidence string, extra string"
)
COLUMNS = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]


def severity(text: Column) -> Column:
    """A severity by its name in any case; what isn't one is Info."""
    name = F.initcap(F.trim(text))
    return F.when(name.isin(*C.SEVERITY_RANK), name).otherwise(F.lit("Info"))


def severity_rank(sev: Column) -> Column:
    out = F.lit(0)
    for name, rank in C.SEVERITY_RANK.items():
        out = F.when(sev == name, rank).otherwise(out)
    return out


def fingerprint() -> Column:
    """Identity of a finding; nulls count as the text None, title and tags don't count."""
    shown = ", ".join(f"coalesce(cast({c} as string), 'None')" for c in ("line_number", "column_number", "offset"))
    return F.expr(f"left(sha2(concat_ws('|', module, rule_id, file_path, {shown}, evidence), 256), 16)")


def is_inventory() -> Column:
    rule = F.col("rule_id")
    return rule.isin(*C.INVENTORY_RULES) | rule.startswith("extracted-") | ((rule == "manifest-privilege-settings") & (F.col("severity") == "Info"))


_TYPES = dict(p.strip().split(" ") for p in SCHEMA.split(","))
_SEVERITY = f"case when initcap(trim(severity)) in ({', '.join(map(repr, C.SEVERITY_RANK))}) then initcap(trim(severity)) else 'Info' end"
_RANK = "case severity " + " ".join(f"when {k!r} then {v}" for k, v in C.SEVERITY_RANK.items()) + " else 0 end"


def findings(df: DataFrame, **columns) -> DataFrame:
    """``df`` as findings: given columns (literals or columns), the rest null; with severity_rank and fingerprint."""
    cols = []
    for name in COLUMNS:
        value = columns.get(name)
        if value is None:
            col = F.expr(f"cast(null as {_TYPES[name]})")
        elif isinstance(value, Column):
            col = value.cast(_TYPES[name])
        else:
            col = F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)
        cols.append(col.alias(name))
    return df.select(*cols).withColumn("severity", F.expr(_SEVERITY)).withColumns({"severity_rank": F.expr(_RANK), "fingerprint": fingerprint()})
