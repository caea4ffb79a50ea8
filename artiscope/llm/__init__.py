"""Operators of training-data pipelines. Nothing outside this folder imports it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("block_naming", "bwt_dedup", "collocations", "decontaminate", "jaccard_groups", "line_crf", "packing", "pii", "toxicity", "token_count", "quality_cascade", "url_filters", "whitening")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), "ORACLE_SQL", {}).items()}
