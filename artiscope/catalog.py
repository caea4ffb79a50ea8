"""Queries of this package by name, and their SQL for other engines."""

from __future__ import annotations

from artiscope.plans import queries as _q
from artiscope.plans.session import workers_import


def with_workers(f):
    """``f`` with Python workers that can import this package."""

    def run(spark, sf_dir):
        workers_import(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: with_workers(f) for k, f in _q.QUERIES.items()}


def oracle_sql() -> dict:
    return dict(_q.SQL)
