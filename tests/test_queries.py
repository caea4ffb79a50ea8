"""Every query of the catalog with its SQL, side by side on the small tables."""

import duckdb
import pytest

from artiscope import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else None if x != x else x for x in r)) for r in frame)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = rows([tuple(r) for r in df.select(*cols).collect()])
    rel = db.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert got == rows(db.sql("select " + ", ".join(f'"{c}"' for c in cols) + " from rel").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
