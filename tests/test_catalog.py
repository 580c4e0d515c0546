"""Every registered query of the engine's own operators against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lattix.plans import catalog

DIR = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"  # the smallest tables have no supplier with a neighbour
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    checked = name in catalog.oracle_sql()
    df = catalog.queries()[name](spark, DIR if checked else MORE)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if not checked:
        assert got
        return
    ran = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in ran.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in ran.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
