"""Every query of the catalog against its SQL, on the smallest tables."""

import duckdb
import pytest

from motecraft.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows or name.startswith("q_recovery_anti")
    if name in catalog.ORACLES:
        want = db.sql(catalog.ORACLES[name])
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        key = lambda r: repr(tuple(r))
        got = sorted([tuple(r[c] for c in columns) for r in rows], key=key)
        assert got == sorted([tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall()], key=key)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
