"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import docloom.plans as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    frame = plans.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in frame.collect()), key=repr)
    if name not in plans.ORACLES:
        assert rows
        return
    cursor = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(([plain(r[k]) for k in at] for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
