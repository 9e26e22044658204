"""Every registered query against its oracle SQL on the smallest shared tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no shared tables here")

from tracemill.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return db


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return float(value) if hasattr(value, "as_tuple") else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    df = registry.queries()[name](spark, DATA)
    if name not in registry.oracle_sql():  # beyond SQL; tested on fixtures
        assert df.count() > 0
        return
    want = oracle.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
