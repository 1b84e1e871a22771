"""Registered queries against the same SQL in DuckDB."""

import pytest

from phasefold import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, db, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_rows(spark, name):
    got = queries.queries()[name](spark, SF)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
