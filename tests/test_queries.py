"""Every query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from txlog.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{SF}/events.parquet'")
    want = db.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1000


def test_every_query_has_a_callable(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
