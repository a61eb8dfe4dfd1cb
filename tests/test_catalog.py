"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from surmise.plans import catalog, views


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    table = con.sql(catalog.oracle_sql()[name]).to_arrow_table()
    assert sorted(table.column_names) == sorted(df.columns)
    expected = sorted(tuple(r[c] for c in df.columns) for r in table.to_pylist())
    assert sorted(map(tuple, df.collect())) == expected


def test_driver_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["target", "condition"]


def test_follows_links_days(spark, sf_dir):
    """All purchases in one order, as FIXTURES.md section 3 defines it."""
    con = duckdb.connect()
    expected = con.sql(f"SELECT DISTINCT a::BIGINT x, b::BIGINT y FROM (SELECT user_id a, LEAD(user_id) OVER (ORDER BY ts, event_id) b FROM read_parquet('{sf_dir}/events.parquet') WHERE event_type = 'purchase') WHERE b IS NOT NULL").fetchall()
    assert sorted(map(tuple, views.follows(spark, sf_dir).collect())) == sorted(expected) and len(expected) == 138
