"""Queries with SQL against DuckDB on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from furrow.llm.queries import QUERIES, SQL
from furrow.sources.tables import TABLES
from tools.check_oracle import digest


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    want = con.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest(cols, want.fetchall())[0]


def test_all_eleven_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
