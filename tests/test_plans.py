"""Plan checks: pruning reaches the scans, fixed-size sides are broadcast."""


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_reads_only_needed_columns(spark, sf):
    from furrow.sources import fixtures as fx
    from furrow.operators import clean
    df = clean.yield_clean(fx.yield_raw(spark, sf)).groupBy("Crop").count()
    plan = _plan(df)
    assert "l_tax" not in plan and "l_returnflag" not in plan and "o_totalprice" not in plan
    assert "ReadSchema" in plan


def test_profile_dimension_is_broadcast(spark, sf):
    from furrow.sources import fixtures as fx
    plan = _plan(fx.obs(spark, sf))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
