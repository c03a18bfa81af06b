"""Plan regressions: the physical properties the engine is designed around."""

from conftest import SF001
from mixlens.operators import contribution as C
from mixlens.operators import regression as R
from mixlens.operators.features import SESSIONS_SPEC, features
from mixlens.plans.context import panel_drivers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    """The text ``df.explain("formatted")`` prints."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_scan_prunes_columns_and_pushes_the_training_cut(spark):
    text = _formatted(features(panel_drivers(spark, SF001), SESSIONS_SPEC))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text
    assert "LessThan(l_shipdate,2000-01-01T00:00)" in text


def test_driver_series_is_broadcast_and_windows_share_one_exchange(spark):
    plan = _plan(features(panel_drivers(spark, SF001), SESSIONS_SPEC))
    assert "BroadcastHashJoin" in plan
    # one exchange for the source aggregate, one for every series window
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_passes_over_the_bucketed_design_do_not_shuffle(spark):
    models, scaled = R.fit(panel_drivers(spark, SF001), SESSIONS_SPEC)
    for df in (C.contribution_daily(scaled, models, SESSIONS_SPEC),
               R.model_quality(scaled, models, SESSIONS_SPEC),
               R.actual_vs_model(scaled, models, SESSIONS_SPEC)):
        plan = _plan(df)
        assert "Exchange hashpartitioning" not in plan, plan


def test_gram_is_partially_aggregated(spark):
    g = R.gram(features(panel_drivers(spark, SF001), SESSIONS_SPEC), SESSIONS_SPEC)
    plan = _plan(g)
    assert plan.count("HashAggregate") >= 2 or "ObjectHashAggregate" in plan


def test_bounded_broadcast_falls_back_above_the_bound(spark):
    from mixlens.operators.joins import bounded_broadcast
    big = spark.range(0, 1000).withColumnRenamed("id", "k")
    small = spark.range(0, 50).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        under = big.join(bounded_broadcast(small, max_rows=100), "k")
        over = big.join(bounded_broadcast(small, max_rows=10), "k")
        assert "BroadcastHashJoin" in _plan(under)
        assert "BroadcastHashJoin" not in _plan(over)
        assert under.count() == over.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
