import pytest
from pyspark.sql import functions as F

from conftest import SF001
from mixlens.operators import contribution as C
from mixlens.operators import regression as R
from mixlens.operators.features import SESSIONS_SPEC
from mixlens.plans.context import panel_drivers
from mixlens.sources.tables import DRIVER_GROUPS, variable_groupings


@pytest.fixture(scope="module")
def fitted(spark):
    return R.fit(panel_drivers(spark, SF001), SESSIONS_SPEC)


def _total(df):
    return sum((F.col(g) for g in DRIVER_GROUPS[1:]), F.col(DRIVER_GROUPS[0]))


def test_raw_groups_sum_to_fitted(spark, fitted):
    models, scaled = fitted
    raw = C.grouped_wide(scaled, models, SESSIONS_SPEC).select("product_id", "date", _total(None).alias("t"))
    avm = R.actual_vs_model(scaled, models, SESSIONS_SPEC)
    d = raw.join(avm, ["product_id", "date"]).select(F.max(F.abs(F.col("t") - F.col("fitted")))).first()[0]
    assert d < 1e-8


def test_dictionary_join_equals_static_grouping(spark, fitted):
    models, scaled = fitted
    long = C.group_terms(C.term_contributions(scaled, models, SESSIONS_SPEC), variable_groupings(spark))
    wide = C.grouped_wide(scaled, models, SESSIONS_SPEC)
    static = wide.unpivot(["product_id", "date"], list(DRIVER_GROUPS), "driver_group", "v")
    d = long.join(static, ["product_id", "date", "driver_group"], "full")
    assert d.filter(F.col("value").isNull() | F.col("v").isNull()).count() == 0
    assert d.select(F.max(F.abs(F.col("value") - F.col("v")))).first()[0] < 1e-9


def test_rebase_preserves_row_total(spark, fitted):
    models, scaled = fitted
    smoothed = C.contribution_wide(scaled, models, SESSIONS_SPEC, rebase_groups=())
    based = C.contribution_wide(scaled, models, SESSIONS_SPEC)
    a = smoothed.select("product_id", "date", _total(None).alias("a"))
    b = based.select("product_id", "date", _total(None).alias("b"),
                     *[F.col(g) for g in C.REBASE_GROUPS])
    j = a.join(b, ["product_id", "date"])
    assert j.select(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-8
    mins = based.groupBy("product_id").agg(*[F.min(g).alias(g) for g in C.REBASE_GROUPS]).collect()
    for r in mins:
        for g in C.REBASE_GROUPS:
            assert abs(r[g]) < 1e-9


def test_by_product_and_share(spark, fitted):
    models, scaled = fitted
    share = C.contribution_share(scaled, models, SESSIONS_SPEC)
    sums = share.groupBy("product_id", F.signum("value").alias("s")).agg(F.sum("share").alias("t")).collect()
    for r in sums:
        if r.s != 0:
            assert r.t == pytest.approx(r.s)
    assert share.select("driver_group").distinct().count() == 7


def test_rollups_in_one_pass(spark):
    models, scaled = R.fit(panel_drivers(spark, SF001), SESSIONS_SPEC)
    args = (scaled, models, SESSIONS_SPEC)
    rolled = C.contribution_rollups(*args)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") >= 1 and plan.count("FileScan") <= 2          # one design, one model table
    found = {(r.product_id, r.level, r.year, r.week_commencing, r.driver_group): r.value for r in rolled.collect()}
    want = {(r.product_id, "year", r.year, None, r.driver_group): r.value for r in C.contribution_annual(*args).collect()}
    want |= {(r.product_id, "week", None, r.week_commencing, r.driver_group): r.value for r in C.contribution_weekly(*args).collect()}
    want |= {(r.product_id, "product", None, None, r.driver_group): r.value for r in C.contribution_by_product(*args).collect()}
    assert set(found) == set(want)
    assert all((v is None and want[k] is None) or abs(v - want[k]) < 1e-8 * (1 + abs(v)) for k, v in found.items())
