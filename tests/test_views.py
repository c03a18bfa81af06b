"""One-product views, markets, the long conversion frame and the strict adstock."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from mixlens.operators import panel as P
from mixlens.operators.features import BOOKINGS_SPEC, SESSIONS_SPEC, build_design, horizon_features_blocks, strict_spec
from mixlens.operators.increments import MomentStore
from mixlens.plans.context import panel_drivers, panel_train

DAYS = [dt.date(1999, 1, 1) + dt.timedelta(days=i) for i in range(4)]


def small_panel(spark):
    rows = [("b", DAYS[0], 5, 1), ("b", DAYS[1], 5, None), ("a", DAYS[0], 10, 2), ("c", DAYS[2], 0, 3), ("d", DAYS[3], None, 1)]
    return spark.createDataFrame(rows, "product_id string, date date, sessions bigint, bookings bigint")


def test_lead_product_ties_and_empty(spark):
    p = small_panel(spark)
    assert [r.product_id for r in P.lead_product(p).collect()] == ["a"]          # a and b both have 10
    assert [r.product_id for r in P.lead_product(p, "bookings").collect()] == ["c"]
    assert P.lead_product(p.filter("false")).collect() == []
    assert P.filter_products(p, []).count() == 0 and P.filter_products(p, ["a", "b"]).count() == 3


def test_market_flag(spark):
    markets = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z"), ("d", None)], "product_id string, market string")
    d = P.with_market(small_panel(spark), markets)
    assert d.count() == 5 and {(r.product_id, r.market) for r in d.collect()} == {("a", "x"), ("b", "y"), ("c", None), ("d", None)}
    flagged = P.event_dummy(d, "event", [DAYS[0], DAYS[0], DAYS[3]], market_col="market", markets=["x", "w"])
    assert {(r.product_id, r.date) for r in flagged.filter("event = 1").collect()} == {("a", DAYS[0])}
    assert flagged.count() == 5 and flagged.filter("event is null").count() == 0
    # beyond the bound the join is planned as a shuffle join and gives the same
    plain = P.with_market(small_panel(spark), markets, max_rows=0)
    assert sorted(plain.collect(), key=repr) == sorted(d.collect(), key=repr)


def test_conversion_long(spark):
    got = {(r.date, r.metric): r.value for r in P.daily_conversion_long(small_panel(spark)).collect()}
    assert len(got) == 12 and got[DAYS[0], "conv_rate"] == pytest.approx(3 / 15)
    assert got[DAYS[2], "conv_rate"] is None and got[DAYS[3], "sessions"] is None


def test_strict_spec_stays_unknown(spark):
    drivers = panel_drivers(spark, SF001)
    # days without orders have no driver row
    cut = drivers.withColumn("tv_ad_reach", F.when(F.year("date") < 1997, F.coalesce("tv_ad_reach", F.lit(0.0))))
    strict = build_design(cut, strict_spec(SESSIONS_SPEC))
    loose = build_design(cut, SESSIONS_SPEC)
    known = strict.filter("tv_adstock is not null")
    assert known.agg(F.max(F.year("date"))).first()[0] == 1996
    assert known.count() == loose.filter(F.year("date") < 1997).count() and loose.filter("tv_adstock is null").count() == 0
    for other in (lambda: MomentStore(spark, "unused", strict_spec(BOOKINGS_SPEC)),
                  lambda: horizon_features_blocks(cut, strict_spec(SESSIONS_SPEC))):
        with pytest.raises(ValueError):
            other()


def test_one_product_reads_its_rows_only(spark):
    lead = P.lead_product(panel_train(spark, SF001)).first().product_id
    d = panel_drivers(spark, SF001, products=[lead])
    assert [r.product_id for r in d.select("product_id").distinct().collect()] == [lead]
    assert d.count() == panel_train(spark, SF001).filter(F.col("product_id") == lead).count()
