import datetime as dt

from mixlens.operators import panel as P
from mixlens.operators import segment as SG

D1, D2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)


def test_total_layer(spark):
    df = spark.createDataFrame([("a", D1, 2, 1), ("b", D1, 3, 1)], "product_id string, date date, sessions bigint, bookings bigint")
    rows = {(r.product_id, r.sessions) for r in P.with_total(df).collect()}
    assert rows == {("a", 2), ("b", 3), ("Total", 5)}


def test_one_hot_null_is_all_zero(spark):
    df = spark.createDataFrame([(D1, "average"), (D2, None)], "date date, weather_index string")
    out = P.weather_onehot(df).orderBy("date").collect()
    assert (out[0].average_weather_days, out[0].better_than_average_weather_days) == (1.0, 0.0)
    assert (out[1].average_weather_days, out[1].worse_than_average_weather_days) == (0.0, 0.0)


def test_event_dummy_with_markets(spark):
    df = spark.createDataFrame([("uk", D1), ("fr", D1), ("uk", D2)], "country string, date date")
    out = P.event_dummy(df, "promo", [D1], market_col="country", markets=["uk"])
    got = {(r.country, r.date, r.promo) for r in out.collect()}
    assert got == {("uk", D1, 1.0), ("fr", D1, 0.0), ("uk", D2, 0.0)}


def test_mean_of_daily_ratios_skips_zero_days(spark):
    df = spark.createDataFrame([("a", D1, 10, 1), ("a", D2, 0, 0)], "product_id string, date date, sessions bigint, bookings bigint")
    assert SG.product_stats(df).first().av_conv_rate == 0.1


def test_uplift_empty_year_is_null_not_error(spark):
    df = spark.createDataFrame([("a", dt.date(1999, 5, 1), 10, 1)], "product_id string, date date, sessions bigint, bookings bigint")
    assert SG.product_stats(df).first().uplift is None


def test_profile_counts_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = {r.column_name: (r.n_rows, r.n_non_null, r.n_null) for r in P.profile(df).collect()}
    assert got == {"a": (2, 2, 0), "b": (2, 1, 1)}


def test_union_all_fills_missing(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert sorted(P.union_all(a, b).collect(), key=lambda r: r.x)[1].y is None


def test_driver_join_keeps_unmatched_rows(spark):
    panel = spark.createDataFrame([("a", D1, 1, 1), ("a", D2, 1, 1)], "product_id string, date date, sessions bigint, bookings bigint")
    meta = spark.createDataFrame([(D1, 5.0)], "date date, tv_ad_reach double")
    out = P.join_drivers(panel, meta).orderBy("date").collect()
    assert [r.tv_ad_reach for r in out] == [5.0, None]


def test_filter_products_coerces_numbers(spark):
    df = spark.createDataFrame([("91", 1), ("9", 2)], "product_id string, v int")
    assert [r.v for r in P.filter_products(df, 91).collect()] == [1]
    assert sorted(r.v for r in P.filter_products(df, [91, "9"]).collect()) == [1, 2]
