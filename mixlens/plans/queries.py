"""Query registry: every operator of the survey as a named query on the driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the result is
expressible in plain SQL, ``ORACLE_SQL[name]`` gives the same result computed
by DuckDB over the same parquet views.  Double columns are rounded (see context.rounded) on
both sides (sums in a different order differ in the last bits).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixlens.functions.scalar import weekday_flag, date_in, power_col, log1p_col
from mixlens.operators import contribution as C
from mixlens.operators import forecast as FC
from mixlens.operators import longseries as L
from mixlens.operators import panel as P
from mixlens.operators import regression as R
from mixlens.operators import segment as SG
from mixlens.operators import series as S
from mixlens.operators.features import (
    KEY, DATE, SESSIONS_SPEC, BOOKINGS_SPEC, ADSTOCK_RATE, FX_WINDOW, SMOOTH_WINDOW, DECAY_RATES,
    CHRISTMAS, features, build_design, driver_overlay as _overlay, compat_spec, TOTAL_SPEC, horizon_features_blocks,
    strict_spec, TOTAL_BOOKINGS_SPEC,
)
from mixlens.plans import sql as Q
from mixlens.plans.score import score
from mixlens.plans.context import (
    panel, panel_train, panel_train_by_product, meta, panel_by_product, panel_drivers, total_drivers, rounded,
)
from mixlens.operators.increments import MomentStore
from mixlens.session import bucketed_table, cut_lineage, scratch_path
from mixlens.sources import io as IO
from mixlens.sources.tables import product_markets, read_table, series_parts, variable_groupings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- exploration
@register("product_count", Q.PRODUCT_COUNT)
def product_count(spark, sf):
    return P.product_count(panel(spark, sf))


@register("daily_metrics_long", Q.DAILY_METRICS_LONG)
def daily_metrics_long(spark, sf):
    return P.to_long(P.daily_totals(panel(spark, sf)), [DATE], ["sessions", "bookings"])


@register("daily_conversion", Q.DAILY_CONVERSION)
def daily_conversion(spark, sf):
    return rounded(P.daily_conversion(panel(spark, sf)))


@register("daily_conversion_long", Q.DAILY_CONVERSION_LONG)
def daily_conversion_long(spark, sf):
    return rounded(P.daily_conversion_long(panel(spark, sf)))


@register("product_series_long", Q.PRODUCT_SERIES_LONG)
def product_series_long(spark, sf):
    return P.to_long(panel(spark, sf), [KEY, DATE], ["sessions", "bookings"])


@register("product_totals_long", Q.PRODUCT_TOTALS_LONG)
def product_totals_long(spark, sf):
    return P.to_long(P.product_totals(panel(spark, sf)), [KEY], ["sessions", "bookings"])


@register("date_bounds", Q.DATE_BOUNDS)
def date_bounds(spark, sf):
    return P.date_bounds(panel(spark, sf))


@register("panel_profile", Q.PANEL_PROFILE)
def panel_profile(spark, sf):
    return P.profile(panel_drivers(spark, sf))


# ---------------------------------------------------------------- CSV front door
def _csv_files(spark, sf):
    """The two views written as CSV: the panel's years in two column orders and,
    among them, copies of some days with a broken number or date."""
    folder = scratch_path(spark, "csv")
    p = panel(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("date", "sessions", "bookings")})
    even = F.substring(DATE, 1, 4).cast("int") % 2 == 0
    names = [F.col("product_id").alias("Product ID"), F.col(DATE).alias("Date"), F.col("sessions").alias("Sessions"),
             F.col("bookings").alias("Bookings")]
    bad_number = p.filter(F.substring(DATE, 9, 2) == "01").withColumn("sessions", F.lit("n/a"))
    bad_date = p.filter(F.substring(DATE, 9, 2) == "02").withColumn(DATE, F.concat(DATE, F.lit("?")))
    p.filter(even).unionByName(bad_number).select(*names).write.option("header", True).csv(f"{folder}/panel/a")
    p.filter(~even).unionByName(bad_date).select(names[1], names[3], names[0], names[2]).write.option("header", True).csv(f"{folder}/panel/b")
    meta(spark, sf).select(
        F.col("weather_index").alias("Weather Index"), F.date_format(DATE, "dd/MM/yyyy").alias("Date"),
        *[F.col(c).alias(c.replace("_", " ").title()) for c in
          ("online_visibility", "tv_ad_reach", "exchange_rate", "consumer_confidence_index")]
    ).write.option("header", True).csv(f"{folder}/meta")
    return f"{folder}/panel/*", f"{folder}/meta"


@register("panel_from_csv", Q.PANEL_FROM_CSV)
def panel_from_csv(spark, sf):
    return IO.read_panel_csv(spark, _csv_files(spark, sf)[0])


@register("meta_from_csv", Q.META_FROM_CSV)
def meta_from_csv(spark, sf):
    return rounded(IO.read_meta_csv(spark, _csv_files(spark, sf)[1]))


@register("csv_rejects", Q.CSV_REJECTS)
def csv_rejects(spark, sf):
    found = IO.check_panel_csv(spark, _csv_files(spark, sf)[0])
    return found.rejects.groupBy("column", "reason", "value").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- panel build
@register("total_layer", Q.TOTAL_LAYER)
def total_layer(spark, sf):
    return P.with_total(panel(spark, sf))


@register("panel_with_drivers", Q.PANEL_WITH_DRIVERS)
def panel_with_drivers(spark, sf):
    return rounded(panel_drivers(spark, sf, total=True))


@register("weather_onehot", Q.WEATHER_ONEHOT)
def weather_onehot(spark, sf):
    return P.weather_onehot(meta(spark, sf)).select(
        DATE, "weather_index", *P.WEATHER_LEVELS.values())


@register("event_dummy", Q.EVENT_DUMMY)
def event_dummy(spark, sf):
    return P.event_dummy(panel_train(spark, sf), "xmas", CHRISTMAS).select(KEY, DATE, "xmas")


# a campaign of three markets on two days a year
EVENT_DAYS = tuple(f"{y}-{d}" for y in range(1995, 2000) for d in ("05-01", "11-27"))
EVENT_MARKETS = ("NATION_3", "NATION_7", "NATION_12")


@register("event_dummy_market", Q.EVENT_DUMMY_MARKET)
def event_dummy_market(spark, sf):
    """J5 an event on given dates in given markets only: flag joined on date and market."""
    d = P.with_market(panel_train(spark, sf), product_markets(spark, sf))
    d = P.event_dummy(d, "campaign", EVENT_DAYS, market_col="market", markets=EVENT_MARKETS)
    return d.select(KEY, DATE, "market", "campaign")


# ---------------------------------------------------------------- series windows
@register("adstock_tv", Q.ADSTOCK_TV)
def adstock_tv(spark, sf):
    d = S.adstock(panel_by_product(spark, sf), "tv_ad_reach", ADSTOCK_RATE, by=KEY, order=DATE, out="tv_adstock")
    return rounded(d.select(KEY, DATE, "tv_adstock"))


@register("adstock_multi_rate", Q.ADSTOCK_MULTI_RATE)
def adstock_multi_rate(spark, sf):
    d = panel_by_product(spark, sf).select(KEY, DATE, "tv_ad_reach")
    return rounded(S.adstock_rates(d, "tv_ad_reach", DECAY_RATES, by=KEY, order=DATE, out="adstock")
                   .select(KEY, DATE, "rate", "adstock"), keep=("rate",))


@register("fx_rolling_mean", Q.FX_ROLLING_MEAN)
def fx_rolling_mean(spark, sf):
    d = S.rolling_mean_right(panel_by_product(spark, sf), "exchange_rate", FX_WINDOW, by=KEY, order=DATE,
                             out="exchange_rate_moving_av")
    return rounded(d.select(KEY, DATE, "exchange_rate_moving_av"))


@register("centered_mean_extend", Q.CENTERED_MEAN_EXTEND)
def centered_mean_extend(spark, sf):
    d = panel_train_by_product(spark, sf).withColumn("sessions", F.col("sessions").cast("double"))
    d = S.rolling_mean_center(d, ["sessions"], SMOOTH_WINDOW, by=KEY, order=DATE, suffix="_smooth")
    return rounded(d.select(KEY, DATE, "sessions_smooth"))


@register("lag_trend", Q.LAG_TREND)
def lag_trend(spark, sf):
    d = S.lag(panel_by_product(spark, sf), "exchange_rate", 1, by=KEY, order=DATE, out="exchange_rate_lag1")
    d = S.trend(d, by=KEY, order=DATE, out="trend")
    return rounded(d.select(KEY, DATE, "exchange_rate_lag1", "trend"))


@register("zscore_by_product", Q.ZSCORE_BY_PRODUCT)
def zscore_by_product(spark, sf):
    d = S.zscore(panel_train_by_product(spark, sf), ["sessions", "bookings"], by=KEY, suffix="_z")
    return rounded(d.select(KEY, DATE, "sessions_z", "bookings_z"))


@register("interpolated_fx", Q.INTERPOLATED_FX)
def interpolated_fx(spark, sf):
    d = S.interpolate(panel_by_product(spark, sf), "exchange_rate", by=KEY, order=DATE, out="exchange_rate_filled")
    return rounded(d.select(KEY, DATE, "exchange_rate", "exchange_rate_filled"))


@register("rebase_sessions", Q.REBASE_SESSIONS)
def rebase_sessions(spark, sf):
    d = panel_train_by_product(spark, sf).select(KEY, DATE, F.col("sessions").cast("double").alias("base"),
                                      F.col("bookings").cast("double").alias("bookings"))
    return rounded(S.rebase(d, ["bookings"], "base", by=KEY))


@register("long_series", Q.LONG_SERIES)
def long_series(spark, sf):
    """W1, W3-W8 over ONE series of all lineitem rows: blocks and a scan over blocks."""
    rows = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        "l_shipdate", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice").cast("double")).alias("returned_price"))
    d = L.lay_out(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "quantity"])
    d = L.adstock(d, "quantity", ADSTOCK_RATE, out="quantity_adstock")
    d = L.zscore(L.interpolate(d, "returned_price"), "quantity")
    d = L.lag(d, "price", 1, out="price_lag1")
    d = L.rolling_mean_right(d, "price", FX_WINDOW, out="price_mean10")
    d = L.rolling_mean_center(d, "price", SMOOTH_WINDOW, out="price_smooth")
    return rounded(d.select("l_orderkey", "l_linenumber", F.col("rn").alias("trend"), "quantity_adstock", "price_mean10",
                            "price_smooth", "price_lag1", "returned_price", "quantity_z"))


# ---------------------------------------------------------------- scalar features
@register("weekday_flags", Q.WEEKDAY_FLAGS)
def weekday_flags(spark, sf):
    m = meta(spark, sf)
    return m.select(DATE, weekday_flag(DATE, "Friday").alias("day_friday"),
                    weekday_flag(DATE, "Saturday").alias("day_saturday"),
                    weekday_flag(DATE, "Sunday").alias("day_sunday"),
                    F.dayofmonth(DATE).cast("bigint").alias("day_number"),
                    F.date_format(DATE, "MMMM").alias("month"),
                    F.year(DATE).cast("bigint").alias("year"))


@register("power_log_features", Q.POWER_LOG_FEATURES)
def power_log_features(spark, sf):
    m = meta(spark, sf)
    return rounded(m.select(DATE, log1p_col("tv_ad_reach").alias("tv_log1p"),
                            power_col("online_visibility", 2).alias("online_visibility_exp")))


@register("christmas_flag", Q.CHRISTMAS_FLAG)
def christmas_flag(spark, sf):
    return meta(spark, sf).select(DATE, date_in(DATE, CHRISTMAS).alias("xmas"))


# ---------------------------------------------------------------- features
@register("features_sessions", Q.FEATURES_SESSIONS)
def features_sessions(spark, sf):
    return rounded(features(panel_by_product(spark, sf), SESSIONS_SPEC))


@register("features_bookings", Q.FEATURES_BOOKINGS)
def features_bookings(spark, sf):
    return rounded(features(panel_by_product(spark, sf), BOOKINGS_SPEC))


@register("features_sessions_compat", Q.FEATURES_SESSIONS_COMPAT)
def features_sessions_compat(spark, sf):
    return rounded(features(panel_by_product(spark, sf), compat_spec(SESSIONS_SPEC)))


@register("features_sessions_strict", Q.FEATURES_SESSIONS_STRICT)
def features_sessions_strict(spark, sf):
    """W1 / M1 with days of no TV reach unknown rather than 0, and the plain recursion."""
    unknown = meta(spark, sf).withColumn("tv_ad_reach", F.nullif("tv_ad_reach", F.lit(0.0)))
    return rounded(features(panel_by_product(spark, sf, drivers=cut_lineage(unknown)), strict_spec(SESSIONS_SPEC)))


@register("features_horizon", Q.FEATURES_HORIZON)
def features_horizon(spark, sf):
    return rounded(FC.horizon_frame(meta(spark, sf), (SESSIONS_SPEC, BOOKINGS_SPEC), scale="horizon"))


@register("features_horizon_blocks", Q.FEATURES_HORIZON)
def features_horizon_blocks(spark, sf):
    """M18 as above, for a driver series of any length: blocks of 1024 rows and a scan over blocks."""
    terms = tuple(dict.fromkeys(SESSIONS_SPEC.terms + BOOKINGS_SPEC.terms))
    return rounded(horizon_features_blocks(P.weather_onehot(meta(spark, sf)), SESSIONS_SPEC, terms=terms, chunk=1024))


@register("driver_overlay", Q.DRIVER_OVERLAY)
def driver_overlay(spark, sf):
    design = build_design(panel_by_product(spark, sf), SESSIONS_SPEC)
    return rounded(_overlay(design, "tv_adstock"))


@register("scaled_drivers_long", Q.SCALED_DRIVERS_LONG)
def scaled_drivers_long(spark, sf):
    return rounded(FC.scaled_drivers_long(meta(spark, sf), BOOKINGS_SPEC))


# ---------------------------------------------------------------- regression
@register("gram_by_product", Q.GRAM_BY_PRODUCT)
def gram_by_product(spark, sf):
    g = R.gram(features(panel_by_product(spark, sf), SESSIONS_SPEC), SESSIONS_SPEC)
    g = g.select(KEY, "n", "yty", "sum_y", F.posexplode(F.concat("xtx", "xty")).alias("entry", "value"))
    return rounded(g.select(KEY, "n", "yty", "sum_y", F.col("entry").cast("bigint").alias("entry"), "value"))


@register("single_driver_fit", Q.SINGLE_DRIVER_FIT)
def single_driver_fit(spark, sf):
    d = build_design(panel_by_product(spark, sf), SESSIONS_SPEC)
    out = d.groupBy(KEY).agg(
        F.regr_count("dep_var", "tv_adstock").alias("n"),
        F.regr_slope("dep_var", "tv_adstock").alias("slope"),
        F.regr_intercept("dep_var", "tv_adstock").alias("intercept"),
        F.regr_r2("dep_var", "tv_adstock").alias("r_squared"),
    )
    return rounded(out)


def _fit(spark, sf, spec, keep_design=True):
    return R.fit(panel_by_product(spark, sf), spec, keep_design=keep_design, buckets=series_parts(spark, sf))


def _coef_long(models):
    z = F.arrays_zip(F.col("terms").alias("term"), F.col("coef").alias("estimate"))
    return models.select("target", KEY, "status", "rank", "n", F.posexplode(z).alias("term_index", "t")).select(
        "target", KEY, "status", "rank", "n", "term_index", "t.term", "t.estimate")


@register("ols_sessions", Q.OLS_SESSIONS)
def ols_sessions(spark, sf):
    models, _ = _fit(spark, sf, SESSIONS_SPEC, keep_design=False)
    return rounded(_coef_long(models))


@register("ols_bookings", Q.OLS_BOOKINGS)
def ols_bookings(spark, sf):
    models, _ = _fit(spark, sf, BOOKINGS_SPEC, keep_design=False)
    return rounded(_coef_long(models))


def _by_increment(spark, sf, spec):
    """The history to October 1999 as one batch, then November and December, each read alone."""
    store = MomentStore(spark, scratch_path(spark, "moments"), spec)
    cuts = (None, "1999-11-01", "1999-12-01", "2000-01-01")
    for low, high in zip(cuts, cuts[1:]):
        rows = panel_by_product(spark, sf).filter(F.col(DATE) < F.lit(high).cast("date"))
        store.append(rows if low is None else rows.filter(F.col(DATE) >= F.lit(low).cast("date")), batch=f"to-{high}")
    return store.fit()


@register("ols_sessions_by_increment", Q.OLS_SESSIONS)
def ols_sessions_by_increment(spark, sf):
    return rounded(_coef_long(_by_increment(spark, sf, SESSIONS_SPEC)))


@register("ols_bookings_by_increment", Q.OLS_BOOKINGS)
def ols_bookings_by_increment(spark, sf):
    return rounded(_coef_long(_by_increment(spark, sf, BOOKINGS_SPEC)))


@register("coef_table", Q.COEF_TABLE)
def coef_table(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(R.coef_table(scaled, models, SESSIONS_SPEC))


@register("fit_status", Q.FIT_STATUS)
def fit_status(spark, sf):
    """M4 statuses and notes, with a Christmas flag (constant where a product has no
    such day) and with all three weather flags (one too many beside the intercept)."""
    out = None
    for label, extra in (("with_christmas", "xmas"), ("all_weather", "average_weather_days")):
        spec = replace(SESSIONS_SPEC, terms=(*SESSIONS_SPEC.terms, extra))
        models, _ = _fit(spark, sf, spec, keep_design=False)
        one = R.fit_notes(models, spec).select(F.lit(label).alias("terms"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("ols_total", Q.OLS_TOTAL)
def ols_total(spark, sf):
    """The all-products 'Total' series fitted on its own, missing terms interpolated."""
    models, _ = R.fit(total_drivers(spark, sf), TOTAL_SPEC, keep_design=False)
    return rounded(_coef_long(models))


@register("ols_total_bookings", Q.OLS_TOTAL_BOOKINGS)
def ols_total_bookings(spark, sf):
    """The Total series' bookings: scaled on the whole range, fitted on the later years."""
    models, _ = R.fit(total_drivers(spark, sf), TOTAL_BOOKINGS_SPEC, keep_design=False)
    return rounded(_coef_long(models))


def _fit_total(spark, sf, spec=TOTAL_SPEC):
    return R.fit(total_drivers(spark, sf), spec)


@register("contribution_total_daily", Q.CONTRIBUTION_TOTAL_DAILY)
def contribution_total_daily(spark, sf):
    """The Total series' daily driver contributions (its single, interpolated fit)."""
    models, scaled = _fit_total(spark, sf)
    return rounded(C.contribution_daily(scaled, models, TOTAL_SPEC))


@register("contribution_total_annual", Q.CONTRIBUTION_TOTAL_ANNUAL)
def contribution_total_annual(spark, sf):
    models, scaled = _fit_total(spark, sf)
    return rounded(C.contribution_annual(scaled, models, TOTAL_SPEC))


@register("contribution_total_daily_bookings", Q.CONTRIBUTION_TOTAL_DAILY_BOOKINGS)
def contribution_total_daily_bookings(spark, sf):
    models, scaled = _fit_total(spark, sf, TOTAL_BOOKINGS_SPEC)
    return rounded(C.contribution_daily(scaled, models, TOTAL_BOOKINGS_SPEC))


@register("contribution_total_annual_bookings", Q.CONTRIBUTION_TOTAL_ANNUAL_BOOKINGS)
def contribution_total_annual_bookings(spark, sf):
    models, scaled = _fit_total(spark, sf, TOTAL_BOOKINGS_SPEC)
    return rounded(C.contribution_annual(scaled, models, TOTAL_BOOKINGS_SPEC))


@register("fit_summary", Q.FIT_SUMMARY)
def fit_summary(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(R.fit_summary(scaled, models, SESSIONS_SPEC))


@register("model_quality", Q.MODEL_QUALITY)
def model_quality(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(R.model_quality(scaled, models, SESSIONS_SPEC))


@register("model_quality_bookings", Q.MODEL_QUALITY_BOOKINGS)
def model_quality_bookings(spark, sf):
    models, scaled = _fit(spark, sf, BOOKINGS_SPEC)
    return rounded(R.model_quality(scaled, models, BOOKINGS_SPEC))


@register("actual_vs_model", Q.ACTUAL_VS_MODEL)
def actual_vs_model(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(R.actual_vs_model(scaled, models, SESSIONS_SPEC))


@register("actual_vs_model_bookings", Q.ACTUAL_VS_MODEL_BOOKINGS)
def actual_vs_model_bookings(spark, sf):
    models, scaled = _fit(spark, sf, BOOKINGS_SPEC)
    return rounded(R.actual_vs_model(scaled, models, BOOKINGS_SPEC))


@register("residual_diagnostics", Q.RESIDUAL_DIAGNOSTICS)
def residual_diagnostics(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(R.residual_diagnostics(scaled, models, SESSIONS_SPEC, buckets=series_parts(spark, sf)))


@register("rmse_by_product", Q.RMSE_BY_PRODUCT)
def rmse_by_product(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(R.rmse_by_product(scaled, models, SESSIONS_SPEC))


# ---------------------------------------------------------------- contributions
@register("contribution_terms_grouped", Q.CONTRIBUTION_TERMS_GROUPED)
def contribution_terms_grouped(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    long = C.term_contributions(scaled, models, SESSIONS_SPEC)
    return rounded(C.group_terms(long, variable_groupings(spark)))


@register("contribution_daily", Q.CONTRIBUTION_DAILY)
def contribution_daily(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(C.contribution_daily(scaled, models, SESSIONS_SPEC))


@register("contribution_daily_bookings", Q.CONTRIBUTION_DAILY_BOOKINGS)
def contribution_daily_bookings(spark, sf):
    models, scaled = _fit(spark, sf, BOOKINGS_SPEC)
    return rounded(C.contribution_daily(scaled, models, BOOKINGS_SPEC))


@register("contribution_annual", Q.CONTRIBUTION_ANNUAL)
def contribution_annual(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(C.contribution_annual(scaled, models, SESSIONS_SPEC))


@register("contribution_weekly", Q.CONTRIBUTION_WEEKLY)
def contribution_weekly(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(C.contribution_weekly(scaled, models, SESSIONS_SPEC), digits=6)


@register("contribution_rollups", Q.CONTRIBUTION_ROLLUPS)
def contribution_rollups(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(C.contribution_rollups(scaled, models, SESSIONS_SPEC), digits=6)


@register("contribution_by_product", Q.CONTRIBUTION_BY_PRODUCT)
def contribution_by_product(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(C.contribution_by_product(scaled, models, SESSIONS_SPEC))


@register("contribution_by_product_bookings", Q.CONTRIBUTION_BY_PRODUCT_BOOKINGS)
def contribution_by_product_bookings(spark, sf):
    models, scaled = _fit(spark, sf, BOOKINGS_SPEC)
    return rounded(C.contribution_by_product(scaled, models, BOOKINGS_SPEC))


@register("contribution_share", Q.CONTRIBUTION_SHARE)
def contribution_share(spark, sf):
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    return rounded(C.contribution_share(scaled, models, SESSIONS_SPEC))


@register("contribution_share_bookings", Q.CONTRIBUTION_SHARE_BOOKINGS)
def contribution_share_bookings(spark, sf):
    models, scaled = _fit(spark, sf, BOOKINGS_SPEC)
    return rounded(C.contribution_share(scaled, models, BOOKINGS_SPEC))


# ---------------------------------------------------------------- segmentation
@register("product_stats", Q.PRODUCT_STATS)
def product_stats(spark, sf):
    return rounded(SG.product_stats(panel_train(spark, sf)))


@register("uplift", Q.UPLIFT)
def uplift(spark, sf):
    return rounded(panel_train(spark, sf).groupBy(KEY).agg(SG.uplift_expr().alias("uplift")))


def _segment_table(spark, sf):
    """One row per product; written once, then read by every MLlib pass."""
    models, scaled = _fit(spark, sf, SESSIONS_SPEC)
    by_product = C.contribution_by_product_wide(scaled, models, SESSIONS_SPEC)
    return cut_lineage(SG.segment_table(by_product, SG.product_stats(panel_train(spark, sf))))


@register("segment_features", Q.SEGMENT_FEATURES)
def segment_features(spark, sf):
    table = _segment_table(spark, sf)
    return rounded(SG.scaled_columns(table, SG.scale_features(table)))


@register("elbow", Q.ELBOW)
def elbow(spark, sf):
    return rounded(SG.elbow(SG.scale_features(_segment_table(spark, sf))))


def _groupings(spark, sf):
    table = _segment_table(spark, sf)
    return table, SG.cluster(SG.scale_features(table), k=3)


@register("product_groupings", Q.PRODUCT_GROUPINGS)
def product_groupings(spark, sf):
    return SG.with_unclustered(*_groupings(spark, sf))


@register("cluster_profile", Q.CLUSTER_PROFILE)
def cluster_profile(spark, sf):
    table, groups = _groupings(spark, sf)
    return rounded(SG.cluster_profile(table, groups))


@register("answer_sheet", Q.ANSWER_SHEET)
def answer_sheet(spark, sf):
    _, groups = _groupings(spark, sf)
    return SG.answer_sheet(panel(spark, sf), groups)


# ---------------------------------------------------------------- forecast
def _dealt_panel(spark, sf, drivers, products=None):
    """The panel with its drivers, written once by product: each fit reads it without an exchange."""
    return bucketed_table(panel_by_product(spark, sf, drivers=drivers, products=products), KEY, (), series_parts(spark, sf))


def _forecast(spark, sf, scale="train", products=None):
    return _forecast_and_panel(spark, sf, scale, products)[0]


def _forecast_and_panel(spark, sf, scale="train", products=None):
    drivers = meta(spark, sf, materialise=True)   # read by the panel join and by the horizon
    pdr = _dealt_panel(spark, sf, drivers, products)
    ms, _ = R.fit(pdr, SESSIONS_SPEC, keep_design=False)
    mb, _ = R.fit(pdr, BOOKINGS_SPEC, keep_design=False)
    return FC.forecast({"sessions": (ms, SESSIONS_SPEC), "bookings": (mb, BOOKINGS_SPEC)}, drivers, scale), pdr


@register("forecast_long", Q.FORECAST_LONG)
def forecast_long(spark, sf):
    return rounded(FC.forecast_long(_forecast(spark, sf)))


@register("forecast_from_store", Q.FORECAST_LONG)
def forecast_from_store(spark, sf):
    """S6 -> M19 as two jobs: fits saved as a run of the model store (after an older
    run of other models), then predictions from the latest run alone."""
    store = IO.ModelStore(spark, scratch_path(spark, "models"))
    drivers = meta(spark, sf, materialise=True)
    pdr = _dealt_panel(spark, sf, drivers)
    specs = (SESSIONS_SPEC, BOOKINGS_SPEC)
    older = R.fit(pdr, replace(SESSIONS_SPEC, adstock_rate=0.5), keep_design=False)[0]
    store.save(older, "run-1")
    store.save(R.fit(pdr, specs[0], keep_design=False)[0].unionByName(R.fit(pdr, specs[1], keep_design=False)[0]), "run-2")
    return rounded(FC.forecast_long(score(store, specs, meta(spark, sf))))


@register("forecast_horizon_scaled", Q.FORECAST_HORIZON_SCALED)
def forecast_horizon_scaled(spark, sf):
    return rounded(_forecast(spark, sf, scale="horizon"))


@register("forecast_preview", Q.FORECAST_PREVIEW)
def forecast_preview(spark, sf):
    """O1 head of the joined forecast in (product, date) order."""
    return P.preview(rounded(_forecast(spark, sf)), [KEY, DATE], 6)


@register("actual_plus_forecast", Q.ACTUAL_PLUS_FORECAST)
def actual_plus_forecast(spark, sf):
    wide, pdr = _forecast_and_panel(spark, sf)
    return rounded(FC.actual_plus_forecast(pdr, wide))


def _lead(spark, sf) -> list[str]:
    """The id of the series with the most sessions (none in an empty table)."""
    return [r[KEY] for r in P.lead_product(panel_train(spark, sf)).collect()]


@register("one_product_view", Q.ONE_PRODUCT_VIEW)
def one_product_view(spark, sf):
    """O4 / P7 actuals and forecast of one series: only its rows are fitted and scored."""
    ids = _lead(spark, sf)
    wide, pdr = _forecast_and_panel(spark, sf, products=ids)
    return rounded(FC.actual_plus_forecast(pdr, wide))


@register("one_product_overlay", Q.ONE_PRODUCT_OVERLAY)
def one_product_overlay(spark, sf):
    """M21 / P7 target and one driver side by side for one series."""
    design = build_design(panel_by_product(spark, sf, products=_lead(spark, sf)), SESSIONS_SPEC)
    return rounded(_overlay(design, "tv_adstock"))


# ---------------------------------------------------------------- transform search
@register("transform_grid", Q.TRANSFORM_GRID)
def transform_grid(spark, sf):
    """M22 candidate adstock rates per product, ranked by the R^2 of a one-term fit."""
    d = panel_by_product(spark, sf).select(KEY, DATE, "sessions", "tv_ad_reach")
    for i, rate in enumerate(DECAY_RATES):
        d = S.adstock(d, "tv_ad_reach", rate, by=KEY, order=DATE, out=f"adstock_{i}")
    # every rate's sums in one aggregate of the products' rows; only its result is unpivoted
    d = d.select(KEY, F.col("sessions").cast("double").alias("y"), *[F.log1p(f"adstock_{i}").alias(f"x{i}") for i in range(len(DECAY_RATES))])
    sums = d.groupBy(KEY).agg(*[F.struct(F.lit(rate).alias("rate"), F.regr_r2("y", f"x{i}").alias("r_squared"),
                                         F.regr_slope("y", f"x{i}").alias("slope")).alias(f"f{i}")
                                for i, rate in enumerate(DECAY_RATES)])
    g = sums.select(KEY, F.explode(F.array(*[f"f{i}" for i in range(len(DECAY_RATES))])).alias("f")).select(KEY, "f.*")
    w = Window.partitionBy(KEY).orderBy(F.desc_nulls_last("r_squared"), F.asc("rate"))
    return rounded(g.withColumn("rank", F.row_number().over(w).cast("bigint")), keep=("rate",))


@register("transform_search", Q.TRANSFORM_SEARCH)
def transform_search(spark, sf):
    """M22 full grid: adstock rate x exchange-rate transform x visibility power,
    one nine-term model per product and candidate, ranked by RMSE."""
    from mixlens.operators.search import search
    return rounded(search(panel_by_product(spark, sf), buckets=series_parts(spark, sf)), keep=("adstock_rate", "visibility_power"))


FLAGSHIP = "contribution_by_product"
