"""Panel operators: total layer, driver join, one-hot, event dummies, profile and
the exploration frames (A1-A5, A12-A15, J1, J5, R1, R2, O3, V1-V4)."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.functions.scalar import safe_div
from mixlens.operators.joins import bounded_broadcast, MAX_BROADCAST_ROWS

# --- fixed values: category levels of the weather driver -----------------------
WEATHER_LEVELS: dict[str, str] = {
    "average": "average_weather_days",
    "better than average": "better_than_average_weather_days",
    "worse than average": "worse_than_average_weather_days",
}
# -------------------------------------------------------------------------------


def product_count(panel: DataFrame, key: str = "product_id") -> DataFrame:
    """A1 exact distinct count of series keys."""
    return panel.agg(F.countDistinct(key).alias("n_products"))


def with_total(panel: DataFrame, key: str = "product_id", date: str = "date",
               measures: Sequence[str] = ("sessions", "bookings"), label: str = "Total") -> DataFrame:
    """A4 detail rows plus one synthetic key ``label`` holding the per-date sum.

    The per-date sum is a second aggregate over the same input; Spark reuses the
    input's exchange (ReusedExchange) instead of scanning twice."""
    return panel.select(key, date, *measures).unionByName(total_series(panel, key, date, measures, label))


def total_series(panel: DataFrame, key: str = "product_id", date: str = "date",
                 measures: Sequence[str] = ("sessions", "bookings"), label: str = "Total") -> DataFrame:
    """A4 the synthetic key ``label`` alone; a product of that name is not mixed in."""
    total = panel.groupBy(date).agg(*[F.sum(m).alias(m) for m in measures])
    return total.select(F.lit(label).alias(key), date, *measures)


def join_drivers(panel: DataFrame, meta: DataFrame, date: str = "date",
                 max_rows: int = MAX_BROADCAST_ROWS, materialise: bool = True) -> DataFrame:
    """J1 left join of every panel row to the shared driver series on the date.

    The driver series has one row per date; it is broadcast after a checked
    count, so the panel is not shuffled for this join (``materialise=False``
    when the caller passes an already materialised series)."""
    return panel.join(bounded_broadcast(meta, max_rows, materialise=materialise), on=date, how="left")


def one_hot(df: DataFrame, col: str, levels: dict[str, str] | Sequence[str],
            drop: bool = False) -> DataFrame:
    """R1 0/1 column per known level; a NULL or unknown category gives 0 in all."""
    if not isinstance(levels, dict):
        levels = {v: v for v in levels}
    out = df.withColumns({name: F.when(F.col(col) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
                          for v, name in levels.items()})
    return out.drop(col) if drop else out


def weather_onehot(df: DataFrame, col: str = "weather_index", drop: bool = False) -> DataFrame:
    return one_hot(df, col, WEATHER_LEVELS, drop=drop)


def event_dummy(df: DataFrame, name: str, dates: Sequence[_dt.date | str], date: str = "date",
                market_col: str | None = None, markets: Sequence[str] | None = None) -> DataFrame:
    """J5 0/1 event flag: event dates (optionally repeated for each market) left
    joined on (date[, market]); rows with no event get 0.

    The event table is built from the two given lists, so its size is
    len(dates) x len(markets); it is broadcast after a checked count."""
    spark = df.sparkSession
    ds = [_dt.date.fromisoformat(d) if isinstance(d, str) else d for d in dates]
    ev = spark.createDataFrame([(d,) for d in ds], T.StructType([T.StructField(date, T.DateType())]))
    keys = [date]
    if market_col is not None and markets is not None:
        ev = ev.withColumn(market_col, F.explode(F.array(*[F.lit(str(m)) for m in markets])))
        keys.append(market_col)
    ev = ev.dropDuplicates(keys).withColumn(name, F.lit(1.0))
    out = df.join(bounded_broadcast(ev, materialise=False), on=keys, how="left")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def with_market(panel: DataFrame, markets: DataFrame, key: str = "product_id", market: str = "market",
                max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The panel with each series' market from ``markets`` (key, market), one row per
    series; a series without one keeps its rows with a NULL market.  The table grows
    with the series, so it is broadcast only after a checked count."""
    one = markets.groupBy(key).agg(F.min(market).alias(market))
    return panel.join(bounded_broadcast(one, max_rows), on=key, how="left")


def lead_product(panel: DataFrame, measure: str = "sessions", key: str = "product_id") -> DataFrame:
    """The series with the largest total of ``measure``, one row (ties: the smaller id)."""
    totals = panel.groupBy(key).agg(F.sum(measure).alias("total"))
    return totals.orderBy(F.desc_nulls_last("total"), F.asc(key)).limit(1)


def daily_totals(panel: DataFrame, date: str = "date",
                 measures: Sequence[str] = ("sessions", "bookings")) -> DataFrame:
    """A2 sum of each measure per date."""
    return panel.groupBy(date).agg(*[F.sum(m).alias(m) for m in measures])


def daily_conversion_long(panel: DataFrame, date: str = "date") -> DataFrame:
    """V2 long: (date, metric, value) of both sums and of their ratio; a day without
    sessions keeps its row with a NULL rate."""
    return to_long(daily_conversion(panel, date), [date], ["sessions", "bookings", "conv_rate"])


def daily_conversion(panel: DataFrame, date: str = "date") -> DataFrame:
    """V2 / A5 per-date sums and the conversion rate as a ratio OF SUMS."""
    d = daily_totals(panel, date)
    return d.withColumn("conv_rate", safe_div("bookings", "sessions"))


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "metric",
            val: str = "value", cast: str | None = "double") -> DataFrame:
    """R2 wide -> long (unpivot); values are cast to one type first."""
    if cast:
        df = df.withColumns({c: F.col(c).cast(cast) for c in values})
    return df.unpivot(list(ids), list(values), var, val)


def product_totals(panel: DataFrame, key: str = "product_id",
                   measures: Sequence[str] = ("sessions", "bookings")) -> DataFrame:
    """A3 totals per key."""
    return panel.groupBy(key).agg(*[F.sum(m).alias(m) for m in measures])


def date_bounds(df: DataFrame, date: str = "date") -> DataFrame:
    """A12 global first and last date (a one-row frame; join it, don't collect it)."""
    return df.agg(F.min(date).alias("date_from"), F.max(date).alias("date_to"))


def profile(df: DataFrame) -> DataFrame:
    """A15 dataset profile: per column, row count, non-null and null counts."""
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(F.col(c)).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    long = wide.unpivot(["__n"], df.columns, "column_name", "n_non_null")
    return long.select(
        "column_name",
        F.col("__n").alias("n_rows"),
        F.col("n_non_null"),
        (F.col("__n") - F.col("n_non_null")).alias("n_null"),
    )


def filter_products(df: DataFrame, ids, key: str = "product_id") -> DataFrame:
    """P7 / P8 keep the listed series; numeric ids are compared as text (ids are strings)."""
    ids = [ids] if isinstance(ids, (str, int)) else list(ids)
    return df.filter(F.col(key).isin([str(i) for i in ids]))


def preview(df: DataFrame, order: Sequence[str], n: int = 6) -> DataFrame:
    """O1 the first n rows in key order (a deterministic head)."""
    return df.orderBy(*order).limit(n)


def union_all(*dfs: DataFrame) -> DataFrame:
    """O3 union by name; columns missing on one side become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
