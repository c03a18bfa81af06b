"""The engine's two input views, derived from the driver's parquet tables.

``product_series``  (product_id string, date date, sessions bigint, bookings bigint)
    one series per supplier: lineitem aggregated by (supplier, ship date).
``meta_series``     (date date, tv_ad_reach, consumer_confidence_index, exchange_rate,
                     online_visibility double, weather_index string)
    one row per order date: the driver series shared by every product.

Both are plain aggregations whose scan reads only the referenced columns.  The
driver series is combined inside each task before anything moves.  The product
series has nearly as many rows as lineitem, so combining first saves little: its
rows are dealt by (supplier, day) to a number of tasks that grows with them, each
with a table of the same size, and a hot supplier is spread over its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: lineitem rows a task of the series operators holds, about
TASK_ROWS = 200_000


def series_parts(spark: SparkSession, sf_dir: str, rows_per_task: int = TASK_ROWS) -> int:
    """Tasks that the product series are dealt to: one for every ``rows_per_task`` rows
    of lineitem (the series have no more rows), rounded up to whole waves of the
    cores, so that a task's sorts stay the same size however large the table is.
    The count is read from the Parquet footers."""
    rows, cores = read_table(spark, sf_dir, "lineitem").count(), spark.sparkContext.defaultParallelism
    return cores * max(1, -(-rows // (rows_per_task * cores)))


def product_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("product_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        "l_quantity",
    )
    return (
        rows.repartition(series_parts(spark, sf_dir), "product_id", "date")
        .groupBy("product_id", "date")
        .agg(
            F.sum("l_quantity").cast("bigint").alias("sessions"),
            F.count(F.lit(1)).alias("bookings"),
        )
    )


def product_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, market): a series' market is its supplier's nation."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("product_id"), "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("market"))
    return s.join(n, on="s_nationkey", how="left").select("product_id", "market")


def meta_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    weather_code = F.pmod(F.min("o_orderkey"), F.lit(3))
    return (
        o.groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(
            (F.coalesce(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", price)), F.lit(0.0))
             / 1000.0).alias("tv_ad_reach"),
            (F.avg(price) / 1000.0).alias("consumer_confidence_index"),
            (F.avg(F.when(F.col("o_orderstatus") == "F", price)) / 1000.0).alias("exchange_rate"),
            F.count(F.lit(1)).cast("double").alias("online_visibility"),
            F.when(weather_code == 0, "average")
             .when(weather_code == 1, "better than average")
             .otherwise("worse than average").alias("weather_index"),
        )
    )


# --- fixed values: term -> driver-group dictionary and group order -------------
# Term names follow this engine's snake_case columns; the grouping is the
# reference's 24-row dictionary (Date/Product/Dep_Var rows kept for completeness).
TERM_GROUPS: dict[str, str] = {
    "date": "Date",
    "product_id": "Product",
    "dep_var": "Dep_Var",
    "bookings": "Dep_Var",
    "day": "Seasonality",
    "day_friday": "Seasonality",
    "day_saturday": "Seasonality",
    "day_sunday": "Seasonality",
    "month": "Seasonality",
    "tv_adstock": "TV",
    "xmas": "Seasonality",
    "consumer_confidence_index": "Consumer_Confidence",
    "exchange_rate": "Exchange_Rate",
    "exchange_rate_moving_av": "Exchange_Rate",
    "online_visibility": "Online_Visibility",
    "average_weather_days": "Weather",
    "better_than_average_weather_days": "Weather",
    "worse_than_average_weather_days": "Weather",
    "day_monday": "Seasonality",
    "day_tuesday": "Seasonality",
    "day_wednesday": "Seasonality",
    "day_thursday": "Seasonality",
    "intercept": "Base_Sales",
    "online_visibility_exp": "Online_Visibility",
}

# The seven driver groups, alphabetical (the order a pivot produces) ...
DRIVER_GROUPS: tuple[str, ...] = (
    "Base_Sales", "Consumer_Confidence", "Exchange_Rate", "Online_Visibility",
    "Seasonality", "TV", "Weather",
)
# ... and the display order used for stacking.
DRIVER_ORDER: tuple[str, ...] = (
    "TV", "Online_Visibility", "Exchange_Rate", "Weather", "Seasonality",
    "Consumer_Confidence", "Base_Sales",
)
# -------------------------------------------------------------------------------


def variable_groupings(spark: SparkSession) -> DataFrame:
    """The term -> group dictionary as a 24-row DataFrame (J2's right side)."""
    schema = T.StructType([
        T.StructField("var_name", T.StringType(), False),
        T.StructField("grouping", T.StringType(), False),
    ])
    return spark.createDataFrame(list(TERM_GROUPS.items()), schema)
