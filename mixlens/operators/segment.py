"""Product segmentation.

Per-product statistics are one grouped aggregate; the feature matrix is a
join of two one-row-per-product tables; scaling is an MLlib stage; k-means
starts from centres fixed by the data and takes Lloyd steps as aggregates of
whole numbers, so labels do not depend on partitioning (only the k centres
travel to the driver).  Cluster labels are made canonical: clusters
sorted by size, descending, ties by smallest product id -> type_1, type_2 ...
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlens.functions.scalar import safe_div, type_label
from mixlens.operators.contribution import BASE
from mixlens.operators.features import KEY, DATE, UPLIFT_YEARS
from mixlens.session import cut_lineage
from mixlens.sources.tables import DRIVER_GROUPS

STAT_COLS = ("n_total_sessions", "n_total_bookings", "sd_total_sessions", "sd_total_bookings",
             "av_conv_rate", "uplift")
RATIO_COLS = tuple(g for g in DRIVER_GROUPS if g != BASE)
FEATURE_COLS = RATIO_COLS + STAT_COLS


def uplift_expr(years: tuple[int, int] = UPLIFT_YEARS):
    """A7 sum(sessions in year a) / sum(sessions in year b); an empty year sums to 0."""
    a, b = years
    num = F.sum(F.when(F.year(DATE) == a, F.col("sessions")).otherwise(F.lit(0)))
    den = F.sum(F.when(F.year(DATE) == b, F.col("sessions")).otherwise(F.lit(0)))
    return safe_div(num, den)


def product_stats(panel: DataFrame, years: tuple[int, int] = UPLIFT_YEARS) -> DataFrame:
    """A6 volume, volatility (sample SD), mean of DAILY conversion ratios (a 0/0
    or x/0 day is NULL and skipped) and the A7 uplift, per product."""
    return panel.groupBy(KEY).agg(
        F.sum("sessions").cast("double").alias("n_total_sessions"),
        F.sum("bookings").cast("double").alias("n_total_bookings"),
        F.stddev_samp("sessions").alias("sd_total_sessions"),
        F.stddev_samp("bookings").alias("sd_total_bookings"),
        F.avg(safe_div("bookings", "sessions")).alias("av_conv_rate"),
        uplift_expr(years).alias("uplift"),
    )


def driver_ratios(contrib_by_product_wide: DataFrame) -> DataFrame:
    """M12 each non-base driver's total over the base total, per product."""
    return contrib_by_product_wide.select(KEY, *[safe_div(g, BASE).alias(g) for g in RATIO_COLS])


def segment_table(contrib_by_product_wide: DataFrame, stats: DataFrame) -> DataFrame:
    """M13 (unscaled half): 6 driver ratios + 6 statistics per product."""
    return driver_ratios(contrib_by_product_wide).join(stats, on=KEY, how="left")


def scale_features(table: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """M13 z-score across products (sample SD) with MLlib, over the products that
    have every feature; ``scaled_columns`` lists the others with a reason."""
    va = VectorAssembler(inputCols=list(cols), outputCol="raw", handleInvalid="skip")
    v = va.transform(table.select(KEY, *cols))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(v)
    return scaler.transform(v).select(KEY, "features")


def missing_reason(cols: Sequence[str] = FEATURE_COLS):
    """``null_feature`` for a product that lacks a feature, else NULL."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    return F.when(~whole, F.lit("null_feature"))


def scaled_columns(table: DataFrame, scaled: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """(product_id, features..., reason): every product of ``table``; one that lacks
    a feature has no z-scores and a reason."""
    arr = vector_to_array("features")
    wide = scaled.select(KEY, *[arr[i].alias(c) for i, c in enumerate(cols)])
    return table.select(KEY, missing_reason(cols).alias("reason")).join(wide, on=KEY, how="left").select(KEY, *cols, "reason")


GRID = 1_000_000           # features are compared and summed as whole multiples of 1e-6
MAX_STEPS = 200            # Lloyd steps at most; what has not settled by then is reported as such


def _points(scaled: DataFrame) -> DataFrame:
    """(product_id, x): features on the grid, so that no sum depends on row order
    and no comparison on the last bits of a double."""
    x = F.transform(vector_to_array("features"), lambda v: F.rint(v * GRID).cast("bigint"))
    return scaled.select(KEY, x.alias("x"))


def _square(x, centre):
    """Squared distance in grid units; exact as long as it is below 2^53."""
    return F.aggregate(F.zip_with(x, centre, lambda p, q: (p - q).cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def _held(value, kind: str):
    """Centres as one constant of the plan: the generated code is the same for every step."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _nearest(centres):
    """(square, cluster) of the nearest centre; ties go to the smaller cluster."""
    return F.array_min(F.transform(centres, lambda c, j: F.struct(_square(F.col("x"), c).alias("square"), j.alias("cluster"))))


def starting_centres(points: DataFrame, k: int) -> list[list[int]]:
    """Up to k centres fixed by the data: the point farthest from the overall mean
    (the origin, as features are z-scores), then again and again the point
    farthest from the centres so far; ties go to the smaller product_id.  Fewer
    if the points are fewer.  The first j of them are the centres for j."""
    first = points.select("x").first()
    centres: list[list[int]] = []
    if first is None:
        return centres
    for _ in range(k):
        near = _nearest(_held(centres or [[0] * len(first.x)], "array<array<bigint>>"))["square"]
        best = points.select("x", near.alias("d"), KEY).orderBy(F.desc("d"), F.asc(KEY)).first()
        if centres and best.d <= 0:
            break
        centres.append(list(best.x))
    return centres


@dataclass(frozen=True)
class KMeansFit:
    """Centres in grid units, total within SS in feature units, and whether the last step moved no centre."""
    centres: list[list[int]]
    cost: float
    converged: bool


def lloyd(points: DataFrame, starts: dict[int, list[list[int]]], max_steps: int = MAX_STEPS) -> dict[int, KMeansFit]:
    """k-means from given centres for several k at once.  A step assigns every
    point to its nearest centre and moves each centre to the mean of its points
    (rounded to the grid, halves away from zero); a centre without points stays.
    One aggregate a step serves every k still moving: whole-number sums per
    (k, cluster), combined inside each task, so the exchange and the driver see
    at most sum(k) short rows and the result is the same for every partitioning."""
    done: dict[int, KMeansFit] = {}
    now = {k: [list(c) for c in centres] for k, centres in starts.items()}
    for step in range(max_steps):
        if not now:
            break
        dims = range(len(next(iter(now.values()))[0]))
        held = _held([{"k": k, "centres": c} for k, c in now.items()], "array<struct<k:int,centres:array<array<bigint>>>>")
        rows = (points.select("x", F.explode(held).alias("fit")).select("x", "fit.k", _nearest(F.col("fit.centres")).alias("to"))
                .groupBy("k", F.col("to.cluster").alias("cluster"))
                .agg(F.count("*").alias("n"), F.sum(F.col("to.square").cast("decimal(38,0)")).alias("cost"),
                     *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in dims]).collect())
        moved = {k: [list(c) for c in centres] for k, centres in now.items()}
        cost = dict.fromkeys(now, 0)
        for r in rows:
            cost[r.k] += int(r.cost)
            for i in dims:
                total = int(r[f"s{i}"])
                half_up = (2 * abs(total) + r.n) // (2 * r.n)
                moved[r.k][r.cluster][i] = half_up if total >= 0 else -half_up
        for k in list(now):
            settled = moved[k] == now[k]
            if settled or step == max_steps - 1:
                done[k] = KMeansFit(now.pop(k), cost[k] / (GRID * GRID), settled)
            else:
                now[k] = moved[k]
    return done


def _status(fit: KMeansFit) -> str:
    return "ok" if fit.converged else "not_converged"


def elbow(scaled: DataFrame, ks: Sequence[int] = range(1, 16)) -> DataFrame:
    """M14 total within-cluster sum of squares for every k asked for; NULL with a
    status where there are fewer distinct products than k."""
    points = cut_lineage(_points(scaled))
    ks = sorted({int(k) for k in ks})
    starts = starting_centres(points, max(ks))
    fits = lloyd(points, {k: starts[:k] for k in ks if k <= len(starts)})
    rows = [(k, fits[k].cost, _status(fits[k])) if k in fits else (k, None, "too_few_products") for k in ks]
    return scaled.sparkSession.createDataFrame(rows, "k bigint, tot_withinss double, status string")


def cluster(scaled: DataFrame, k: int = 3) -> DataFrame:
    """M15 + M16 k-means and canonical labels: (product_id, product_type, status).
    Status ``fewer_clusters``: there are not k distinct products."""
    points = cut_lineage(_points(scaled))
    starts = starting_centres(points, k)
    if not starts:
        none = F.lit(None).cast("string")
        return scaled.select(KEY, none.alias("product_type"), none.alias("status"))
    fit = lloyd(points, {len(starts): starts})[len(starts)]
    pred = points.select(KEY, _nearest(_held(fit.centres, "array<array<bigint>>"))["cluster"].alias("cluster"))
    sizes = pred.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min(KEY).alias("first_id"))
    # k rows: the ordering window over them is trivially small
    ranked = sizes.select("cluster", F.row_number().over(
        Window.orderBy(F.desc("size"), F.asc("first_id"))).alias("label"))
    status = _status(fit) if len(starts) == k else "fewer_clusters"
    return pred.join(F.broadcast(ranked), on="cluster").select(
        KEY, type_label("label").alias("product_type"), F.lit(status).alias("status"))


def with_unclustered(table: DataFrame, groupings: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """(product_id, product_type, status): every product of ``table``; one that has
    a NULL feature has no type and the status ``null_feature``."""
    return (table.select(KEY, missing_reason(cols).alias("reason")).join(groupings, on=KEY, how="left")
            .select(KEY, "product_type", F.coalesce("reason", "status").alias("status")))


def cluster_profile(table: DataFrame, groupings: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """M17 mean of each (unscaled) feature per segment."""
    j = table.join(groupings.select(KEY, "product_type"), on=KEY, how="inner")
    return j.groupBy("product_type").agg(F.count(F.lit(1)).alias("n_products"),
                                         *[F.avg(c).alias(c) for c in cols])


def answer_sheet(product_ids: DataFrame, groupings: DataFrame) -> DataFrame:
    """S7 every listed product exactly once, with its segment (NULL if none)."""
    return product_ids.select(KEY).distinct().join(groupings.select(KEY, "product_type"), on=KEY, how="left")
