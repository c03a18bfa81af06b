"""Driver contributions.

contribution of a term = term value x its coefficient, per (product, date);
terms add up to driver groups through the term -> group dictionary; the six
non-base groups are smoothed with a centred 7-row mean; three groups are
re-based to start at zero with their minima moved into Base_Sales.

Everything is per product and ordered by date, so the whole chain runs over the
design's existing hash partitioning on product_id: the group sums are column
expressions (the dictionary is fixed), the smoothing and re-basing are windows
on the same spec, and only the final roll-ups (year, week, product) aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.functions.scalar import week_commencing
from mixlens.operators import series as S
from mixlens.operators.joins import bounded_broadcast
from mixlens.operators.features import KEY, DATE, ModelSpec, SMOOTH_WINDOW
from mixlens.operators.regression import complete_cases, with_models
from mixlens.sources.tables import TERM_GROUPS, DRIVER_GROUPS, DRIVER_ORDER

BASE = "Base_Sales"
# --- fixed values: groups whose minimum is moved into the base --------------------
REBASE_GROUPS: tuple[str, ...] = ("Consumer_Confidence", "Exchange_Rate", "Online_Visibility")
# ----------------------------------------------------------------------------------


def _term_values(spec: ModelSpec):
    return [F.lit(1.0)] + [F.col(t).cast("double") for t in spec.terms]


def term_contributions(scaled: DataFrame, models: DataFrame, spec: ModelSpec) -> DataFrame:
    """M9 long: (product_id, date, var_name, value) = term value x coefficient."""
    d = with_models(complete_cases(scaled, spec), models)
    x = _term_values(spec)
    items = [F.struct(F.lit(t).alias("var_name"),
                      (F.coalesce(F.col("coef")[i], F.lit(0.0)) * x[i]).alias("value"))
             for i, t in enumerate(spec.all_terms)]
    return d.select(KEY, DATE, F.explode(F.array(*items)).alias("c")).select(KEY, DATE, "c.var_name", "c.value")


def group_terms(term_long: DataFrame, dictionary: DataFrame) -> DataFrame:
    """J2 + A8 the dictionary join: sum term contributions per (product, date, group).
    A term missing from the dictionary keeps a NULL group (reported, not dropped)."""
    j = term_long.join(bounded_broadcast(dictionary, materialise=False), on="var_name", how="left")
    return j.groupBy(KEY, DATE, F.col("grouping").alias("driver_group")).agg(F.sum("value").alias("value"))


def grouped_wide(scaled: DataFrame, models: DataFrame, spec: ModelSpec,
                 term_groups: dict[str, str] | None = None) -> DataFrame:
    """A8 + R3 without a shuffle: one column per driver group (sum of its terms)."""
    groups = term_groups or TERM_GROUPS
    d = with_models(complete_cases(scaled, spec), models)
    x = _term_values(spec)
    sums: dict[str, list] = {g: [] for g in DRIVER_GROUPS}
    for i, t in enumerate(spec.all_terms):
        sums[groups[t]].append(F.coalesce(F.col("coef")[i], F.lit(0.0)) * x[i])
    cols = []
    for g in DRIVER_GROUPS:
        parts = sums[g]
        expr = F.lit(0.0)
        if parts:
            expr = parts[0]
            for p in parts[1:]:
                expr = expr + p
        cols.append(expr.alias(g))
    return d.select(KEY, DATE, *cols)


def contribution_wide(scaled: DataFrame, models: DataFrame, spec: ModelSpec,
                      smooth: int | None = SMOOTH_WINDOW,
                      rebase_groups: Sequence[str] = REBASE_GROUPS,
                      term_groups: dict[str, str] | None = None) -> DataFrame:
    """M10 daily driver contributions, wide: smoothed (W4) and re-based."""
    wide = grouped_wide(scaled, models, spec, term_groups)
    if smooth:
        others = [g for g in DRIVER_GROUPS if g != BASE]
        wide = S.rolling_mean_center(wide, others, smooth, by=KEY, order=DATE)
    if rebase_groups:
        wide = S.rebase(wide, list(rebase_groups), BASE, by=KEY)
    return wide


def _order_col(col: str = "driver_group"):
    m = F.create_map(*[x for i, g in enumerate(DRIVER_ORDER) for x in (F.lit(g), F.lit(i + 1))])
    return m[F.col(col)].cast("bigint").alias("driver_order")


def to_long(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """R2 + R6 long (ids..., driver_group, value, driver_order)."""
    long = wide.unpivot(list(ids), list(DRIVER_GROUPS), "driver_group", "value")
    return long.select(*ids, "driver_group", "value", _order_col())


def contribution_daily(scaled, models, spec, **kw) -> DataFrame:
    return to_long(contribution_wide(scaled, models, spec, **kw), [KEY, DATE])


def contribution_annual(scaled, models, spec, **kw) -> DataFrame:
    """A9 per (product, year) sum of each driver."""
    w = contribution_wide(scaled, models, spec, **kw)
    y = w.groupBy(KEY, F.year(DATE).cast("bigint").alias("year")).agg(*[F.sum(g).alias(g) for g in DRIVER_GROUPS])
    return to_long(y, [KEY, "year"])


def contribution_weekly(scaled, models, spec, **kw) -> DataFrame:
    """A14 per (product, week commencing) sum of each driver."""
    w = contribution_wide(scaled, models, spec, **kw)
    y = w.groupBy(KEY, week_commencing(DATE).alias("week_commencing")).agg(
        *[F.sum(g).alias(g) for g in DRIVER_GROUPS])
    return to_long(y, [KEY, "week_commencing"])


def contribution_by_product_wide(scaled, models, spec, **kw) -> DataFrame:
    """A10 / M11 total contribution of each driver per product, wide (the
    product x driver matrix, built from the long data, never transposed)."""
    w = contribution_wide(scaled, models, spec, **kw)
    return w.groupBy(KEY).agg(*[F.sum(g).alias(g) for g in DRIVER_GROUPS])


def contribution_by_product(scaled, models, spec, **kw) -> DataFrame:
    return to_long(contribution_by_product_wide(scaled, models, spec, **kw), [KEY])


def contribution_rollups(scaled, models, spec, **kw) -> DataFrame:
    """A9, A10 and A14 from one pass over one smoothed frame (grouping sets):
    (product_id, level, year, week_commencing, driver_group, value, driver_order),
    level ``year``, ``week`` or ``product``; a level's other keys are NULL."""
    w = contribution_wide(scaled, models, spec, **kw).withColumns({
        "year": F.year(DATE).cast("bigint"), "week_commencing": week_commencing(DATE)})
    sets = [[F.col(KEY), F.col("year")], [F.col(KEY), F.col("week_commencing")], [F.col(KEY)]]
    sums = w.groupingSets(sets, F.col(KEY), F.col("year"), F.col("week_commencing")).agg(
        F.grouping("year").alias("no_year"), F.grouping("week_commencing").alias("no_week"),
        *[F.sum(g).alias(g) for g in DRIVER_GROUPS])
    level = F.when(F.col("no_year") == 0, "year").when(F.col("no_week") == 0, "week").otherwise("product")
    return to_long(sums.withColumn("level", level), [KEY, "level", "year", "week_commencing"])


def contribution_share(scaled, models, spec, **kw) -> DataFrame:
    """W10 each driver's signed share of the product's total (V7)."""
    long = contribution_by_product(scaled, models, spec, **kw)
    return S.signed_share(long, "value", by=KEY, out="share")
