"""Scoring every product model on the forecast horizon.

The horizon is the driver series from ``HORIZON_FROM`` on: one row per date,
broadcast after a checked count.  Each model row is expanded to its horizon
dates with ``sequence`` + ``explode`` (output-sized, no cross join) and then
equi-joined to the horizon features on the date.  Both targets are scored in
one pass: the two model tables are joined on product_id first (one row per
product each), so the large product x date output is never joined again.

scale='train' (default) scales each term with the product's own training mean
and SD kept in the model row, the way the model was fitted; scale='horizon'
uses horizon features z-scored over the whole driver series, TV included.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.operators.features import KEY, DATE, ModelSpec, HORIZON_FROM, horizon_features
from mixlens.operators.joins import bounded_broadcast
from mixlens.operators.panel import weather_onehot, to_long


def horizon_terms(*specs: ModelSpec) -> tuple[str, ...]:
    seen: list[str] = []
    for s in specs:
        for t in s.terms:
            if t not in seen:
                seen.append(t)
    return tuple(seen)


def horizon_frame(meta: DataFrame, specs: tuple[ModelSpec, ...], scale: str = "train",
                  horizon_from: _dt.date | None = HORIZON_FROM) -> DataFrame:
    """M18 horizon features for every term any of ``specs`` uses."""
    return horizon_features(weather_onehot(meta), specs[0], horizon_from=horizon_from,
                            scale="horizon" if scale == "horizon" else "none",
                            terms=horizon_terms(*specs))


ROWS_PER_TASK = 50_000     # forecast rows that one task makes, about


def _model_columns(spec: ModelSpec, prefix: str):
    """One model row as plain columns, so that the models x days rows read numbers and
    not lists (with lists the generated code is too long for the JVM to compile):
    coefficients (0 where NULL), means (NULL where the SD is NULL or 0, so the
    scaled term is NULL) and SDs."""
    coef = F.col("coef")
    out = [coef.isNotNull().alias(f"{prefix}known")]
    for i, t in enumerate(spec.all_terms):
        out.append(F.coalesce(coef[i], F.lit(0.0)).alias(f"{prefix}b{i}"))
        if t in spec.scaled_terms():
            sd = F.col("scale_sd")[i]
            out.append(F.when(sd != 0, F.col("scale_mean")[i]).alias(f"{prefix}m{i}"))
            out.append(F.when(sd != 0, sd).otherwise(F.lit(1.0)).alias(f"{prefix}s{i}"))
    return out


def _prediction(spec: ModelSpec, prefix: str, scale: str):
    scaled = spec.scaled_terms()
    out = F.col(f"{prefix}b0")
    for i, t in enumerate(spec.all_terms[1:], start=1):
        x = F.col(t)
        if scale == "train" and t in scaled:
            x = F.coalesce((x - F.col(f"{prefix}m{i}")) / F.col(f"{prefix}s{i}"), F.lit(0.0))
        out = out + F.col(f"{prefix}b{i}") * x
    return F.when(F.col(f"{prefix}known"), out)


def forecast(models: dict[str, tuple[DataFrame, ModelSpec]], meta: DataFrame, scale: str = "train",
             horizon_from: _dt.date = HORIZON_FROM) -> DataFrame:
    """M19 + M20 wide forecast (product_id, date, <one column per target>).

    ``models`` maps target -> (model table, spec); the first target's products
    drive the rows (a left join, as the reference joins its two forecasts)."""
    targets = list(models)
    specs = tuple(models[t][1] for t in targets)
    horizon = horizon_frame(meta, specs, scale, horizon_from)
    h = bounded_broadcast(horizon)
    bounds = h.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi")).first()
    table = None
    for t in targets:
        m = models[t][0].filter(F.col("status") == "ok").select(KEY, *_model_columns(models[t][1], f"{t}__"))
        table = m if table is None else table.join(m, on=KEY, how="left")
    if bounds is None or bounds.lo is None:
        expanded = table.withColumn(DATE, F.lit(None).cast("date")).limit(0)
    else:
        # a compact model table becomes models x days rows: deal the models out first
        days = (bounds.hi - bounds.lo).days + 1
        parts = max(1, -(-table.count() * days // ROWS_PER_TASK))
        expanded = table.repartition(parts, KEY).withColumn(
            DATE, F.explode(F.sequence(F.lit(bounds.lo), F.lit(bounds.hi))))
    j = expanded.join(h, on=DATE, how="inner")
    return j.select(KEY, DATE, *[_prediction(models[t][1], f"{t}__", scale).alias(t) for t in targets])


def forecast_long(wide: DataFrame, targets: tuple[str, ...] = ("sessions", "bookings")) -> DataFrame:
    """M19 long: (product_id, date, target, prediction)."""
    return to_long(wide, [KEY, DATE], list(targets), "target", "prediction")


def actual_plus_forecast(panel_train: DataFrame, wide: DataFrame) -> DataFrame:
    """O4 actuals and forecasts stacked with a ``kind`` column."""
    act = panel_train.select(KEY, DATE, F.col("sessions").cast("double").alias("sessions"),
                             F.col("bookings").cast("double").alias("bookings"),
                             F.lit("actual").alias("kind"))
    fc = wide.select(KEY, DATE, "sessions", "bookings", F.lit("forecast").alias("kind"))
    return act.unionByName(fc)


def scaled_drivers_long(meta: DataFrame, spec: ModelSpec) -> DataFrame:
    """V9 every driver term z-scored over the whole driver series, long, weekday
    flags left out."""
    terms = tuple(t for t in spec.terms if not t.startswith("day_"))
    h = horizon_features(weather_onehot(meta), spec, horizon_from=None, scale="horizon", terms=terms)
    return to_long(h, [DATE], list(terms), "variable", "value")
