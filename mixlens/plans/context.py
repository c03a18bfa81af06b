"""Shared plan pieces: the input views every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.operators import panel as P
from mixlens.operators.features import KEY, TRAIN_TO, DATE
from mixlens.session import cut_lineage
from mixlens.sources.tables import product_series, meta_series, series_parts


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_series(spark, sf_dir)


def panel_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).filter(F.col(DATE) <= F.lit(TRAIN_TO))


def meta(spark: SparkSession, sf_dir: str, materialise: bool = False) -> DataFrame:
    """The driver series; ``materialise`` writes it once for plans that use it twice."""
    m = meta_series(spark, sf_dir)
    return cut_lineage(m) if materialise else m


def panel_drivers(spark: SparkSession, sf_dir: str, total: bool = False,
                  materialise: bool = False, drivers: DataFrame | None = None,
                  products: list[str] | None = None) -> DataFrame:
    """Training panel (optionally with the Total layer) joined to the drivers,
    one-hot weather.  ``materialise`` writes it once to the checkpoint folder
    for plans that read it more than once (e.g. two model fits); ``drivers``
    passes in a driver series the caller already materialised; ``products`` keeps
    the listed series alone (P7)."""
    p = panel_train(spark, sf_dir)
    if products is not None:
        p = P.filter_products(p, products)
    if total:
        p = P.with_total(p)
    if drivers is None:
        out = P.weather_onehot(P.join_drivers(p, meta(spark, sf_dir)))
    else:
        out = P.weather_onehot(P.join_drivers(p, drivers, materialise=False))
    return cut_lineage(out) if materialise else out


def panel_by_product(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """``panel_drivers`` dealt out by product to ``series_parts`` tasks: the exchange that
    every window by product needs, of a number of tasks that grows with the rows.
    (Left to itself Spark merges them to about one a core, whatever they hold.)"""
    return panel_drivers(spark, sf_dir, **kw).repartition(series_parts(spark, sf_dir), KEY)


def panel_train_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``panel_train`` dealt out by product in the same way."""
    return panel_train(spark, sf_dir).repartition(series_parts(spark, sf_dir), KEY)


def total_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Total series alone, joined to the drivers: one aggregate by date over one scan."""
    return P.weather_onehot(P.join_drivers(P.total_series(panel_train(spark, sf_dir)), meta(spark, sf_dir)))


def rounded(df: DataFrame, digits: int = 8, finest: int = 9, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column for value comparison across engines, but for the
    parameters named in ``keep``, which are the same doubles everywhere.

    Steps, each evaluated identically by Spark and DuckDB on the same double:
    snap to a 2^-24 grid (decimal data never sits exactly on a binary
    half-step, so exact decimal ties cannot split), then keep ``digits``
    significant digits but nothing finer than 10^-``finest`` (noise around an
    exact zero rounds to 0).  Rounding to a step far coarser than the
    summation-order noise makes a split between two engines very unlikely;
    the step is applied with exact powers of ten and ``rint`` (IEEE
    round-half-even on the double, what DuckDB's ``round_even`` does; Spark's
    ``round`` would go through BigDecimal).  + 0.0 turns -0.0 into 0.0."""
    grid = float(2 ** 24)
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float") and f.name not in keep]
    if not doubles:
        return df
    # step 1: the snapped value and its exponent, computed once per column
    pre = []
    for f in df.schema.fields:
        if f.name in doubles:
            v = F.rint(F.col(f.name) * grid) / grid
            pre.append(v.alias(f"__v_{f.name}"))
        else:
            pre.append(F.col(f.name))
    df = df.select(*pre)
    df = df.select(*df.columns, *[
        F.greatest(F.floor(F.log10(F.abs(F.col(f"__v_{c}")))) - (digits - 1), F.lit(-finest)).alias(f"__e_{c}")
        for c in doubles])
    # step 2: keep the significant digits with exact powers of ten, each computed once
    df = df.select(*df.columns, *[F.pow(F.lit(10.0), F.abs(F.col(f"__e_{c}"))).alias(f"__p_{c}") for c in doubles])
    cols = []
    for f in df.schema.fields:
        if f.name.startswith(("__v_", "__e_", "__p_")):
            continue
        cols.append(F.col(f.name))
    for c in doubles:
        v, e, p = F.col(f"__v_{c}"), F.col(f"__e_{c}"), F.col(f"__p_{c}")
        r = (F.when(v == 0, F.lit(0.0))
             .when(e < 0, F.rint(v * p) / p)
             .otherwise(F.rint(v / p) * p))
        cols.append((r + F.lit(0.0)).alias(c))
    order = [f.name for f in df.schema.fields if not f.name.startswith(("__e_", "__p_"))]
    order = [n[4:] if n.startswith("__v_") else n for n in order]
    return df.select(*cols).select(*order)

