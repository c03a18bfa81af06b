"""M22 transform search: which adstock rate, exchange-rate transform and
visibility power fit each product best (full multi-term models, ranked by RMSE).

Scale design: every candidate transform is computed once as its own column
(16 columns: intercept, 6 shared terms, 4 adstock rates, 2 exchange-rate
transforms, 3 visibility powers), and ONE grouped aggregate builds each
product's Gram matrix over that superset.  Every candidate's normal equations
are a sub-matrix of it, so the 24 fits per product are solved from one row: the
systems of an Arrow batch are swept together along a tree of 43 sweeps (7 shared
terms, 4 rates, 8 exchange transforms, 24 powers); the data rows are never
multiplied by the candidate count.
A second pass sums each candidate's squared residuals in-row (24 sums per
product, partial-aggregated), so RSS comes from residuals, not from the Gram.
All candidates of a product are fitted on the same rows (complete over the
superset), which keeps their RMSEs comparable.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.functions.scalar import weekday_flag
from mixlens.operators import series as S
from mixlens.operators.features import KEY, DATE, TRAIN_TO, DECAY_RATES, FX_WINDOW
from mixlens.operators.joins import bounded_broadcast
from mixlens.operators.regression import ALIAS_TOL, matrix, square, sweep
from mixlens.session import bucketed_table

BROADCAST_BYTES = 64 << 20
SHARED = ("day_friday", "day_saturday", "day_sunday", "consumer_confidence_index",
          "better_than_average_weather_days", "worse_than_average_weather_days")
FX = ("mean", "lag")
POWERS = (1.0, 2.0, 4.0)


def _tv(r):
    return f"tv_r{int(round(r * 100)):03d}"


def _vis(p):
    return f"vis_p{int(p)}"


def candidates(rates=DECAY_RATES, fx=FX, powers=POWERS):
    return list(itertools.product(rates, fx, powers))


def superset(rates=DECAY_RATES, fx=FX, powers=POWERS) -> list[str]:
    return ["intercept", *SHARED, *[_tv(r) for r in rates], *[f"fx_{f}" for f in fx], *[_vis(p) for p in powers]]


def search_design(panel_drivers: DataFrame, target: str = "sessions", rates=DECAY_RATES, powers=POWERS,
                  train_to=TRAIN_TO) -> DataFrame:
    """All candidate columns per (product, date); non-TV columns z-scored per product."""
    df = panel_drivers.filter(F.col(DATE) <= F.lit(train_to))
    for r in rates:
        df = S.adstock(df, "tv_ad_reach", r, by=KEY, order=DATE, out=_tv(r))
    df = S.rolling_mean_right(df, "exchange_rate", FX_WINDOW, by=KEY, order=DATE, out="fx_mean")
    df = S.lag(df, "exchange_rate", 1, by=KEY, order=DATE, out="fx_lag")
    df = df.select(
        KEY, DATE, F.col(target).cast("double").alias("dep_var"),
        weekday_flag(DATE, "Friday").alias("day_friday"), weekday_flag(DATE, "Saturday").alias("day_saturday"),
        weekday_flag(DATE, "Sunday").alias("day_sunday"), "consumer_confidence_index",
        "better_than_average_weather_days", "worse_than_average_weather_days",
        *[F.log1p(_tv(r)).alias(_tv(r)) for r in rates], "fx_mean", "fx_lag",
        *[F.pow(F.col("online_visibility"), F.lit(float(p))).alias(_vis(p)) for p in powers])
    scaled = [c for c in df.columns if c not in (KEY, DATE, "dep_var") and not c.startswith("tv_r")]
    return S.zscore(df, scaled, by=KEY)


def _sub(cands, cols):
    pos = {c: i for i, c in enumerate(cols)}
    return [[pos[n] for n in ("intercept", *SHARED, _tv(r), f"fx_{f}", _vis(p))] for r, f, p in cands]


def solve_branches(xtx: np.ndarray, xty: np.ndarray, subs: list[list[int]], tol: float):
    """Coefficients (rows, candidates, terms; 0 where aliased) and ranks (rows,
    candidates) of every candidate.  Candidates are paths of a tree: the shared
    terms are swept once, then each adstock rate, below it each exchange-rate
    transform, below that each visibility power."""
    rows, p = xty.shape
    whole = np.zeros((rows, p + 1, p + 1))
    whole[:, :p, :p] = xtx
    whole[:, :p, p] = whole[:, p, :p] = xty
    diagonal = xtx[:, range(p), range(p)]
    done: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {(): (whole, np.zeros((rows, p), bool))}

    def swept(path):
        if path not in done:
            m, admitted = (x.copy() for x in swept(path[:-1]))
            admitted[:, path[-1]] = sweep(m, path[-1], tol, diagonal[:, path[-1]])
            done[path] = m, admitted
            # a finished branch above is not needed again once the next one begins
            for other in [q for q in done if len(q) >= len(path) and q != path]:
                del done[other]
        return done[path]

    coefs, ranks = [], []
    for idx in subs:
        m, admitted = swept(tuple(idx))
        coefs.append(np.where(admitted[:, idx], m[:, idx, p], 0.0))
        ranks.append(admitted[:, idx].sum(axis=1))
    return np.stack(coefs, axis=1), np.stack(ranks, axis=1)


def search(panel_drivers: DataFrame, target: str = "sessions", rates=DECAY_RATES, fx=FX, powers=POWERS,
           tol: float = ALIAS_TOL, buckets: int | None = None) -> DataFrame:
    """(product_id, adstock_rate, fx_transform, visibility_power, n, rank, rmse, r_squared, fit_rank).
    ``buckets``: as in ``regression.fit``."""
    cols = superset(rates, fx, powers)
    cands = candidates(rates, fx, powers)
    subs = _sub(cands, cols)
    design = search_design(panel_drivers, target, rates, powers)
    x = [F.lit(1.0) if c == "intercept" else F.col(c) for c in cols]
    complete = F.col("dep_var").isNotNull()
    for c in cols[1:]:
        complete = complete & F.col(c).isNotNull()
    # read twice (Gram, residuals): written once, bucketed by product so both
    # passes aggregate per product without an exchange
    design = bucketed_table(design.filter(complete), KEY, (KEY, DATE), buckets)
    p = len(cols)
    y = F.col("dep_var")
    gram = design.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p)]).alias("xtx"),
        F.array(*[F.sum(x[i] * y) for i in range(p)]).alias("xty"),
        F.avg(y).alias("mean_y"))

    terms = len(subs[0])

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n = col["n"].to_numpy()
            coefs, ranks = solve_branches(square(matrix(col["xtx"], p * (p + 1) // 2), p), matrix(col["xty"], p), subs, tol)
            ok = np.repeat((n[:, None] > ranks).ravel(), terms)          # too few rows: no coefficients
            flat = pa.ListArray.from_arrays(pa.array(np.arange(ranks.size + 1) * terms, pa.int32()),
                                            pa.array(coefs.ravel(), mask=~ok))
            per = pa.array(np.arange(len(n) + 1) * len(subs), pa.int32())
            yield pa.RecordBatch.from_arrays([
                col[KEY], pa.array(n, pa.int64()), col["mean_y"], pa.ListArray.from_arrays(per, flat),
                pa.ListArray.from_arrays(per, pa.array(ranks.ravel().astype(np.int32)))], names=schema.names)

    schema = T.StructType([
        T.StructField(KEY, T.StringType()), T.StructField("n", T.LongType()), T.StructField("mean_y", T.DoubleType()),
        T.StructField("coefs", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("ranks", T.ArrayType(T.IntegerType()))])
    models = gram.mapInArrow(run, schema)
    row_bytes = 8 * len(cands) * terms + 500
    m = bounded_broadcast(models, BROADCAST_BYTES // row_bytes)
    d = design.join(m, on=KEY, how="inner")
    sums = []
    for c, idx in enumerate(subs):
        fitted = None
        for k, i in enumerate(idx):
            term = F.col("coefs")[c][k] * x[i]
            fitted = term if fitted is None else fitted + term
        r = y - fitted
        sums.append(F.sum(r * r).alias(f"rss{c}"))
    agg = d.groupBy(KEY, "n", "ranks").agg(F.sum((y - F.col("mean_y")) * (y - F.col("mean_y"))).alias("tss"), *sums)
    meta = F.array(*[F.struct(F.lit(float(r)).alias("adstock_rate"), F.lit(f).alias("fx_transform"),
                              F.lit(float(pw)).alias("visibility_power"), F.lit(c).alias("c"))
                     for c, (r, f, pw) in enumerate(cands)])
    rss = F.array(*[F.col(f"rss{c}") for c in range(len(cands))])
    long = agg.select(KEY, "n", "tss", "ranks", rss.alias("rss"), F.explode(meta).alias("cand"))
    long = long.select(
        KEY, "cand.adstock_rate", "cand.fx_transform", "cand.visibility_power", "n",
        F.col("ranks")[F.col("cand.c")].alias("rank"),
        F.sqrt(F.col("rss")[F.col("cand.c")] / F.col("n")).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.col("rss")[F.col("cand.c")], F.col("tss"))).alias("r_squared"))
    # fits equal to six decimals rank in the order of the candidates
    w = Window.partitionBy(KEY).orderBy(F.round("rmse", 6).asc_nulls_last(), "adstock_rate", "fx_transform", "visibility_power")
    return long.withColumn("fit_rank", F.row_number().over(w).cast("bigint"))
