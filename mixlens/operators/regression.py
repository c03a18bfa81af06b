"""Grouped least squares (M3-M7, P12): one linear model per product.

Pass 1 (Spark): per product, the upper triangle of X'X, X'y, y'y and n as plain
``sum`` aggregates over complete-case rows.  They are partial-aggregated inside
each task before the shuffle, so the exchange carries (products x tasks) small
rows whatever the row count, and a product holding a third of all rows is
combined map-side like any other.

Solve (one row per model): ``mapInArrow`` over the Gram table; the p x p systems
(p = 10) of an Arrow batch are swept together, term by term.  Terms are admitted
in term order; a term whose residual diagonal, after projecting out the terms
already admitted, is below ``tol`` x its own diagonal is aliased: coefficient
NULL, the rest solved without it (what a pivoting QR with a tolerance does).

Pass 2 (Spark): residuals, RSS, TSS, RMSE, R^2, standard errors, t and p.
RSS is summed from the residuals themselves, never y'y - b'X'y.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.functions.tails import f_upper, t_two_sided
from mixlens.operators.features import KEY, DATE, ModelSpec, build_design, scale_design
from mixlens.operators.joins import bounded_broadcast
from mixlens.session import cut_lineage, bucketed_table

MODEL_BROADCAST_ROWS = 100_000
ALIAS_TOL = 1e-7


def complete_cases(design: DataFrame, spec: ModelSpec) -> DataFrame:
    """P12 rows with the target and every term present."""
    cond = F.col("dep_var").isNotNull()
    for t in spec.terms:
        cond = cond & F.col(t).isNotNull()
    return design.filter(cond)


def _x(spec: ModelSpec):
    return [F.lit(1.0)] + [F.col(t).cast("double") for t in spec.terms]


def gram(design: DataFrame, spec: ModelSpec) -> DataFrame:
    """M3a per-product Gram aggregates: n, X'X (upper triangle, row-major), X'y, y'y.

    When the design carries ``mean__t`` / ``sd__t`` columns (per-product
    constants) they are carried along as ``scale_mean`` / ``scale_sd`` arrays."""
    x = _x(spec)
    y = F.col("dep_var")
    p = len(x)
    xtx = [F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p)]
    xty = [F.sum(x[i] * y) for i in range(p)]
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.array(*xtx).alias("xtx"),
        F.array(*xty).alias("xty"),
        F.sum(y * y).alias("yty"),
        F.sum(y).alias("sum_y"),
    ]
    none = F.lit(None).cast("double")
    scaled = spec.scaled_terms()
    has = all(f"mean__{t}" in design.columns for t in scaled)
    aggs.append(F.array(*[F.max(f"mean__{t}") if has and t in scaled else none
                          for t in spec.all_terms]).alias("scale_mean"))
    aggs.append(F.array(*[F.max(f"sd__{t}") if has and t in scaled else none
                          for t in spec.all_terms]).alias("scale_sd"))
    return complete_cases(design, spec).groupBy(KEY).agg(*aggs)


def sweep(m: np.ndarray, k: int, tol: float, diagonal: np.ndarray) -> np.ndarray:
    """Sweep term ``k`` into a batch of systems (rows, q, q), in place: where the
    term keeps more than ``tol`` of its own ``diagonal`` it is admitted, elsewhere
    the system stays as it is.  Returns the mask of admitted systems.

    After sweeping the terms of a set S, the block S x S holds the inverse of
    X_S'X_S and row k the coefficient of term k in the columns not swept."""
    pivot = m[:, k, k]
    with np.errstate(invalid="ignore"):
        admit = np.isfinite(diagonal) & (diagonal > 0) & (pivot > tol * diagonal)
    safe = np.where(admit, pivot, 1.0)
    row = m[:, k, :] / safe[:, None]
    column = m[:, :, k].copy()
    column[:, k] = 0.0
    swept = m - column[:, :, None] * row[:, None, :]
    swept[:, k, :] = row
    swept[:, :, k] = -column / safe[:, None]
    swept[:, k, k] = 1.0 / safe
    m[admit] = swept[admit]
    return admit


def square(upper: np.ndarray, p: int) -> np.ndarray:
    """(rows, p, p) from row-major upper triangles."""
    a = np.zeros((len(upper), p, p))
    i, j = np.triu_indices(p)
    a[:, i, j] = upper
    a[:, j, i] = upper
    return a


def solve_batch(xtx: np.ndarray, xty: np.ndarray, tol: float = ALIAS_TOL):
    """Normal equations of a batch, terms admitted in order: (coefficients, diagonal
    of the inverse, admitted), each (rows, p).  A term that keeps no more than
    ``tol`` of its diagonal beside the terms before it is not admitted (aliased)."""
    rows, p = xty.shape
    m = np.zeros((rows, p + 1, p + 1))
    m[:, :p, :p] = xtx
    m[:, :p, p] = m[:, p, :p] = xty
    diagonal = xtx[:, range(p), range(p)]
    admitted = np.stack([sweep(m, k, tol, diagonal[:, k]) for k in range(p)], axis=1) if rows else np.zeros((0, p), bool)
    return m[:, :p, p], m[:, range(p), range(p)], admitted


def _lists(values: np.ndarray, known: np.ndarray):
    """Rows of a matrix as an Arrow list column, NULL where not known."""
    import pyarrow as pa
    rows, p = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * p, pa.int32()),
                                    pa.array(values.ravel(), pa.float64(), mask=~known.ravel()))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of equally long lists without NULLs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _solver(spec: ModelSpec, tol: float):
    p = len(spec.all_terms)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n = col["n"].to_numpy()
            coef, inverse, admitted = solve_batch(square(matrix(col["xtx"], p * (p + 1) // 2), p), matrix(col["xty"], p), tol)
            rank = admitted.sum(axis=1)
            status = np.where(rank == 0, "rank_zero", np.where(n > rank, "ok", "too_few_rows"))
            usable = admitted & (status == "ok")[:, None]
            yield pa.RecordBatch.from_arrays([
                col[KEY], pa.array(n, pa.int64()), pa.array(rank.astype(np.int32)), pa.array(status.tolist(), pa.string()),
                _lists(coef, usable), _lists(inverse, admitted), pa.array(col["sum_y"].to_numpy() / n),
                col["scale_mean"], col["scale_sd"]], names=SOLVED_SCHEMA.names)
    return run


SOLVED_SCHEMA = T.StructType([
    T.StructField(KEY, T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("coef", T.ArrayType(T.DoubleType())),
    T.StructField("xtx_inv_diag", T.ArrayType(T.DoubleType())),
    T.StructField("mean_y", T.DoubleType()),
    T.StructField("scale_mean", T.ArrayType(T.DoubleType())),
    T.StructField("scale_sd", T.ArrayType(T.DoubleType())),
])


def solve(gram_df: DataFrame, spec: ModelSpec, tol: float = ALIAS_TOL) -> DataFrame:
    return gram_df.mapInArrow(_solver(spec, tol), SOLVED_SCHEMA)


def model_table(solved: DataFrame, spec: ModelSpec) -> DataFrame:
    return solved.select(
        F.lit(spec.target).alias("target"), KEY, "status", "rank", "n",
        F.array(*[F.lit(t) for t in spec.all_terms]).alias("terms"),
        "coef", "xtx_inv_diag", "mean_y", "scale_mean", "scale_sd")


def fit(panel_drivers: DataFrame, spec: ModelSpec, tol: float = ALIAS_TOL,
        keep_design: bool = True, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M3/M4 fit every product.  Returns (model table, scaled design).

    The model table has one row per product: target, terms, status, rank, n,
    coefficients (NULL where aliased), inverse-Gram diagonal, mean of y, and the
    per-term training mean / SD used to scale.  Both the scaled design (reused
    by residual, contribution and summary passes) and the model table are
    written to the shared checkpoint folder, so later passes read them instead
    of re-aggregating the source.  ``keep_design=False`` streams the design
    straight into the Gram aggregate when only the models are needed.  ``buckets``
    is the number of files of the design, each read by one task: the number of
    tasks that ``panel_drivers`` is dealt to by product, if it is."""
    design = build_design(panel_drivers, spec)
    scaled = scale_design(design, spec, keep_stats=True)
    if keep_design:
        scaled = bucketed_table(scaled, KEY, (KEY, DATE), buckets)
    solved = solve(gram(scaled, spec), spec, tol)
    models = cut_lineage(model_table(solved, spec))
    stats = [c for c in scaled.columns if c.startswith(("mean__", "sd__"))]
    return models, scaled.drop(*stats)


def fit_notes(models: DataFrame, spec: ModelSpec) -> DataFrame:
    """M4 how each model came out: its status (``ok``, ``too_few_rows``,
    ``rank_zero``), the scaled terms without variation and the other terms that
    are aliased, and a note: ``rank_deficient`` if any is aliased, else
    ``constant_term`` if any does not vary, else ``full_rank``."""
    at = [i for i, t in enumerate(spec.all_terms) if t in spec.scaled_terms()]
    still = [F.coalesce(F.col("scale_sd")[i] == 0, F.lit(False)).cast("bigint") for i in at]
    constant = sum(still[1:], still[0]) if still else F.lit(0).cast("bigint")
    aliased = F.lit(len(spec.all_terms)).cast("bigint") - F.col("rank") - constant
    note = F.when(aliased > 0, "rank_deficient").when(constant > 0, "constant_term").otherwise("full_rank")
    return models.select("target", KEY, "status", "rank", "n", constant.alias("constant_terms"), aliased.alias("aliased_terms"),
                         note.alias("note"))


def with_models(design: DataFrame, models: DataFrame) -> DataFrame:
    """Attach each product's model row; broadcast only after a checked count."""
    m = bounded_broadcast(models.filter(F.col("status") == "ok"), MODEL_BROADCAST_ROWS,
                          materialise=False)
    return design.join(m, on=KEY, how="inner")


def fitted_expr(spec: ModelSpec):
    """x . beta with aliased (NULL) coefficients counting as 0."""
    x = _x(spec)
    terms = [F.coalesce(F.col("coef")[i], F.lit(0.0)) * x[i] for i in range(len(x))]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def actual_vs_model(scaled: DataFrame, models: DataFrame, spec: ModelSpec) -> DataFrame:
    """M6 actual, fitted and residual per (product, date) over the fitted rows."""
    d = with_models(complete_cases(scaled, spec), models)
    fitted = fitted_expr(spec)
    return d.select(KEY, DATE, F.col("dep_var").alias("actual"), fitted.alias("fitted"),
                    (F.col("dep_var") - fitted).alias("residual"))


def residual_stats(scaled: DataFrame, models: DataFrame, spec: ModelSpec) -> DataFrame:
    """Per product RSS, TSS, n and residual sums (second pass over the rows)."""
    d = with_models(complete_cases(scaled, spec), models)
    r = F.col("dep_var") - fitted_expr(spec)
    return d.groupBy(KEY).agg(
        F.sum(r * r).alias("rss"),
        F.sum((F.col("dep_var") - F.col("mean_y")) * (F.col("dep_var") - F.col("mean_y"))).alias("tss"),
        F.sum(r).alias("sum_resid"),
        F.count(F.lit(1)).alias("n_fit"),
    )


def model_quality(scaled: DataFrame, models: DataFrame, spec: ModelSpec) -> DataFrame:
    """M5 (model level) / M7: R^2, adjusted R^2, F, sigma, RMSE (RSS / n, not n - p)."""
    rs = residual_stats(scaled, models, spec)
    m = models.select(KEY, "target", "rank", "n")
    q = rs.join(m, on=KEY, how="inner")
    df_res = (F.col("n") - F.col("rank")).cast("double")
    df_mod = (F.col("rank") - 1).cast("double")
    r2 = F.lit(1.0) - F.try_divide(F.col("rss"), F.col("tss"))
    return q.select(
        "target", KEY, "n", "rank",
        F.col("rss"), F.col("tss"),
        r2.alias("r_squared"),
        (F.lit(1.0) - F.try_divide(F.col("rss") / df_res, F.col("tss") / (F.col("n") - 1))).alias("adj_r_squared"),
        F.try_divide((F.col("tss") - F.col("rss")) / df_mod, F.col("rss") / df_res).alias("f_statistic"),
        F.sqrt(F.try_divide(F.col("rss"), df_res)).alias("sigma"),
        F.sqrt(F.col("rss") / F.col("n")).alias("rmse"),
    )


def rmse_by_product(scaled: DataFrame, models: DataFrame, spec: ModelSpec) -> DataFrame:
    """M7 sqrt(mean(residual^2)) per product."""
    return model_quality(scaled, models, spec).select("target", KEY, "rmse")


def coef_table(scaled: DataFrame, models: DataFrame, spec: ModelSpec) -> DataFrame:
    """M5 per term: estimate, standard error, t value and residual degrees of freedom."""
    q = model_quality(scaled, models, spec).select(KEY, "rss", "n", "rank")
    m = models.filter(F.col("status") == "ok").join(q.drop("n", "rank"), on=KEY, how="inner")
    sigma2 = F.try_divide(F.col("rss"), (F.col("n") - F.col("rank")).cast("double"))
    z = F.arrays_zip(F.col("terms").alias("term"), F.col("coef").alias("estimate"),
                     F.col("xtx_inv_diag").alias("inv"))
    long = m.select("target", KEY, "n", "rank", sigma2.alias("sigma2"),
                    F.posexplode(z).alias("term_index", "t"))
    se = F.sqrt(F.col("sigma2") * F.col("t.inv"))
    tval = F.try_divide(F.col("t.estimate"), se)
    return long.select("target", KEY, "term_index", F.col("t.term").alias("term"),
                       F.col("t.estimate").alias("estimate"), se.alias("std_error"), tval.alias("t_value"),
                       (F.col("n") - F.col("rank")).alias("df_resid"))


def fit_summary(scaled: DataFrame, models: DataFrame, spec: ModelSpec) -> DataFrame:
    """M5 the coefficient table with the two-sided p value of each t (n - rank
    degrees of freedom), and the model's F statistic with its p value."""
    q = model_quality(scaled, models, spec).select(
        KEY, "f_statistic", f_upper(F.col("f_statistic"), F.col("rank") - 1, F.col("n") - F.col("rank")).alias("f_p_value"))
    out = coef_table(scaled, models, spec)
    out = out.withColumn("p_value", t_two_sided(F.col("t_value"), F.col("df_resid")))
    return out.join(q, on=KEY, how="left")


def residual_diagnostics(scaled: DataFrame, models: DataFrame, spec: ModelSpec, tol: float = ALIAS_TOL,
                         buckets: int | None = None) -> DataFrame:
    """M8 per product: Durbin-Watson (lag-1 autocorrelation of the residuals in date
    order; near 2 without any) and Breusch-Pagan (the squared residuals fitted on
    the same terms: n R^2, and the F form with its p value; a small p means the
    variance moves with the terms).  NULL where the residuals are all zero."""
    r = F.col("dep_var") - fitted_expr(spec)
    d = with_models(complete_cases(scaled, spec), models).select(KEY, DATE, r.alias("resid"), *spec.terms)
    d = bucketed_table(d, KEY, (KEY, DATE), buckets)   # read three times, each without an exchange
    before = F.lag("resid", 1).over(Window.partitionBy(KEY).orderBy(DATE))
    dw = d.select(KEY, "resid", (F.col("resid") - before).alias("step")).groupBy(KEY).agg(
        F.try_divide(F.sum(F.col("step") * F.col("step")), F.sum(F.col("resid") * F.col("resid"))).alias("durbin_watson"))
    squares = d.withColumn("dep_var", F.col("resid") * F.col("resid")).drop("resid")
    aux = cut_lineage(model_table(solve(gram(squares, spec), spec, tol), spec))
    q = model_quality(squares, aux, spec)
    q = q.select(KEY, "n", "rank", (F.col("n") * F.col("r_squared")).alias("breusch_pagan"), F.col("f_statistic").alias("bp_f"),
                 f_upper(F.col("f_statistic"), F.col("rank") - 1, F.col("n") - F.col("rank")).alias("bp_p_value"))
    return q.join(dw, on=KEY, how="left").select(F.lit(spec.target).alias("target"), KEY, "n", "durbin_watson", "breusch_pagan",
                                                 "bp_f", "bp_p_value")
