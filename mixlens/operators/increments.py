"""Fits by increment (M1-M3, W7, S5, S6): each new batch of days is read once.

Two small tables take the place of the history.  ``state`` holds per product
what the ordered features need from the past: the last adstock, the last
exchange rates of the rolling mean, the number of rows, and rows that still
wait for the first full mean.  ``moments`` holds per (product, month) the
counts, means and centred co-moments of the raw terms and the target; they
merge without loss (differences of means, never raw second moments).  They are
computed per Arrow batch, where the rows of a product lie together, so a month
on a batch's edge has two rows and no row is shuffled to compute them.

A fit reads the moments only.  The z-scores of the design are applied to the
merged Gram matrix by algebra: with m, s the mean and SD of a term over the
scale range, and mu, C the means and co-moments over the fitted rows,
    sum z_i z_j = (C_ij + n (mu_i - m_i)(mu_j - m_j)) / (s_i s_j).
So there is no window over whole series in a fit, and its cost follows the
number of months, not of rows.

Batches come in date order and never split a date.  A store is a folder:
``batches``, ``moments/batch=...`` and ``state/batch=...``; a batch counts once
it is listed in ``batches``, which is written last, so a broken append leaves
the store as it was and can be repeated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixlens.operators import series as S
from mixlens.operators.features import DATE, KEY, ModelSpec, _derive_rows
from mixlens.operators.regression import ALIAS_TOL, model_table, solve
from mixlens.session import cut_lineage


def _variables(spec: ModelSpec) -> tuple[str, ...]:
    return (*spec.terms, "dep_var")


def _pairs(spec: ModelSpec) -> list[tuple[int, int]]:
    q = len(_variables(spec))
    return [(i, j) for i in range(q) for j in range(i, q)]


def _row(spec: ModelSpec) -> Column:
    return F.struct(DATE, *_variables(spec))


def no_state(spark: SparkSession, spec: ModelSpec) -> DataFrame:
    fields = ", ".join([f"{DATE}: date", *[f"{v}: double" for v in _variables(spec)]])
    return spark.createDataFrame([], f"{KEY} string, rows_before bigint, tv_before double, fx_before array<double>, "
                                     f"waiting array<struct<{fields}>>")


def advance(rows: DataFrame, state: DataFrame, spec: ModelSpec) -> tuple[DataFrame, DataFrame]:
    """(design rows ready to count, state after them) from the panel-with-drivers
    rows of one batch and the state before it.  Design rows equal those of
    ``build_design`` over the whole history."""
    k = spec.fx_window
    w = Window.partitionBy(KEY).orderBy(DATE)
    new = S.adstock(rows, "tv_ad_reach", spec.adstock_rate, by=KEY, order=DATE, out="tv_new")
    new = new.withColumns({
        "at": F.row_number().over(w).cast("bigint"),
        "fx_mean": F.avg("exchange_rate").over(w.rowsBetween(-(k - 1), 0)),
        "last": F.lead(F.lit(1)).over(w).isNull(),
        # the last k rates, NULL ones too
        "fx_new": F.array(*[F.lag(F.col("exchange_rate").cast("double"), i).over(w) for i in range(k - 1, -1, -1)])})
    new = new.withColumn("fx_new", F.slice("fx_new", F.lit(k + 1) - F.least("at", F.lit(k)).cast("int"), F.least("at", F.lit(k)).cast("int")))
    new = new.join(state, KEY, "left")
    seen = F.coalesce("rows_before", F.lit(0))
    window = F.concat(F.coalesce("fx_before", F.array().cast("array<double>")), F.col("fx_new"))
    last_k = F.slice(window, F.greatest(F.size(window) - (k - 1), F.lit(1)), k)
    known = F.filter(last_k, lambda v: v.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known))
    new = new.withColumns({
        "tv_adstock_raw": F.col("tv_new") + F.pow(F.lit(spec.adstock_rate), F.col("at")) * F.coalesce("tv_before", F.lit(0.0)),
        "exchange_rate_moving_av": F.when(F.col("at") >= k, F.col("fx_mean")).otherwise(mean),
        # of a product's last row, the only one that passes it on
        "fx_tail": F.when(F.col("last"), F.slice(window, F.greatest(F.size(window) - (k - 2), F.lit(1)), k - 1)
                          if k > 1 else F.array().cast("array<double>")),
        "rows_now": seen + F.col("at")})
    new = _derive_rows(new, spec).withColumn("dep_var", F.col(spec.target).cast("double"))
    for t in spec.terms:
        new = new.withColumn(t, F.col(t).cast("double"))
    new = cut_lineage(new.select(KEY, DATE, *_variables(spec), "rows_now", "tv_adstock_raw", "fx_tail"))

    # the rows before the first full mean take that mean, once it is there
    per = new.groupBy(KEY).agg(
        F.max_by(F.struct(F.col("rows_now").alias("rows_before"), F.col("tv_adstock_raw").alias("tv_before"),
                          F.col("fx_tail").alias("fx_before")), DATE).alias("s"),
        F.max(F.when(F.col("rows_now") == k, F.struct(F.col("exchange_rate_moving_av").alias("v")))).alias("full"),
        F.sort_array(F.collect_list(F.when(F.col("rows_now") < k, _row(spec)))).alias("early"))     # fewer than k rows
    after = per.join(state.select(KEY, F.col("waiting"), F.struct("rows_before", "tv_before", "fx_before").alias("old")), KEY, "full")
    none = F.array().cast(state.schema["waiting"].dataType)
    wait = F.concat(F.coalesce("waiting", none), F.coalesce("early", none))
    grown = F.coalesce("s", "old")
    after = cut_lineage(after.select(KEY, grown["rows_before"].alias("rows_before"), grown["tv_before"].alias("tv_before"),
                                     grown["fx_before"].alias("fx_before"), wait.alias("waiting"), "full"))
    freed = after.filter(F.col("full").isNotNull()).select(KEY, F.explode("waiting").alias("r"), "full").select(
        KEY, "r.*", F.col("full.v").alias("_full")).withColumn("exchange_rate_moving_av", F.col("_full")).drop("_full")
    ready = new.filter(F.col("rows_now") >= k).select(KEY, DATE, *_variables(spec)).unionByName(freed)
    after = after.select(KEY, "rows_before", "tv_before", "fx_before",
                         F.when(F.col("rows_before") < k, F.col("waiting")).otherwise(none).alias("waiting"))
    return ready, after


def _pair_index(spec: ModelSpec) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(len(_variables(spec)))


def _moments_of(x: np.ndarray, known: np.ndarray, fit: np.ndarray, starts: np.ndarray, spec: ModelSpec) -> np.ndarray:
    """Moments of the row groups that begin at ``starts``, one line a group: n, means and
    co-moments of the complete rows to fit, then counts, means and squared
    deviations of each term's known values (0 where there are none)."""
    i, j = _pair_index(spec)
    sizes = np.diff(np.append(starts, len(x)))
    total = lambda v: np.add.reduceat(v, starts, axis=0)
    x = np.where(known, x, 0.0)
    whole = known.all(axis=1) & fit
    n = total(whole.astype(float))[:, None]
    mean = total(np.where(whole[:, None], x, 0.0)) / np.maximum(n, 1.0)
    d = np.where(whole[:, None], x - np.repeat(mean, sizes, axis=0), 0.0)
    terms, seen = x[:, :-1], known[:, :-1]
    count = total(seen.astype(float))
    middle = total(terms) / np.maximum(count, 1.0)
    off = np.where(seen, terms - np.repeat(middle, sizes, axis=0), 0.0)
    return np.hstack([n, mean, total(d[:, i] * d[:, j]), count, middle, total(off * off)])


def _merge(m: np.ndarray, starts: np.ndarray, spec: ModelSpec) -> np.ndarray:
    """Lines of ``_moments_of`` merged by group: co-moments about the merged means."""
    i, j = _pair_index(spec)
    q, t = len(_variables(spec)), len(spec.terms)
    sizes = np.diff(np.append(starts, len(m)))
    total = lambda v: np.add.reduceat(v, starts, axis=0)
    n, mean, c, count, middle, m2 = np.split(m, np.cumsum([1, q, len(i), t, t]), axis=1)
    out_n, out_count = total(n), total(count)
    out_mean, out_middle = total(n * mean) / np.maximum(out_n, 1.0), total(count * middle) / np.maximum(out_count, 1.0)
    d, off = mean - np.repeat(out_mean, sizes, axis=0), middle - np.repeat(out_middle, sizes, axis=0)
    return np.hstack([out_n, out_mean, total(c + n * d[:, i] * d[:, j]), out_count, out_middle, total(m2 + count * off * off)])


def _runs(*columns) -> np.ndarray:
    """Where a run of equal values of the Arrow columns begins."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        code = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _lines(m: np.ndarray):
    import pyarrow as pa
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def moments(design: DataFrame, spec: ModelSpec) -> DataFrame:
    """(product, month, m): ``m`` has the numbers of ``_moments_of`` over the product's
    rows of the month, or a part of them; parts merge without loss."""
    v = _variables(spec)
    if spec.scale_from is not None:
        design = design.filter(F.col(DATE) >= F.lit(spec.scale_from))
    fit = F.col(DATE) >= F.lit(spec.fit_from) if spec.fit_from is not None else F.lit(True)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i) for i in range(batch.num_columns)]
            starts = _runs(cols[0], cols[1])
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in cols[3:]])
            known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in cols[3:]])
            m = _moments_of(x, known, cols[2].to_numpy(zero_copy_only=False).astype(bool), starts, spec)
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([cols[0].take(at), cols[1].take(at), _lines(m)], names=[KEY, "month", "m"])

    rows = design.select(KEY, F.trunc(DATE, "month").alias("month"), fit.alias("fit"), *[F.col(c).cast("double").alias(c) for c in v])
    return rows.mapInArrow(run, f"{KEY} string, month date, m array<double>")


def merged_moments(found: DataFrame, spec: ModelSpec) -> DataFrame:
    """(product, m): the moments of each product merged, first those that lie together in
    a batch, so that few rows a product are shuffled, then the rest."""
    q, t = len(_variables(spec)), len(spec.terms)
    width = 1 + q + len(_pairs(spec)) + 3 * t

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, m = batch.column(0), batch.column(1)
            if pa.types.is_list(m.type.value_type):       # one list of lines a product
                starts = np.append(0, np.cumsum([len(x) for x in m])[:-1])
                m = m.flatten()
            else:
                starts = _runs(keys)
                keys = keys.take(pa.array(starts))
            lines = m.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([keys, _lines(_merge(lines, starts, spec))], names=[KEY, "m"])

    schema = f"{KEY} string, m array<double>"
    part = found.select(KEY, "m").mapInArrow(run, schema)
    return part.groupBy(KEY).agg(F.sort_array(F.collect_list("m")).alias("m")).mapInArrow(run, schema)


def merged_gram(found: DataFrame, spec: ModelSpec) -> DataFrame:
    """The Gram table of ``regression.gram`` from moments: merged by product, then scaled by algebra."""
    v, terms = _variables(spec), spec.terms
    pairs = _pairs(spec)
    at = {p: i for i, p in enumerate(pairs)}
    zero = F.lit(0.0)
    m = F.col("m")
    means, comoments = 1, 1 + len(v)
    counts = comoments + len(pairs)
    middles, squares = counts + len(terms), counts + 2 * len(terms)
    wide = merged_moments(found, spec).filter(m[0] > 0).select(
        KEY, m[0].alias("n"), *[m[comoments + i].alias(f"c{i}") for i in range(len(pairs))],
        *[m[means + i].alias(f"mu{i}") for i in range(len(v))],
        *[m[middles + i].alias(f"m{i}") for i in range(len(terms))],
        *[F.when(m[counts + i] > 1, F.sqrt(m[squares + i] / (m[counts + i] - 1))).alias(f"s{i}") for i in range(len(terms))])
    scaled = {i for i, t in enumerate(terms) if t in spec.scaled_terms()}
    y = len(terms)

    def shift(i):       # distance of the fitted rows' mean from the mean of the scale
        return F.col(f"mu{i}") - F.col(f"m{i}") if i in scaled else F.col(f"mu{i}")

    def over(i, expr):  # a constant term scales to 0
        return F.coalesce(F.try_divide(expr, F.col(f"s{i}")), zero) if i in scaled else expr

    n = F.col("n")
    cross = lambda i, j: F.col(f"c{at[i, j]}") + n * shift(i) * shift(j)
    xtx = [n] + [over(i, n * shift(i)) for i in range(y)]
    for i in range(y):
        xtx += [over(i, over(j, cross(i, j))) for j in range(i, y)]
    xty = [n * F.col(f"mu{y}")] + [over(i, cross(i, y)) for i in range(y)]
    none = F.lit(None).cast("double")
    return wide.select(
        KEY, n.cast("bigint").alias("n"), F.array(*xtx).alias("xtx"), F.array(*xty).alias("xty"),
        (n * F.col(f"mu{y}")).alias("sum_y"), cross(y, y).alias("yty"),
        F.array(none, *[F.col(f"m{i}") if i in scaled else none for i in range(y)]).alias("scale_mean"),
        F.array(none, *[F.col(f"s{i}") if i in scaled else none for i in range(y)]).alias("scale_sd"))


class MomentStore:
    """The folder of one spec's moments and state (shared storage on a cluster)."""

    def __init__(self, spark: SparkSession, path: str, spec: ModelSpec):
        if spec.tv_on_null != "zero":
            raise ValueError("MomentStore: tv_on_null='zero' only")
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec

    def batches(self) -> list[str]:
        """Names of the batches appended so far, in order (one short row each)."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        return [r["batch"] for r in self.spark.read.parquet(f"{self.path}/batches").orderBy("no").collect()]

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add the panel-with-drivers rows of one batch; reads them and the last state."""
        done = self.batches()
        if batch in done:
            raise ValueError(f"batch {batch!r} is in the store")
        state = self.spark.read.parquet(f"{self.path}/state/batch={done[-1]}") if done else no_state(self.spark, self.spec)
        ready, after = advance(rows, state, self.spec)
        moments(ready, self.spec).withColumn("part", F.lit(len(done))).write.mode("overwrite").parquet(f"{self.path}/moments/batch={batch}")
        after.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")
        self.spark.createDataFrame([(len(done), batch)], "no int, batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/batches")

    def moments(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/moments/batch={b}" for b in self.batches()])

    def fit(self, tol: float = ALIAS_TOL) -> DataFrame:
        """The model table of ``regression.fit`` over everything appended."""
        return model_table(solve(merged_gram(self.moments(), self.spec), self.spec, tol), self.spec)
