import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from mixlens.operators import regression as R
from mixlens.operators.features import SESSIONS_SPEC, BOOKINGS_SPEC, ModelSpec
from mixlens.plans.context import panel_drivers


@pytest.fixture(scope="module")
def fitted(spark):
    pdr = panel_drivers(spark, SF001)
    models, scaled = R.fit(pdr, SESSIONS_SPEC)
    return models, scaled


def test_ols_matches_numpy_lstsq(spark, fitted):
    models, scaled = fitted
    rows = R.complete_cases(scaled, SESSIONS_SPEC).toPandas()
    got = {r.product_id: r for r in models.collect()}
    assert got, "no models"
    for pid, g in rows.groupby("product_id"):
        x = np.column_stack([np.ones(len(g))] + [g[t].to_numpy(float) for t in SESSIONS_SPEC.terms])
        beta, *_ = np.linalg.lstsq(x, g["dep_var"].to_numpy(float), rcond=None)
        m = got[pid]
        assert m.status == "ok" and m.rank == 10 and m.n == len(g)
        assert np.allclose(np.array(m.coef, float), beta, rtol=1e-7, atol=1e-7)


def test_residuals_sum_zero_and_orthogonal(spark, fitted):
    models, scaled = fitted
    avm = R.actual_vs_model(scaled, models, SESSIONS_SPEC)
    j = avm.join(R.complete_cases(scaled, SESSIONS_SPEC), ["product_id", "date"])
    aggs = [F.sum("residual").alias("s")] + [F.sum(F.col("residual") * F.col(t)).alias(t) for t in SESSIONS_SPEC.terms]
    for r in j.groupBy("product_id").agg(*aggs).collect():
        assert abs(r.s) < 1e-7
        for t in SESSIONS_SPEC.terms:
            assert abs(r[t]) < 1e-6


def test_quality_and_summary(spark, fitted):
    models, scaled = fitted
    q = R.model_quality(scaled, models, SESSIONS_SPEC).collect()
    for r in q:
        assert 0.0 <= r.r_squared <= 1.0
        assert r.rmse == pytest.approx(math.sqrt(r.rss / r.n))
    s = R.fit_summary(scaled, models, SESSIONS_SPEC).collect()
    assert len(s) == 10 * len(q)
    for r in s:
        assert r.p_value is None or 0.0 <= r.p_value <= 1.0



def _design(spark, rows):
    return spark.createDataFrame(rows, "product_id string, date date, dep_var double, a double, b double")


def test_aliased_term_gets_null_and_rest_unchanged(spark):
    spec = ModelSpec(target="y", terms=("a", "b"), train_to=dt.date(2030, 1, 1), unscaled=("a", "b"))
    rng = np.random.default_rng(0)
    rows = []
    for i in range(30):
        a = float(rng.normal())
        rows.append(("p", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0 + 2.0 * a + float(rng.normal()) * 0.01, a, 2.0 * a))
    m = R.solve(R.gram(_design(spark, rows), spec), spec).first()
    assert m.rank == 2 and m.coef[2] is None
    assert m.coef[1] == pytest.approx(2.0, abs=0.01)


def test_too_few_rows(spark):
    spec = ModelSpec(target="y", terms=("a", "b"), train_to=dt.date(2030, 1, 1), unscaled=("a", "b"))
    rows = [("p", dt.date(2020, 1, 1), 1.0, 1.0, 2.0), ("p", dt.date(2020, 1, 2), 2.0, 3.0, 1.0)]
    m = R.solve(R.gram(_design(spark, rows), spec), spec).first()
    assert m.status == "too_few_rows"


def test_bookings_fit_range(spark):
    pdr = panel_drivers(spark, SF001)
    models, scaled = R.fit(pdr, BOOKINGS_SPEC)
    assert scaled.agg(F.min("date")).first()[0] >= dt.date(1998, 1, 1)
    assert models.filter("status = 'ok'").count() > 0


def test_residual_diagnostics_against_numpy(spark):
    rng = np.random.default_rng(12)
    spec = replace(SESSIONS_SPEC, terms=("day_friday", "consumer_confidence_index"), unscaled=("day_friday", "consumer_confidence_index"))
    rows, want = [], {}
    for pid in ("a", "b"):
        x = np.column_stack([np.ones(60), rng.integers(0, 2, 60), rng.normal(size=60)])
        noise = rng.normal(size=60) * (np.exp(x[:, 2]) if pid == "b" else 1)
        noise = np.cumsum(noise) if pid == "a" else noise
        y = x @ [5.0, 2.0, -1.0] + noise
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        u = e * e
        g = u - x @ np.linalg.lstsq(x, u, rcond=None)[0]
        r2 = 1 - (g @ g) / ((u - u.mean()) @ (u - u.mean()))
        want[pid] = (np.diff(e) @ np.diff(e) / (e @ e), 60 * r2, (r2 / 2) / ((1 - r2) / 57))
        rows += [(pid, dt.date(1999, 1, 1) + dt.timedelta(days=i), float(y[i]), float(x[i, 1]), float(x[i, 2])) for i in range(60)]
    design = spark.createDataFrame(rows, "product_id string, date date, dep_var double, day_friday double, consumer_confidence_index double")
    models = R.model_table(R.solve(R.gram(design, spec), spec), spec)
    for r in R.residual_diagnostics(design, models, spec).collect():
        assert (r.durbin_watson, r.breusch_pagan, r.bp_f) == pytest.approx(want[r.product_id], rel=1e-8)
        assert 0 <= r.bp_p_value <= 1
    got = {r.product_id: r for r in R.residual_diagnostics(design, models, spec).collect()}
    assert got["a"].durbin_watson < 1 < got["b"].durbin_watson and got["b"].bp_p_value < 0.01
