"""The t and F tails against numerical integration and known quantiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlens.functions.tails import f_upper, t_two_sided


def beta_share(x, a, b, points=400_001):
    """I_x(a, b) by Simpson's rule in the angle whose squared sine is x."""
    angle = np.linspace(0.0, math.asin(math.sqrt(x)), points)
    log_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    with np.errstate(divide="ignore"):
        y = 2 * np.exp((2 * a - 1) * np.log(np.sin(angle)) + (2 * b - 1) * np.log(np.cos(angle)) - log_b)
    y[~np.isfinite(y)] = 0.0
    h = angle[1] - angle[0]
    return float(h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def test_t(spark):
    cases = [(t, df) for df in (1, 2, 3, 4, 9, 10, 51, 600, 601) for t in (0.0, 0.3, -1.0, 2.5, 5.9, 6.1, 9.0, 40.0)]
    got = spark.createDataFrame(cases, "t double, df bigint").select("t", "df", t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        want = beta_share(r.df / (r.df + r.t * r.t), r.df / 2, 0.5)
        rel = 1e-7 if r.df > 2 else 1e-5            # the integrand has a corner for one degree of freedom
        assert r.p == pytest.approx(want, rel=rel, abs=1e-12 if abs(r.t) <= 6 else 0), (r.t, r.df)
    # tabled two-sided 5 % quantiles
    known = [(12.706205, 1), (4.302653, 2), (2.228139, 10), (2.042272, 30), (1.983972, 100)]
    for r in spark.createDataFrame(known, "t double, df bigint").select(t_two_sided(F.col("t"), F.col("df")).alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=1e-7)


def test_f(spark):
    cases = [(f, m, df) for m in (1, 2, 3, 8, 9) for df in (1, 2, 5, 6, 90, 91, 500) for f in (0.2, 1.0, 3.0, 12.0, 60.0)]
    got = spark.createDataFrame(cases, "f double, m int, df bigint").select(
        "f", "m", "df", f_upper(F.col("f"), F.col("m"), F.col("df")).alias("p")).collect()
    for r in got:
        want = beta_share(r.df / (r.df + r.m * r.f), r.df / 2, r.m / 2)
        assert r.p == pytest.approx(want, rel=2e-5 if 1 in (r.m, r.df) else 1e-7, abs=1e-12), (r.f, r.m, r.df)


def test_undefined(spark):
    rows = [(None, 5), (float("nan"), 5), (1.0, 0), (1.0, None), (float("inf"), 5)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, df int").select(t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()]
    assert got == [None, None, None, None, 0.0]
    rows = [(None, 2, 5), (0.0, 2, 5), (-1.0, 2, 5), (1.0, 0, 5), (1.0, 2, 0)]
    got = [r.p for r in spark.createDataFrame(rows, "f double, m int, df int").select(
        f_upper(F.col("f"), F.col("m"), F.col("df")).alias("p")).collect()]
    assert got == [None, 1.0, 1.0, None, None]
