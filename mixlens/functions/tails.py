"""Tails of the t and F distributions for whole degrees of freedom, as column
expressions of finite series (no Python, no approximation by iteration).

With x = df / (df + t^2), N = floor(df / 2) and a = df mod 2 the central
probability of t is a sum of N terms, each the one before times
x (2k - 1 + a) / (2k + a); the terms from N on add up to the tail itself.  Up
to |t| = 6 the tail is 1 minus the sum; beyond, the tail terms are summed (all
positive, so small tails keep their digits) as far as they count, about
37 df / t^2 of them.  The F tail adds (m - 1) / 2 closed terms to the t tail with
t^2 = m F for odd m, or to x^(df/2) for even m.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 6.0            # |t| from which the tail terms are summed
COUNTS = 37.0        # -ln(1e-16): terms below that share of the first no longer count


def _series(t2: Column, df: Column) -> Column:
    """struct(term, mid, head, tail): the sum before the N-th term, that term
    (``mid``), and the sum from it on; one pass."""
    x = df / (df + t2)
    n = F.floor(df / 2)
    a = df % 2
    beyond = F.when(t2 > FAR * FAR, F.ceil(F.least(COUNTS * df / t2, F.lit(1e6))) + 60).otherwise(0)
    zero = F.lit(0.0)

    def step(s, k):
        at = k - 1
        return F.struct((s["term"] * (x * ((2 * k - 1 + a) / (2 * k + a)))).alias("term"),
                        F.when(at == n, s["term"]).otherwise(s["mid"]).alias("mid"),
                        F.when(at < n, s["head"] + s["term"]).otherwise(s["head"]).alias("head"),
                        F.when(at >= n, s["tail"] + s["term"]).otherwise(s["tail"]).alias("tail"))

    start = F.struct(F.lit(1.0).alias("term"), zero.alias("mid"), zero.alias("head"), zero.alias("tail"))
    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), n + beyond + 1), start, step)


def _t_tail(t2: Column, df: Column, s: Column) -> Column:
    x = df / (df + t2)
    sine, cosine = F.sqrt(t2 / (df + t2)), F.sqrt(x)
    odd = (df % 2) == 1
    scale = F.when(odd, sine * cosine * (2 / math.pi)).otherwise(sine)
    angle = F.when(odd, F.atan(F.sqrt(t2 / df)) * (2 / math.pi)).otherwise(F.lit(0.0))
    return F.when(t2 > FAR * FAR, scale * s["tail"]).otherwise(F.greatest(F.lit(0.0), 1 - (angle + scale * s["head"])))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for T with ``df`` degrees of freedom (a whole number of at
    least 1, else NULL); NULL for a NULL or NaN t."""
    t2 = t * t
    df = df.cast("bigint")
    ok = t.isNotNull() & ~F.isnan(t) & (df >= 1)
    wide = df.cast("double")
    return F.when(ok, F.when(t2 == math.inf, 0.0).otherwise(_t_tail(t2, wide, _series(t2, wide))))


def f_upper(f: Column, m: Column, df: Column) -> Column:
    """P(F >= f) with ``m`` and ``df`` degrees of freedom (whole numbers of at least
    1, else NULL); 1 for f <= 0."""
    ok = f.isNotNull() & ~F.isnan(f) & (m >= 1) & (df >= 1)
    m, df = m.cast("bigint").cast("double"), df.cast("bigint").cast("double")
    t2 = F.greatest(f, F.lit(0.0)) * m
    x, y = df / (df + t2), t2 / (df + t2)
    half = df / 2
    s = _series(t2, df)
    odd_m, odd_df = (m % 2) == 1, (df % 2) == 1
    n = F.floor(half)
    # the first closed term stands at b = 1/2 (odd m) or b = 1 (even m), the next ones at b + 1, b + 2, ...
    whole = F.pow(x, half)
    start = F.when(odd_m, _t_tail(t2, df, s)).otherwise(whole)
    first = F.when(~odd_m, whole * y * half).when(odd_df, F.sqrt(y) * F.sqrt(x) * (2 * n + 1) * s["mid"] * (2 / math.pi)).otherwise(
        F.sqrt(y) * 2 * n * s["mid"])
    b = F.when(odd_m, 0.5).otherwise(1.0)
    count = F.floor((m - 1) / 2)
    more = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), count - 1), F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda s, k: F.struct((s["term"] * (y * ((half + b + k) / (b + k + 1)))).alias("term"), (s["sum"] + s["term"]).alias("sum")))["sum"]
    return F.when(ok, F.when(f <= 0, 1.0).otherwise(F.least(F.lit(1.0), start + F.when(count > 0, more).otherwise(0.0))))
