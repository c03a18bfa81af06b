"""The block-wise series operators equal the one-partition ones, for any block length."""

import random

import pytest
from pyspark.sql import functions as F

from mixlens.operators import longseries as L
from mixlens.operators import series as S


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(4)
    n = 131
    rows = [(i, rng.uniform(-5, 50), None if rng.random() < 0.4 or 30 < i < 75 or i < 3 else rng.uniform(0, 9)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "t int, x double, gaps double").repartition(7).cache()


def values(df, col):
    return [r[0] for r in df.orderBy("t").select(col).collect()]


def same(a, b):
    assert len(a) == len(b)
    for p, q in zip(a, b):
        assert (p is None) == (q is None) and (p is None or p == pytest.approx(q, rel=1e-9, abs=1e-9)), (p, q)


# 4: blocks of blocks of blocks; 131 and 200: one block; 130: a last block of one row
@pytest.mark.parametrize("chunk", [10, 130, 200])
def test_equal_to_one_partition(spark, made, chunk):
    laid = L.lay_out(made, "t", chunk).cache()
    assert values(laid, "rn") == list(range(1, 132))
    assert laid.groupBy("blk").count().agg(F.max("count")).first()[0] <= chunk
    for rate in (0.8, 1.0):
        same(values(L.adstock(laid, "x", rate, out="a", chunk=chunk), "a"), values(S.adstock(made, "x", rate, order="t", out="a"), "a"))
    same(values(L.rolling_mean_right(laid, "gaps", 10, out="m", chunk=chunk), "m"),
         values(S.rolling_mean_right(made, "gaps", 10, order="t", out="m"), "m"))
    same(values(L.rolling_mean_center(laid, "x", 7, out="m", chunk=chunk), "m"),
         values(S.rolling_mean_center(made, "x", 7, order="t", suffix="_s"), "x_s"))
    same(values(L.lag(laid, "x", 3, out="l", chunk=chunk), "l"), values(S.lag(made, "x", 3, order="t", out="l"), "l"))
    same(values(L.interpolate(laid, "gaps", out="i", chunk=chunk), "i"), values(S.interpolate(made, "gaps", order="t", out="i"), "i"))
    same(values(L.zscore(laid, ["x", "gaps"]), "gaps_z"), values(S.zscore(made, "gaps", suffix="_z"), "gaps_z"))


def test_three_levels_of_blocks(spark, made):
    laid = L.lay_out(made, "t", 3)
    assert laid.agg(F.max("blk")).first()[0] == 43                      # 44 blocks, 15 groups, 5, 2
    same(values(L.adstock(laid, "x", 0.9, out="a", chunk=3), "a"), values(S.adstock(made, "x", 0.9, order="t", out="a"), "a"))
    same(values(L.interpolate(laid, "gaps", out="i", chunk=3), "i"), values(S.interpolate(made, "gaps", order="t", out="i"), "i"))
    with pytest.raises(ValueError):
        L.rolling_mean_right(laid, "x", 10, chunk=3)


def test_empty_short_and_all_missing(spark, made):
    none = L.lay_out(made.limit(0), "t", 4)
    assert L.adstock(none, "x", 0.5, chunk=4).count() == 0 and L.interpolate(none, "gaps", chunk=4).count() == 0
    few = L.lay_out(made.filter("t < 5"), "t", 4)
    assert values(L.rolling_mean_center(few, "x", 7, out="m"), "m") == [None] * 5
    bare = made.filter("t < 9").withColumn("gaps", F.lit(None).cast("double"))
    assert values(L.interpolate(L.lay_out(bare, "t", 4), "gaps", out="i", chunk=4), "i") == [None] * 9


def test_no_single_partition(spark, made):
    laid = L.lay_out(made, "t", 10)
    df = L.rolling_mean_right(L.adstock(laid, "x", 0.8, out="a", chunk=10), "gaps", 10, out="m", chunk=10)
    df = L.zscore(L.interpolate(df, "gaps", out="i", chunk=10), "x")
    plan = df._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Exchange SinglePartition" in line]
    # the two aggregates to one row (mean and SD) are the only single partitions: no window stands on one
    assert len(windows) <= 1
