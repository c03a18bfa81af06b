"""The number of tasks of the series operators follows the rows, not the session's settings."""

import datetime as dt

import pytest

from mixlens.operators import regression as R
from mixlens.operators.features import KEY, SESSIONS_SPEC
from mixlens.plans import context as C
from mixlens.sources import tables as T


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    first = dt.date(1999, 1, 1)
    days = [first + dt.timedelta(days=i) for i in range(60)]
    lines = [(s, day, float((s * 7 + i) % 13)) for s in range(50) for i, day in enumerate(days)]
    spark.createDataFrame(lines, "l_suppkey bigint, l_shipdate date, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    orders = [(i, day, 100.0 + (i * 37) % 11, ("1-URGENT", "2-HIGH")[i % 2], "FO"[i % 3 == 0]) for i, day in enumerate(days)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderdate date, o_totalprice double, o_orderpriority string, "
                                  "o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    return d


def test_parts_grow_with_the_rows_in_whole_waves(spark, folder):
    cores = spark.sparkContext.defaultParallelism
    assert T.series_parts(spark, folder) == cores
    assert T.series_parts(spark, folder, 10) == cores * -(-3000 // (10 * cores))


def test_panel_and_design_are_dealt_to_that_many_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(C, "series_parts", lambda spark, sf: 40)
    dealt = C.panel_by_product(spark, folder)
    assert dealt.rdd.getNumPartitions() == 40 and dealt.count() == 3000
    assert C.panel_train_by_product(spark, folder).rdd.getNumPartitions() == 40
    assert max(dealt.rdd.glom().map(len).collect()) < 3000 / 4
    _, scaled = R.fit(dealt, SESSIONS_SPEC, buckets=40)
    plan = scaled.groupBy(KEY).count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "40 out of 40" in plan and "Exchange" not in plan
