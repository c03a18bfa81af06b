"""Fits by increment equal fits over the whole history; only the new batch is read."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from mixlens.operators import increments as I
from mixlens.operators import regression as R
from mixlens.operators.features import DATE, KEY, SESSIONS_SPEC, build_design

FIRST = dt.date(1999, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """p0 on every day; p1 skips February; p2 begins in March; p3 has its tenth row
    in February; p4 never gets ten rows.  Rates are missing here and there."""
    rng = random.Random(8)
    days = {"p0": range(0, 100), "p1": [*range(0, 31), *range(59, 100)], "p2": range(62, 100), "p3": range(25, 100), "p4": range(40, 45)}
    out = [(p, FIRST + dt.timedelta(days=d), rng.randint(0, 50), rng.randint(0, 9), rng.uniform(0, 5), rng.uniform(90, 110),
            None if rng.random() < 0.1 else rng.uniform(1, 2), float(rng.randint(1, 30)), rng.choice([0.0, 1.0]), rng.choice([0.0, 1.0]))
           for p, ds in days.items() for d in ds]
    return spark.createDataFrame(out, f"{KEY} string, {DATE} date, sessions bigint, bookings bigint, tv_ad_reach double, "
                                      "consumer_confidence_index double, exchange_rate double, online_visibility double, "
                                      "better_than_average_weather_days double, worse_than_average_weather_days double").cache()


def months(rows):
    for low, high in (("1999-01-01", "1999-02-01"), ("1999-02-01", "1999-03-01"), ("1999-03-01", "1999-05-01")):
        yield low, rows.filter((F.col(DATE) >= F.lit(low).cast("date")) & (F.col(DATE) < F.lit(high).cast("date")))


def test_design_rows_equal_the_whole_history(spark, rows):
    state, found = I.no_state(spark, SESSIONS_SPEC), None
    for _, part in months(rows):
        ready, state = I.advance(part, state, SESSIONS_SPEC)
        found = ready if found is None else found.unionByName(ready)
    whole = build_design(rows, SESSIONS_SPEC)
    want = {(r[KEY], r[DATE]): r for r in whole.collect()}
    got = {(r[KEY], r[DATE]): r for r in found.collect()}
    # the product with five rows waits for its first full mean: no row of it can be fitted yet
    assert set(want) - set(got) == {k for k in want if k[0] == "p4"}
    assert all(r["exchange_rate_moving_av"] is None for k, r in want.items() if k[0] == "p4")
    assert state.filter("product_id = 'p4'").selectExpr("size(waiting)").first()[0] == 5
    for k, r in got.items():
        for c in ("dep_var", *SESSIONS_SPEC.terms):
            assert r[c] == pytest.approx(want[k][c], rel=1e-9, abs=1e-12) if r[c] is not None else want[k][c] is None, (k, c)


def test_fit_equals_the_fit_over_the_whole_history(spark, rows, tmp_path):
    store = I.MomentStore(spark, str(tmp_path / "store"), SESSIONS_SPEC)
    for name, part in months(rows):
        store.append(part, name)
    assert store.batches() == ["1999-01-01", "1999-02-01", "1999-03-01"]
    with pytest.raises(ValueError):
        store.append(rows, "1999-02-01")
    got = {r[KEY]: r for r in store.fit().collect()}
    want = {r[KEY]: r for r in R.fit(rows, SESSIONS_SPEC, keep_design=False)[0].collect()}
    assert set(got) == set(want) and {p: r["status"] for p, r in got.items()} == {p: r["status"] for p, r in want.items()}
    for p, r in got.items():
        assert (r["n"], r["rank"]) == (want[p]["n"], want[p]["rank"])
        for field in ("coef", "xtx_inv_diag", "scale_mean", "scale_sd"):
            for a, b in zip(r[field], want[p][field]):
                assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-7, abs=1e-9)), (p, field)


def test_a_broken_append_changes_nothing(spark, rows, tmp_path):
    store = I.MomentStore(spark, str(tmp_path / "store"), SESSIONS_SPEC)
    parts = list(months(rows))
    store.append(parts[0][1], parts[0][0])
    before = sorted(map(str, store.fit().collect()))
    broken = parts[1][1].withColumn("sessions", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        store.append(broken, parts[1][0])
    assert sorted(map(str, store.fit().collect())) == before and store.batches() == [parts[0][0]]


def test_an_append_reads_its_batch_and_the_last_state_only(spark, rows, tmp_path):
    store = I.MomentStore(spark, str(tmp_path / "store"), SESSIONS_SPEC)
    parts = list(months(rows))
    for name, part in parts[:2]:
        store.append(part, name)
    state = spark.read.parquet(f"{store.path}/state/batch={store.batches()[-1]}")
    ready, _ = I.advance(parts[2][1], state, SESSIONS_SPEC)
    assert min(r[0] for r in ready.select(DATE).collect()) >= dt.date(1999, 3, 1)
    plan = I.merged_gram(store.moments(), SESSIONS_SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_moments_are_computed_without_an_exchange_and_parts_merge(spark, rows):
    ready, _ = I.advance(rows, I.no_state(spark, SESSIONS_SPEC), SESSIONS_SPEC)
    whole = I.moments(ready.repartition(1, KEY).sortWithinPartitions(KEY, DATE), SESSIONS_SPEC)
    assert "Exchange" not in I.moments(ready, SESSIONS_SPEC)._jdf.queryExecution().executedPlan().toString()
    parts = I.moments(ready.repartition(7, DATE), SESSIONS_SPEC)          # months torn apart
    a, b = ({r[KEY]: r["m"] for r in I.merged_moments(m, SESSIONS_SPEC).collect()} for m in (whole, parts))
    assert set(a) == set(b)
    for p in a:
        assert a[p] == pytest.approx(b[p], rel=1e-9, abs=1e-9)
