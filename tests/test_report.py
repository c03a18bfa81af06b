import os
import tempfile

from conftest import SF001
from mixlens.plans.report import build_report


def test_report_writes_every_output(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="mixlens-report-"), "run")
    paths = build_report(spark, SF001, out)
    models = spark.read.parquet(paths["models"])
    assert {r.target for r in models.select("target").distinct().collect()} == {"sessions", "bookings"}
    groups = spark.read.option("header", True).csv(paths["product_groupings"])
    assert groups.columns == ["product_id", "product_type"]
    n_ok = models.filter("target = 'sessions' and status = 'ok'").count()
    preds = spark.read.parquet(paths["predictions"])
    assert preds.select("product_id").distinct().count() == n_ok
    daily = spark.read.parquet(paths["contributions_daily"])
    assert daily.select("driver_group").distinct().count() == 7
    assert spark.read.parquet(paths["elbow"]).count() >= 2


def test_report_and_scores_from_csv_files(spark, tmp_path):
    import datetime as dt
    from pyspark.sql import functions as F
    from mixlens.operators.features import BOOKINGS_SPEC, SESSIONS_SPEC
    from mixlens.plans import report, score
    from mixlens.sources import io as IO
    from mixlens.sources.tables import meta_series, product_series
    from test_io import DICTIONARY
    panel = product_series(spark, SF001).filter("product_id in ('1', '2', '3', '4', '5')")
    panel.write.option("header", True).csv(str(tmp_path / "panel"))
    (tmp_path / "panel" / "broken.csv").write_text("product_id,date,sessions,bookings\n1,1999-01-01,many,1\n")
    meta_series(spark, SF001).withColumn("date", F.date_format("date", "d/M/yyyy")).write.option("header", True).csv(str(tmp_path / "meta"))
    (tmp_path / "groups.csv").write_text(DICTIONARY)
    out = str(tmp_path / "out")
    report.main(["--panel", str(tmp_path / "panel"), "--meta", str(tmp_path / "meta"), "--groupings", str(tmp_path / "groups.csv"),
                 "--out", out, "--k", "2"])
    assert spark.read.parquet(f"{out}/rejects").select("input", "value").collect() == [("panel", "many")]
    # the same report from the tables themselves
    want = report.build_report(spark, report.Inputs(panel, meta_series(spark, SF001)), str(tmp_path / "direct"), k=2)
    for name in ("predictions", "contributions_by_product"):
        a, b = (spark.read.parquet(f"{o}/{name}") for o in (out, str(tmp_path / "direct")))
        keys = [c for c in a.columns if dict(a.dtypes)[c] != "double"]
        j = a.join(b.toDF(*[c if c in keys else f"{c}_w" for c in b.columns]), keys)
        assert j.count() == a.count() == b.count() > 0
        for c in (c for c in a.columns if c not in keys):
            assert j.filter(F.abs(F.col(c) - F.col(f"{c}_w")) > 1e-6 * (1 + F.abs(f"{c}_w"))).count() == 0
    # scoring is a job of its own
    store = IO.ModelStore(spark, str(tmp_path / "store"))
    store.save(spark.read.parquet(want["models"]), "today")
    score.main(["--models", store.path, "--meta", str(tmp_path / "meta"), "--out", str(tmp_path / "scores")])
    scores = spark.read.parquet(str(tmp_path / "scores"))
    assert scores.count() == spark.read.parquet(want["predictions"]).count()
    assert scores.agg(F.min("date")).first()[0] >= dt.date(2000, 1, 1)
    assert {s.target for s in (SESSIONS_SPEC, BOOKINGS_SPEC)} <= set(scores.columns)
