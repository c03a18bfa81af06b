import datetime as dt
import os
import tempfile

from mixlens.sources import io as IO
from mixlens.functions.scalar import parse_dmy, week_commencing


def test_parse_dmy_both_separators(spark):
    df = spark.createDataFrame([("25/12/2017",), ("01-01-2018",), ("junk",)], "d string")
    got = [r[0] for r in df.select(parse_dmy("d")).collect()]
    assert got == [dt.date(2017, 12, 25), dt.date(2018, 1, 1), None]


def test_week_commencing(spark):
    df = spark.createDataFrame([(dt.date(2017, 1, 7),), (dt.date(2017, 1, 8),), (dt.date(2017, 12, 31),)], "d date")
    got = [r[0] for r in df.select(week_commencing("d")).collect()]
    assert got == [dt.date(2017, 1, 1), dt.date(2017, 1, 8), dt.date(2017, 12, 31)]


def test_csv_round_trip_and_models(spark):
    d = tempfile.mkdtemp(prefix="mixlens-io-")
    meta = os.path.join(d, "meta.csv")
    with open(meta, "w") as f:
        f.write("Date,TV Ad Reach,Consumer Confidence Index,Exchange Rate,Online Visibility,Weather Index\n")
        f.write("25/12/2017,1.5,100,1.1,3,average\n01-01-2018,0,99,1.2,4,worse than average\n")
    m = IO.read_meta_csv(spark, meta).orderBy("date").collect()
    assert m[0].date == dt.date(2017, 12, 25) and m[1].weather_index == "worse than average"
    assert "consumer_confidence_index" in m[0].asDict()
    g = os.path.join(d, "groups.csv")
    with open(g, "w") as f:
        f.write("Var_Name,Grouping\nConsumer.Confidence.Index,Consumer_Confidence\n")
    assert IO.read_groupings_csv(spark, g).first().var_name == "consumer_confidence_index"
    seg = spark.createDataFrame([("1", "type_1")], "product_id string, product_type string")
    IO.write_segments_csv(seg, os.path.join(d, "seg"))
    back = spark.read.option("header", True).csv(os.path.join(d, "seg")).collect()
    assert back[0].asDict() == {"product_id": "1", "product_type": "type_1"}
    sheet = os.path.join(d, "sheet.csv")
    with open(sheet, "w") as f:
        f.write("product_id,product_type\n1,\n2,\n")
    ans = {r.product_id: r.product_type for r in IO.answer_sheet(spark, sheet, seg).collect()}
    assert ans == {"1": "type_1", "2": None}
    models = spark.createDataFrame([("sessions", "1", [1.0, 2.0])], "target string, product_id string, coef array<double>")
    IO.write_models(models, os.path.join(d, "models"))
    assert IO.read_models(spark, os.path.join(d, "models"), "sessions").first().coef == [1.0, 2.0]


def test_csv_columns_go_by_header(spark, tmp_path):
    import pytest
    f = tmp_path / "panel.csv"
    f.write_text("date,bookings,product_id,sessions\n2017-01-01,3,7,90\n")
    r = IO.read_panel_csv(spark, str(f)).first()
    assert (r.product_id, str(r.date), r.sessions, r.bookings) == ("7", "2017-01-01", 90, 3)
    f.write_text("date,bookings,product_id\n2017-01-01,3,7\n")
    with pytest.raises(ValueError, match="sessions"):
        IO.read_panel_csv(spark, str(f))
    g = tmp_path / "g.csv"
    g.write_text("Grouping,Var_Name\nSeasonality,DayFriday\n")
    assert IO.read_groupings_csv(spark, str(g)).first().var_name == "day_friday" == IO.snake("DayFriday")


# --- fixed values: the 24 dictionary rows as a user's file spells them ---------------
DICTIONARY = """Var_Name,Grouping
Date,Date
product_id,Product
Dep_Var,Dep_Var
bookings,Dep_Var
Day,Seasonality
DayFriday,Seasonality
DaySaturday,Seasonality
DaySunday,Seasonality
month,Seasonality
TV_adstock,TV
xmas,Seasonality
Consumer.Confidence.Index,Consumer_Confidence
Exchange.Rate,Exchange_Rate
exchange_rate_moving_av,Exchange_Rate
Online.Visibility,Online_Visibility
average_weather_days,Weather
better_than_average_weather_days,Weather
worse_than_Average_weather_days,Weather
DayMonday,Seasonality
DayTuesday,Seasonality
DayWednesday,Seasonality
DayThursday,Seasonality
Intercept,Base_Sales
online_visibility_exp,Online_Visibility
"""
# -------------------------------------------------------------------------------------


def test_dictionary_of_24_terms(spark, tmp_path):
    from mixlens.sources.tables import TERM_GROUPS
    f = tmp_path / "groups.csv"
    f.write_text(DICTIONARY)
    found = IO.check_groupings_csv(spark, str(f))
    assert {r.var_name: r.grouping for r in found.rows.collect()} == TERM_GROUPS and len(TERM_GROUPS) == 24
    assert found.rejects.count() == 0


def test_every_file_by_its_own_header_and_faults_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("product_id,date,sessions,bookings\n1,2017-01-01,10,1\n\n2,2017-01-01,ten,1\n3,2017-13-01,10,1\n")
    (tmp_path / "b.csv").write_text("﻿Bookings,Note,Sessions,Date,Product ID\r\n7,\"a, b\",70,2017-01-02,4\r\n8,x,80,,5\r\n9,x,90,2017-01-03\r\n")
    (tmp_path / "c.csv").write_text("product_id,date,sessions\n6,2017-01-04,5\n")
    (tmp_path / "d.csv").write_text("product_id,date,sessions,bookings\n8,2017-01-05,,2\n")
    found = IO.check_panel_csv(spark, str(tmp_path))
    rows = {tuple(r) for r in found.rows.collect()}
    day = lambda d: dt.date(2017, 1, d)
    assert rows == {("1", day(1), 10, 1), ("4", day(2), 70, 7), ("8", day(5), None, 2)}
    faults = {(os.path.basename(r.file), r.record, r.column, r.reason, r.value) for r in found.rejects.collect()}
    assert faults == {
        ("a.csv", "2,2017-01-01,ten,1", "sessions", "not_bigint", "ten"), ("a.csv", "3,2017-13-01,10,1", "date", "not_date", "2017-13-01"),
        ("b.csv", "8,x,80,,5", "date", "missing_value", None), ("b.csv", "9,x,90,2017-01-03", None, "field_count", None),
        ("c.csv", "6,2017-01-04,5", "bookings", "missing_column", None)}


def test_driver_file_with_both_separators_and_bad_dates(spark, tmp_path):
    f = tmp_path / "meta.csv"
    f.write_text("Date,TV Ad Reach,Consumer Confidence Index,Exchange Rate,Online Visibility,Weather Index\n"
                 "25/12/2017,1.5,100,1.1,3,average\n01-01-2018,0,99,1.2,4,worse than average\n2018/01/02,0,99,1.2,4,average\n")
    found = IO.check_meta_csv(spark, str(f))
    assert sorted(r.date for r in found.rows.collect()) == [dt.date(2017, 12, 25), dt.date(2018, 1, 1)]
    assert [(r.column, r.reason, r.value) for r in found.rejects.collect()] == [("date", "not_date", "2018/01/02")]
    empty = tmp_path / "none.csv"
    empty.write_text("")
    assert IO.read_meta_csv(spark, str(empty)).count() == 0


def test_model_store_runs(spark, tmp_path):
    import pytest
    store = IO.ModelStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.load("sessions")
    kind = "target string, product_id string, coef array<double>"
    for run, value in (("first", 1.0), ("second", 2.0)):
        store.save(spark.createDataFrame([("sessions", "1", [value]), ("bookings", "1", [value + 10])], kind), run)
    # models without an entry in the list of runs do not count
    spark.createDataFrame([("sessions", "1", [9.0])], kind).write.partitionBy("target").parquet(f"{store.path}/models/run=third")
    assert store.runs() == ["first", "second"] and store.load("sessions").first().coef == [2.0]
    found = store.load("bookings", "first")
    assert found.first().coef == [11.0] and found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "run" in filters and "target" in filters
    with pytest.raises(ValueError):
        store.save(spark.createDataFrame([], kind), "first")
