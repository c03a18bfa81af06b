"""Every query with an oracle: Spark result == DuckDB result on the sf0.001 tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from conftest import SF001  # noqa: E402
from oracle_check import norm, TABLES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


# one query per operator family by default; MIXLENS_ALL_ORACLES=1 runs every oracle
FAMILY = ["total_layer", "panel_with_drivers", "event_dummy", "adstock_multi_rate", "fx_rolling_mean",
          "centered_mean_extend", "interpolated_fx", "features_bookings", "features_horizon", "gram_by_product",
          "ols_total", "coef_table", "contribution_weekly", "contribution_share", "segment_features",
          "forecast_horizon_scaled", "transform_grid", "product_stats", "fit_summary", "fit_status", "transform_search",
          "elbow", "product_groupings", "long_series", "residual_diagnostics", "csv_rejects",
          "daily_conversion_long", "event_dummy_market", "features_sessions_strict", "ols_total_bookings",
          "contribution_total_annual_bookings", "one_product_view", "one_product_overlay"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("MIXLENS_ALL_ORACLES") else FAMILY


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    s = E.queries()[name](spark, SF001).toPandas()
    d = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert norm(s).equals(norm(d))


def test_every_query_of_the_survey_has_an_oracle():
    from mixlens.plans.queries import ORACLE_SQL, QUERIES
    assert set(QUERIES) == set(ORACLE_SQL) <= set(E.queries())
