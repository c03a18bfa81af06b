import numpy as np
import pytest

from conftest import SF001
from mixlens.operators import search as SR
from mixlens.plans.context import panel_drivers


def test_search_matches_per_candidate_lstsq(spark):
    pdr = panel_drivers(spark, SF001)
    res = SR.search(pdr).toPandas()
    design = SR.search_design(pdr).toPandas()
    cols = SR.superset()[1:]
    design = design.dropna(subset=["dep_var", *cols])
    pid = res["product_id"].iloc[0]
    g = design[design["product_id"] == pid]
    got = res[res["product_id"] == pid]
    assert len(got) == len(SR.candidates())
    for r, f, pw in SR.candidates():
        names = [*SR.SHARED, SR._tv(r), f"fx_{f}", SR._vis(pw)]
        x = np.column_stack([np.ones(len(g))] + [g[c].to_numpy(float) for c in names])
        y = g["dep_var"].to_numpy(float)
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        rmse = float(np.sqrt(np.mean((y - x @ beta) ** 2)))
        row = got[(got.adstock_rate == r) & (got.fx_transform == f) & (got.visibility_power == pw)].iloc[0]
        assert row.rmse == pytest.approx(rmse, rel=1e-6, abs=1e-6)
    assert sorted(got.fit_rank) == list(range(1, len(got) + 1))
    assert got.sort_values("fit_rank").rmse.is_monotonic_increasing
