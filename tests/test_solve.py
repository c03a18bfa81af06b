"""Batched sweeps against one-by-one least squares, and the notes on fits."""

import numpy as np

from mixlens.operators import regression as R
from mixlens.operators import search as SE


def plain(a, b, tol):
    """One system: admit terms in order, solve for the admitted ones."""
    keep = []
    for k in range(len(b)):
        rest = a[k, k] - (a[k, keep] @ np.linalg.solve(a[np.ix_(keep, keep)], a[keep, k]) if keep else 0.0)
        if a[k, k] > 0 and rest > tol * a[k, k]:
            keep.append(k)
    inverse = np.linalg.inv(a[np.ix_(keep, keep)])
    return keep, inverse @ b[keep], np.diag(inverse)


def systems(rows=40, p=7):
    rng = np.random.default_rng(3)
    xtx, xty = [], []
    for r in range(rows):
        x = rng.normal(size=(30, p)) * rng.uniform(0.1, 50, size=p)
        x[:, 0] = 1.0
        if r % 4 == 1:
            x[:, 3] = 2 * x[:, 1] - x[:, 2]          # aliased
        if r % 4 == 2:
            x[:, 5] = 0.0                             # constant after scaling
        if r % 4 == 3:
            x[:, 2] = x[:, 1]
            x[:, 6] = 0.0
        xtx.append(x.T @ x)
        xty.append(x.T @ rng.normal(size=30))
    return np.array(xtx), np.array(xty)


def test_batch_equals_one_by_one():
    xtx, xty = systems()
    coef, inverse, admitted = R.solve_batch(xtx, xty)
    for r in range(len(xtx)):
        keep, beta, diagonal = plain(xtx[r], xty[r], R.ALIAS_TOL)
        assert np.flatnonzero(admitted[r]).tolist() == keep
        assert np.allclose(coef[r, keep], beta, rtol=1e-8) and np.allclose(inverse[r, keep], diagonal, rtol=1e-8)
    assert R.solve_batch(xtx[:0], xty[:0])[0].shape == (0, 7)
    broken = xtx.copy()
    broken[0, 2, 2] = np.nan                          # one unusable system does not touch the others
    assert np.allclose(R.solve_batch(broken, xty)[0][1:], coef[1:])


def test_branches_equal_single_solves():
    xtx, xty = systems(12, 7)
    subs = [[0, 1, 2, 3, 5], [0, 1, 2, 3, 6], [0, 1, 2, 4, 5], [0, 1, 2, 4, 6]]
    coefs, ranks = SE.solve_branches(xtx, xty, subs, R.ALIAS_TOL)
    for c, idx in enumerate(subs):
        for r in range(len(xtx)):
            keep, beta, _ = plain(xtx[r][np.ix_(idx, idx)], xty[r][idx], R.ALIAS_TOL)
            want = np.zeros(len(idx))
            want[keep] = beta
            assert ranks[r, c] == len(keep) and np.allclose(coefs[r, c], want, rtol=1e-8)
