"""The solvers against each other, against the optimum's conditions, and on one giant component."""

import resource
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage.operators import concordance, estimation, fits, robustness


def problem(rng, n_from, n_to, pairs, links):
    """(M, N, row, target) of random shares; links sorted by code."""
    x, y = rng.random((pairs, n_from)) * (rng.random((pairs, n_from)) < 0.7), rng.random((pairs, n_to)) * (rng.random((pairs, n_to)) < 0.7)
    x, y = x / max(x.sum(), 1e-9), y / max(y.sum(), 1e-9)
    row, target = np.array(sorted(links)).T
    return x.T @ x, x.T @ y, row, target


def stacked(m, n, row, target):
    return (m[np.ix_(row, row)] * (target[:, None] == target))[None], n[row, target][None], row[None]


def optimal(h, n, row, x):
    """The gradient of links in use is the least of their code's, and sums are one."""
    grad = h[0] @ x - n[0]
    for r in np.unique(row):
        own = row[0] == r
        assert abs(x[own].sum() - 1) < 1e-9 and (x[own] >= 0).all()
        assert (grad[own & (x > 1e-7)] - grad[own].min() < 1e-7 * np.trace(h[0])).all()


def all_links(n_from, n_to):
    return [(i, j) for i in range(n_from) for j in range(n_to)]


@pytest.mark.parametrize("seed", range(12))
def test_dense_and_sparse_fits_are_optimal(seed):
    rng = np.random.default_rng(seed)
    n_from, n_to = rng.integers(1, 5), rng.integers(2, 6)
    links = [e for e in all_links(n_from, n_to) if rng.random() < 0.7]
    links += [(i, 0) for i in range(n_from) if not any(e[0] == i for e in links)]
    m, n, row, target = problem(rng, n_from, n_to, int(rng.integers(1, 30)), links)
    h, b, rows = stacked(m, n, row, target)
    x, solved = fits.dense_fits(h, b, rows)
    assert solved.all()
    optimal(h, b, rows, x[0])
    i, k = np.nonzero(m)
    z, _ = fits.sparse_fit(i, k, m[i, k], n[row, target], row, target, tol=1e-13)
    value = lambda w: w @ h[0] @ w - 2 * b[0] @ w
    assert value(x[0]) <= value(z) + 1e-9 * np.trace(h[0]) and value(z) <= value(x[0]) + 1e-7 * np.trace(h[0])


def test_equal_values_go_to_the_nearest_to_equal():
    """Two codes with trade in one pair: only a sum of their weights is told; and clipped at 0 or 1 where it must be."""
    row, target = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    for a, share in ((0.3, 0.6), (0.3, 0.95), (0.1, 0.02), (0.5, 0.5)):
        x, y = np.array([[a, 1 - a]]), np.array([[share, 1 - share]])
        h, n, rows = stacked(x.T @ x, x.T @ y, row, target)
        w, solved = fits.dense_fits(h, n, rows)
        grid = np.linspace(0, 1, 2001)
        q = (share - a * grid) / (1 - a)
        ok = (q >= 0) & (q <= 1)
        best = np.argmin(np.where(ok, (grid - 0.5) ** 2 + (q - 0.5) ** 2, 9))
        assert solved.all() and w[0, 0] == pytest.approx(grid[best], abs=2e-3) and w[0, 2] == pytest.approx(q[best], abs=2e-3)


def test_starts_do_not_matter():
    rng = np.random.default_rng(3)
    m, n, row, target = problem(rng, 3, 4, 2, all_links(3, 4))
    h, b, rows = stacked(m, n, row, target)
    cold, _ = fits.dense_fits(h, b, rows)
    for _ in range(5):
        start = rng.random((3, 4))
        start = (start / start.sum(axis=1, keepdims=True)).reshape(1, -1)
        warm, solved = fits.dense_fits(h, b, rows, start)
        assert solved.all() and np.abs(warm - cold).max() < 1e-6


def test_batches_are_solved_as_one_by_one():
    rng = np.random.default_rng(4)
    made = [stacked(*problem(rng, 2, 3, 5, all_links(2, 3))) for _ in range(200)]
    h, n, row = (np.concatenate(x) for x in zip(*made))
    x, solved = fits.dense_fits(h, n, row)
    assert solved.all()
    for k in range(0, 200, 23):
        assert np.abs(x[k] - fits.dense_fits(*made[k])[0][0]).max() < 1e-9


def test_a_component_of_5000_codes():
    """A chain of codes, each with three links: 15,000 links in under 1 GB and a minute."""
    rng, n = np.random.default_rng(5), 5000
    links = sorted({(i, (i + d) % n) for i in range(n) for d in range(3)})
    row, target = np.array(links).T
    truth = rng.random(len(row))
    truth /= np.bincount(row, truth)[row]
    pairs = 40_000
    code, pair, value = rng.integers(0, n, 3 * pairs), np.repeat(np.arange(pairs), 3), rng.random(3 * pairs)
    value /= value.sum()
    order = np.lexsort((code, pair))
    code, value = code[order].reshape(-1, 3), value[order].reshape(-1, 3)
    i, k = np.repeat(code, 3, axis=1).ravel(), np.tile(code, 3).ravel()
    v = (np.repeat(value, 3, axis=1) * np.tile(value, 3)).ravel()
    key, at = np.unique(i * n + k, return_inverse=True)
    i, k, v = key // n, key % n, np.bincount(at, v)
    place = {e: q for q, e in enumerate(zip(row.tolist(), target.tolist()))}
    cross = np.zeros(len(row))  # N = M B on the links, so B is the solution
    by_row = [np.flatnonzero(row == r) for r in range(n)]
    for a, b, m in zip(i.tolist(), k.tolist(), v.tolist()):
        for link in by_row[b]:
            own = place.get((a, int(target[link])))
            if own is not None:
                cross[own] += m * truth[link]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    x, solved = fits.sparse_fit(i, k, v, cross, row, target)
    assert solved and time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    told = np.isin(row, np.unique(code))
    assert np.abs(x - truth)[told].max() < 1e-3


def trade_and_links(spark, rng, groups=30):
    """Groups of up to 4 x 4 codes, one of 12 x 12 (over FEW links), with trade of a few pairs each."""
    edges, trade = [], []
    for g in range(groups):
        size = 12 if g == 0 else int(rng.integers(2, 5))
        for i in range(size):
            edges += [("20002001", "2000", "2001", f"{g:04d}{i:04d}", f"{g:04d}{j:04d}") for j in {i, (i + 1) % size, int(rng.integers(size))}]
        for p in range(12):
            for side, year in (("a", 2000), ("b", 2001)):
                trade += [(f"R{p}", "P", "I", f"{g:04d}{c:04d}", "1", year, float(rng.integers(1, 99)), 1.0) for c in range(size) if rng.random() < 0.6]
    edges = spark.createDataFrame(sorted(set(edges)), "period string, vintage_a_year string, vintage_b_year string, vintage_a_code string, vintage_b_code string")
    return spark.createDataFrame(trade, "REPORTER string, PARTNER string, TRADE_TYPE string, PRODUCT_NC string, FLOW string, PERIOD int, VALUE_EUR double, QUANTITY_KG double"), edges


def test_refits_equal_cold_fits_without_the_bin(spark):
    """Every refit, warm or taken over from the full fit, is the fit of the shares without its bin."""
    trade, edges = trade_and_links(spark, np.random.default_rng(7))
    groups = concordance.build_groups(edges)
    shares = estimation.side_shares(trade, groups)
    used = estimation.usable_shares(shares, estimation.group_totals(shares, groups))
    bins = robustness.holdout_bins(used, 20)
    got = {(r.group_id, r.direction, r.bin, r.from_code, r.to_code): r.weight for r in robustness.bin_weights(used, bins, groups).collect()}
    for b in (0, 7, 19):
        left = robustness.without_bin(used, bins, b)
        total = left.groupBy(*estimation.KEY, "side").agg(F.sum("value").alias("total"))
        left = left.drop("total", "share").join(total, [*estimation.KEY, "side"]).withColumn("share", F.col("value") / F.col("total"))
        cold = estimation.fitted_weights(estimation.normal_moments(left), groups).collect()
        assert len(cold) == sum(k[2] == b for k in got)
        assert all(r.status == "solved" and abs(got[r.group_id, r.direction, b, r.from_code, r.to_code] - r.weight) < 1e-6 for r in cold)


def test_refits_take_whole_groups_and_leave_emptied_runs_out(spark, monkeypatch):
    """Sums come in pieces of a few rows; the runs are those of the general fits, with totals and shares
    from one join and pairs that carry their rows. A group whose one pair is left out has no such run."""
    monkeypatch.setattr(fits, "ROWS", 50)
    trade, edges = trade_and_links(spark, np.random.default_rng(3), groups=6)
    lone = [("R1", "P", "I", f"9999000{c}", "1", 2000 + (c > 0), 5.0 + c, 1.0) for c in range(3)]
    trade = trade.unionByName(spark.createDataFrame(lone, trade.schema))
    links = [("20002001", "2000", "2001", "99990000", f"9999000{c}") for c in (1, 2)]
    groups = concordance.build_groups(edges.unionByName(spark.createDataFrame(links, edges.schema)))
    used, totals = estimation.used_shares(trade, groups)
    shares = estimation.side_shares(trade, groups)
    assert sorted(used.collect()) == sorted(estimation.usable_shares(shares, totals).collect())
    dealt, bins = robustness.dealt_pairs(used, 4), robustness.holdout_bins(used, 4)
    assert sorted(dealt.drop("rows").collect()) == sorted(bins.collect())
    got = {tuple(r)[:-1]: r.weight for r in robustness.bin_weights(used, dealt, groups).collect()}
    general = {tuple(r)[:6] + (r.bin,): r.weight for r in robustness._of_large(used, bins, groups, [0, 1, 2, 3]).collect()}
    assert got.keys() == general.keys() and max(abs(got[k] - general[k]) for k in got) < 1e-6
    own = {r.bin for r in bins.collect() if r.group_id == max(k[3] for k in got)}
    assert len(own) == 1 and {k[6] for k in got if k[4] == "99990000"} == {0, 1, 2, 3} - own
