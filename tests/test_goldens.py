"""Hand-checked cases as small DataFrames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage.functions import codes as C
from vintage.functions import metrics as M
from vintage.operators import apply, chain, concordance, estimation, fits, figures, panels, persistence, robustness, structure, synthetic, weights
from vintage.sources import trade as src


def edges_of(spark, *pairs, period="20002001"):
    z = lambda c: str(c).zfill(8) if str(c).isdigit() else str(c)
    return spark.createDataFrame([(period, period[:4], period[4:], z(a), z(b)) for a, b in pairs], "period string, vintage_a_year string, vintage_b_year string, vintage_a_code string, vintage_b_code string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_codes(spark):
    df = spark.createDataFrame([(" 12 34 ",), ("123456789",), ("48XXXXXX",), (None,)], "c string")
    assert [r[0] for r in df.select(C.normalise_code(F.col("c"))).collect()] == ["00001234", "123456789", "48XXXXXX", None]
    raw = spark.createDataFrame([("20002001.0", "12", "13.0"), ("2000", "1", "2"), ("20002001", "1x", "2"), ("20002001", "1.5", None), ("20002001", "12", "13")], "`Period` string, `Origin code` string, `Destination code` string")
    good, bad = src.ingest_concordance(raw)
    assert rows(good, "period", "vintage_a_code", "vintage_b_code") == [("20002001", "00000012", "00000013")]
    assert sorted(r.reason for r in bad.collect()) == ["bad period", "not an integer", "not digits"]
    assert rows(C.chain_steps(spark, 2003, 2001), "step_index", "period", "direction") == [(0, "20022003", "b_to_a"), (1, "20012002", "b_to_a")]
    assert C.chain_steps(spark, 2001, 2001).count() == 0
    kept = spark.createDataFrame([("QP",), ("DE",), (None,)], "r string").where(C.not_in(F.col("r"), ["QP"]))
    assert {r.r for r in kept.collect()} == {"DE", None}


def test_groups(spark):
    e = edges_of(spark, (1, 11), (1, 12), (2, 12), (2, 13), (3, 14), (4, 14), (3, 14))
    g = concordance.build_groups(e)
    got = rows(g.summary, "group_id", "n_vintage_a", "n_vintage_b", "n_edges", "a_to_b_ambiguous", "b_to_a_ambiguous")
    assert got == [("20002001_g000001", 2, 3, 4, True, True), ("20002001_g000002", 2, 1, 2, False, True)]
    shuffled = concordance.build_groups(e.orderBy(F.desc("vintage_b_code")).repartition(3))
    assert rows(shuffled.edges, "vintage_a_code", "group_id") == rows(g.edges, "vintage_a_code", "group_id")
    u = edges_of(spark, ("A", "A"), ("B", "C"), ("D", "E"), ("D", "F"))
    assert rows(concordance.unstable_codes(u), "side", "code") == [("a", "B"), ("a", "D"), ("b", "C"), ("b", "E"), ("b", "F")]


def fit(spark, links, a, b, direction="a_to_b"):
    """Fitted weights for trade of two years given as {(reporter, partner, code): value}."""
    e = edges_of(spark, *links)
    data = [(r, p, "I", str(c).zfill(8), "1", y, float(v)) for y, t in ((2000, a), (2001, b)) for (r, p, c), v in t.items()]
    t = spark.createDataFrame(data, "REPORTER string, PARTNER string, TRADE_TYPE string, PRODUCT_NC string, FLOW string, PERIOD int, VALUE_EUR double")
    out = estimation.estimate(t, concordance.build_groups(e), ["VALUE_EUR"])
    got = {(int(r.from_code), int(r.to_code)): r.weight for r in out["weights_ambiguous"].where(F.col("direction") == direction).collect()}
    return got, out


def test_fits(spark):
    split, out = fit(spark, [(1, 11), (1, 12)], {("NL", "BE", 1): 60, ("NL", "FR", 1): 40}, {("NL", "BE", 11): 60, ("NL", "FR", 11): 40})
    assert split == pytest.approx({(1, 11): 1.0, (1, 12): 0.0}, abs=1e-6)
    closed = estimation.pure_split_weights(out["moments"], concordance.build_groups(edges_of(spark, (1, 11), (1, 12))))
    assert {int(r.to_code): r.weight for r in closed.where("direction = 'a_to_b'").collect()} == pytest.approx({11: 1.0, 12: 0.0}, abs=1e-9)
    merge, _ = fit(spark, [(1, 11), (2, 11)], {("NL", "BE", 1): 1, ("NL", "FR", 1): 1, ("NL", "BE", 2): 3, ("NL", "FR", 2): 3}, {("NL", "BE", 11): 1, ("NL", "FR", 11): 1}, "b_to_a")
    assert merge == pytest.approx({(11, 1): 0.25, (11, 2): 0.75}, abs=1e-6)
    mixed, _ = fit(spark, [(1, 11), (1, 12), (2, 12)], {("NL", "BE", 1): 100, ("NL", "FR", 2): 50}, {("NL", "BE", 11): 60, ("NL", "BE", 12): 40, ("NL", "FR", 12): 50})
    assert mixed == pytest.approx({(1, 11): 0.6, (1, 12): 0.4, (2, 12): 1.0}, abs=1e-5)


def test_noisy_fit_reaches_the_grid_optimum():
    x, y = np.array([[80.0, 20], [20, 80]]) / 200, np.array([[70.0, 20], [10, 100]]) / 200
    row, target = np.array([1, 1, 2, 2]), np.array([1, 2, 1, 2])
    m, n = x.T @ x, x.T @ y
    (b,), (solved,) = fits.dense_fits((m[row - 1][:, row - 1] * (target[:, None] == target))[None], n[row - 1, target - 1][None], row[None])
    b = b.reshape(2, 2)
    grid = np.linspace(0, 1, 401)
    best = min(np.sum((y - x @ np.array([[p, 1 - p], [q, 1 - q]])) ** 2) for p in grid for q in grid)
    assert solved and np.sum((y - x @ b) ** 2) <= best + 1e-5
    assert np.allclose(b.sum(axis=1), 1) and (b >= 0).all()


def test_skips_and_zero_columns(spark):
    got, out = fit(spark, [(1, 11), (1, 12)], {("NL", "BE", 1): 5}, {("NL", "BE", 99): 1})
    assert got == {} and [r.skip_reason for r in out["totals"].where("direction = 'a_to_b'").collect()] == ["zero_total_b"]
    got, _ = fit(spark, [(1, 11), (1, 12), (2, 12), (2, 13)], {("NL", "BE", 1): 5}, {("NL", "BE", 11): 5})
    assert (got[2, 12], got[2, 13]) == (0.5, 0.5)


def weight_rows(spark, *r):
    return spark.createDataFrame([("m", str(a), str(b), float(w)) for a, b, w in r], "measure string, from_code string, to_code string, weight double")


def test_finalise(spark):
    w = weight_rows(spark, (1, 11, 0.999), (1, 12, 5e-11), (2, 21, 0.5), (2, 22, 0.5), (2, 23, -5e-7))
    assert rows(weights.finalise(w, ["measure"]), "from_code", "to_code", "weight") == [("1", "11", 1.0), ("2", "21", 0.5), ("2", "22", 0.5)]
    assert rows(weights.violations(weight_rows(spark, (1, 1, -1e-5), (1, 2, 1.0)), ["measure"]), "reason") == [("negative",)]
    with pytest.raises(ValueError):
        weights.assert_empty(w, "rows")
    assert rows(weights.invalid(weight_rows(spark, (1, 1, 0.5)), ["measure"]), "reason") == [("row sum",)]


def test_compose_carry_and_strict(spark):
    left = weight_rows(spark, (1, 11, 0.6), (1, 12, 0.4), (2, 12, 1))
    full = weight_rows(spark, (11, 21, 1), (12, 21, 0.5), (12, 22, 0.5))
    out, _ = chain.compose(left, full)
    assert [(a, b, round(w, 9)) for a, b, w in rows(out, "from_code", "to_code", "weight")] == [("1", "21", 0.8), ("1", "22", 0.2), ("2", "21", 0.5), ("2", "22", 0.5)]
    out, bad = chain.compose(left, weight_rows(spark, (11, 21, 1)))
    assert rows(out, "from_code", "to_code", "weight") == [("1", "12", 0.4), ("1", "21", 0.6), ("2", "12", 1.0)] and bad.count() == 0
    out, bad = chain.compose(left, weight_rows(spark, (11, 21, 1)), spark.createDataFrame([("12",)], "code string"))
    assert rows(out, "from_code", "to_code", "weight") == [("1", "21", 0.6)] and rows(bad, "code") == [("12",)]


def test_backward_range(spark):
    steps = spark.createDataFrame([("20072008", "b_to_a", "m", "1", "11", 1.0), ("20062007", "b_to_a", "m", "12", "23", 1.0)], "period string, direction string, measure string, from_code string, to_code string, weight double")
    universe = spark.createDataFrame([(2008, "1"), (2008, "12"), (2007, "11"), (2007, "12"), (2006, "11"), (2006, "23")], "year int, code string")
    out = chain.chain_range(steps, universe, 2006, 2008, 2006, ["m"])
    assert rows(out.weights.where("origin_year = 2008"), "from_code", "to_code") == [("1", "11"), ("12", "23")]
    assert chain.uncovered(out, universe).count() == 0


def test_apply(spark):
    t = spark.createDataFrame([("NL", "00000001", 2000, 100.0, 10.0), ("NL", "00000002", 2000, 50.0, 5.0), ("NL", "00000003", 2000, 7.0, 1.0)], "REPORTER string, PRODUCT_NC string, PERIOD int, VALUE_EUR double, QUANTITY_KG double")
    w = spark.createDataFrame([(2000, m, f, c, x) for m, p in (("VALUE_EUR", (0.6, 0.4)), ("QUANTITY_KG", (0.2, 0.8))) for f, c, x in (("00000001", "11", 1.0), ("00000002", "21", p[0]), ("00000002", "22", p[1]))], "origin_year int, measure string, from_code string, to_code string, weight double")
    year = apply.with_year(t)
    split = {r.PRODUCT_NC: (round(r.VALUE_EUR, 6), round(r.QUANTITY_KG, 6)) for r in apply.apply_strategy(year, w, "weights_split").collect()}
    assert split == {"11": (100, 10), "21": (30, 1), "22": (20, 4), "00000003": (7, 1)}
    value = {r.PRODUCT_NC: (round(r.VALUE_EUR, 6), round(r.QUANTITY_KG, 6)) for r in apply.apply_strategy(year, w, "weights_value").collect()}
    assert value["21"] == (30, 3)
    wide = apply.apply_wide(year, w)
    assert apply.conservation(year, wide).agg(F.max(F.abs("difference"))).first()[0] < 1e-9
    assert apply.apply_summary(year, wide, w).first().n_codes_missing == 1


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 2.0, 1.0), (None, 1.0, 1.0)], "x double, y double, w double")
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    assert df.agg(M.r2_45_weighted(x, y, w)).first()[0] == pytest.approx(0.5)
    assert df.agg(M.r2_45(x, y)).first()[0] == pytest.approx(0.5) and df.agg(M.mae(x, y)).first()[0] == 0.5
    assert df.limit(0).agg(M.r2_45(x, y)).first()[0] is None
    slope = M.slope_hc1(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double").withColumn("k", F.lit(1)), "x", "y", ("k",)).first()
    assert (slope.coef, slope.se, slope.n) == (2.0, 0.0, 3)
    h = M.normalised_entropy(spark.createDataFrame([("A", 0.25, 2), ("A", 0.75, 2), ("B", 0.5, 2), ("B", 0.5, 2)], "from_code string, weight double, k int"))
    got = {r.from_code: r.entropy for r in h.collect()}
    assert got["B"] == pytest.approx(1) and got["A"] == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)) / math.log(2))
    s = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 3.0), (1, 2.0, 2.0), (2, 1.0, 1.0)], "k int, x double, y double")
    assert {r.k: r.spearman for r in M.spearman(s, "x", "y", ("k",)).collect()} == {1: pytest.approx(0.8660254), 2: None}
    with pytest.raises(KeyError):
        M.metric("none")


def test_chain_sample(spark):
    g = concordance.build_groups(edges_of(spark, ("A", "B"), ("A", "C"), period="20052006"))
    chains = spark.createDataFrame([(2005, "A", "B", 1.0), (2006, "B", "B", 1.0), (2006, "C", "C", 1.0)], "origin_year int, from_code string, to_code string, weight double")
    assert rows(panels.chain_sample(g, chains, 2005, 2006), "code", "group_id") == [("B", "2005to2006_g000001"), ("C", "2005to2006_g000001")]


def test_link_distribution(spark):
    out = structure.link_distribution(structure.focal_codes(concordance.build_groups(edges_of(spark, ("A1", "B1"), ("A1", "B2"), ("X1", "Y1")))))
    assert rows(out, "side", "class", "n") == [("a", "1:1", 1), ("a", "1:n", 1), ("b", "1:1", 1), ("b", "m:1", 2)]


def test_completed_panel(spark):
    flows = spark.createDataFrame([(2000, "r", "p", "g", "C1", 1.0), (2001, "r", "p", "g", "C2", 1.0)], "year int, REPORTER string, PARTNER string, group_id string, code string, flow double")
    groups = spark.createDataFrame([("g", "C1"), ("g", "C2")], "group_id string, code string")
    assert rows(persistence.completed_panel(flows, groups).where("year = 2001"), "code", "lag", "flow") == [("C1", 1.0, 0.0), ("C2", 0.0, 1.0)]


def test_panel_summary_and_instability(spark):
    d = spark.createDataFrame([(2000, "pre_immediate", 0.90, 0.08, 0.08), (2000, "break", 0.80, 0.12, 0.12), (2000, "post_immediate", 0.92, 0.06, 0.06)], "target_year int, panel string, r2_45 double, mae double, mae_weighted double")
    r = robustness.panel_summary(d).first()
    assert (r.r2_baseline, r.r2_penalty, r.mae_excess) == (pytest.approx(0.91), pytest.approx(0.11), pytest.approx(0.05))
    x = spark.createDataFrame([(0.1, 0.8), (0.3, 0.15), (0.8, 0.05)], "v double, w double")
    assert x.agg(M.weighted_mean(F.col("v"), F.col("w"))).first()[0] == pytest.approx(0.165)


def test_bins_are_balanced_and_moments_subtract(spark):
    rng = np.random.default_rng(1)
    data = [("20002001", "a_to_b", "VALUE_EUR", "g", s, c, f"r{i}", "p", float(v)) for i in range(23) for s, c in (("a", "1"), ("b", "11"), ("b", "12")) for v in [rng.integers(1, 50)]]
    shares = spark.createDataFrame(data, "period string, direction string, measure string, group_id string, side string, code string, REPORTER string, PARTNER string, value double")
    bins = robustness.holdout_bins(shares, 4)
    assert sorted(r["count"] for r in bins.groupBy("bin").count().collect()) == [5, 6, 6, 6]
    moments, emptied = robustness.bin_moments(shares, bins)
    got = {(r.bin, r.kind, r.i, r.j): r.value for r in moments.collect()}
    assert emptied.count() == 0
    of = {r.REPORTER: r.bin for r in bins.collect()}
    for b in range(4):
        kept = [d for d in data if of[d[6]] != b]
        ta, tb = (sum(d[8] for d in kept if d[4] == s) for s in "ab")
        m = sum((d[8] / ta) ** 2 for d in kept if d[4] == "a")
        assert got[b, "m", "1", "1"] == pytest.approx(m)
        n = sum(x[8] / ta * y[8] / tb for x in kept for y in kept if x[4] == "a" and y[5] == "12" and x[6] == y[6])
        assert got[b, "n", "1", "12"] == pytest.approx(n)


def test_synthetic_evidence(spark):
    s = [("prehistory", "c", 2000 + i, 0.01 if i < 3 else 0.1, i < 3, i >= 3) for i in range(6)]
    r = synthetic.evidence(spark.createDataFrame(s, "concept string, code string, year int, share double, is_synthetic boolean, is_inlife boolean")).first()
    assert (r.n_synthetic, r.n_inlife, r.peak_synthetic, r.peak_inlife, r.peak_year_inlife) == (3, 3, 0.01, 0.1, 2003)


def test_figures(spark):
    d = spark.createDataFrame([("x", 0.0), ("y", 0.5), ("z", 1.0)], "k string, v double")
    assert rows(figures.histogram(d, "v", 0.0, 1.0, 2), "bin", "n") == [(1, 1), (2, 2)]
    assert [r.scaled for r in figures.scaled_rows(d, "k", ["v"]).orderBy("k").collect()] == [0.0, 0.5, 1.0]
    seg = figures.regime_segments(spark.createDataFrame([("c", 1, True), ("c", 2, True), ("c", 3, False)], "c string, year int, f boolean"), "f", ["c"])
    assert rows(seg, "year", "segment", "bridge") == [(1, 0, False), (2, 0, False), (3, 0, True), (3, 1, False)]
