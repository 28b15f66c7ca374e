"""Registered queries: panels, structure, persistence, synthetic, robustness, figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintage.functions import metrics as M
from vintage.operators import concordance, estimation, figures, panels, persistence, robustness, structure, synthetic
from vintage.plans.core import groups_of, near, query, r6, uniform_chains, uniform_steps, universe_of
from vintage.plans.fits_sql import bin_parts, fit_parts
from vintage.plans.sql import BASE, PARTS, YEARS, chain_parts, pairs_of, panel_parts
from vintage.sources import fixture
from vintage.sources.storage import checkpointed

FIRST, LAST = YEARS[0], YEARS[-1]
BREAK = f"{BASE - 1}{BASE}"


# ------------------------------------------------------------ oracle parts
def _strict_carry(name: str, source: int, target: int, start: str) -> dict[str, str]:
    """name<year>: (orig, code) carried through strict links year by year."""
    sign, prev, out = (1 if target > source else -1), start, {}
    for y in range(source, target, sign):
        s, o = ("a", "b") if sign > 0 else ("b", "a")
        p = f"{min(y, y + sign)}{max(y, y + sign)}"
        out[f"{name}{y + sign}"] = (
            f"SELECT t.orig, coalesce(l.nxt, CASE WHEN r.code IS NULL THEN t.code END) AS code FROM ({prev}) t "
            f"LEFT JOIN (SELECT vintage_{s}_code AS code, vintage_{o}_code AS nxt FROM degs WHERE period='{p}' AND deg_a=1 AND deg_b=1) l ON l.code=t.code "
            f"LEFT JOIN (SELECT DISTINCT vintage_{s}_code AS code FROM edges WHERE period='{p}') r ON r.code=t.code WHERE coalesce(l.nxt, CASE WHEN r.code IS NULL THEN t.code END) IS NOT NULL"
        )
        prev = f"SELECT orig, code FROM {name}{y + sign}"
    return out


def _relations(anchor: int, target: int, tag: str = "") -> dict[str, str]:
    """st<year>: step relation into the year; rl<year>: anchor's relation; either way in time."""
    out, prev = {}, f"SELECT code AS from_code, code AS to_code FROM univ WHERE year={anchor}"
    sign = 1 if target > anchor else -1
    s, o = ("a", "b") if sign > 0 else ("b", "a")
    for y in range(anchor, target, sign):
        z = y + sign
        links = f"SELECT vintage_{s}_code AS x, vintage_{o}_code AS y FROM edges WHERE period='{min(y, z)}{max(y, z)}'"
        out[f"st{tag}{z}"] = f"SELECT x AS from_code, y AS to_code FROM ({links}) UNION SELECT code, code FROM univ WHERE year={y} AND code NOT IN (SELECT x FROM ({links}))"
        out[f"rl{tag}{z}"] = f"SELECT DISTINCT p.from_code, coalesce(s.to_code, p.to_code) AS to_code FROM ({prev}) p LEFT JOIN st{tag}{z} s ON s.from_code=p.to_code"
        prev = f"SELECT * FROM rl{tag}{z}"
    years = range(anchor + sign, target + sign, sign)
    out[f"rels{tag}"] = " UNION ALL ".join(f"SELECT {z} AS compare_year, * FROM rl{tag}{z}" for z in years)
    out[f"stps{tag}"] = " UNION ALL ".join(f"SELECT {z} AS compare_year, * FROM st{tag}{z}" for z in years)
    return out


def _classes(name: str, relation: str) -> dict[str, str]:
    """<name>: compare_year, from_code, class by component sizes of ``relation``."""
    return {
        f"{name}_l": f"SELECT compare_year, 'A'||from_code AS u, 'B'||to_code AS v FROM {relation} UNION SELECT compare_year, 'B'||to_code, 'A'||from_code FROM {relation}",
        f"{name}_r(compare_year, node, root)": f"SELECT compare_year, u, u FROM {name}_l UNION SELECT r.compare_year, l.v, r.root FROM {name}_r r JOIN {name}_l l ON l.compare_year=r.compare_year AND l.u=r.node",
        f"{name}_c": f"SELECT compare_year, node, min(root) AS comp FROM {name}_r GROUP BY 1,2",
        f"{name}_s": f"SELECT compare_year, comp, count(CASE WHEN node LIKE 'A%' THEN 1 END) AS nf, count(CASE WHEN node LIKE 'B%' THEN 1 END) AS no FROM {name}_c GROUP BY 1,2",
        name: f"""SELECT c.compare_year, substr(c.node,2) AS from_code, CASE WHEN nf=1 AND no=1 THEN '1:1' WHEN nf=1 THEN '1:n' WHEN no=1 THEN 'm:1' ELSE 'm:n' END AS class
            FROM {name}_c c JOIN {name}_s s USING (compare_year, comp) WHERE c.node LIKE 'A%'""",
    }


PARTS |= _strict_carry("lin", FIRST, BASE, f"SELECT code AS orig, code FROM univ WHERE year={FIRST}")
_BAD = f"SELECT DISTINCT vintage_a_code AS code FROM degs WHERE period='{LAST - 1}{LAST}' AND (deg_a>1 OR deg_b>1) AND CAST(vintage_a_code AS BIGINT)%32<16"
PARTS |= _strict_carry("bad", LAST - 1, BASE, f"SELECT code AS orig, code FROM ({_BAD})")
for _y in YEARS:
    if _y != BASE:
        PARTS |= _strict_carry(f"k{_y}_", _y, BASE, f"SELECT code AS orig, code FROM univ WHERE year={_y}")
PARTS |= _relations(FIRST, BASE) | _relations(LAST, BASE, "b")
PARTS |= _classes("relc", "rels") | _classes("stpc", "stps") | _classes("relcb", "relsb") | _classes("stpcb", "stpsb")
PARTS |= {
    "foc": """SELECT g.period, 'a' AS side, g.vintage_a_code AS code, CASE WHEN n_vintage_a=1 AND n_vintage_b=1 THEN '1:1' WHEN n_vintage_a=1 THEN '1:n' WHEN n_vintage_b=1 THEN 'm:1' ELSE 'm:n' END AS class FROM ge g JOIN summ s USING (period, group_id)
        UNION SELECT g.period, 'b', g.vintage_b_code, CASE WHEN n_vintage_b=1 AND n_vintage_a=1 THEN '1:1' WHEN n_vintage_b=1 THEN '1:n' WHEN n_vintage_a=1 THEN 'm:1' ELSE 'm:n' END FROM ge g JOIN summ s USING (period, group_id)""",
    "allfoc": """SELECT * FROM foc UNION ALL SELECT p.period, sd.side, a.code, '1:1' FROM (SELECT DISTINCT period, CAST(vintage_a_year AS INT) AS ya, CAST(vintage_b_year AS INT) AS yb FROM edges) p
        JOIN univ a ON a.year=p.ya JOIN univ b ON b.year=p.yb AND b.code=a.code CROSS JOIN (SELECT 'a' AS side UNION ALL SELECT 'b') sd
        WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.period=p.period AND (e.vintage_a_code=a.code OR e.vintage_b_code=a.code))""",
    "dist": """SELECT period, side, class, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY period, side) AS share FROM allfoc GROUP BY 1,2,3""",
    "bil": """SELECT PERIOD AS year, REPORTER, PARTNER, PRODUCT_NC AS code, sum(VALUE_EUR) AS value FROM trade WHERE FLOW='1' GROUP BY 1,2,3,4""",
    "bilc": " UNION ALL ".join(
        [f"SELECT year, REPORTER, PARTNER, code, value FROM bil WHERE year={BASE}"]
        + [f"SELECT b.year, REPORTER, PARTNER, k.code, sum(value) AS value FROM bil b JOIN k{y}_{BASE} k ON k.orig=b.code WHERE b.year={y} GROUP BY 1,2,3,4" for y in YEARS if y != BASE]
    ),
    "cand": f"""SELECT DISTINCT 'prehistory' AS concept, vintage_b_code AS code FROM edges WHERE period='{BREAK}' UNION ALL SELECT DISTINCT 'afterlife', vintage_a_code FROM edges WHERE period='{BREAK}'""",
    "life": """SELECT coalesce(b.code, a.code) AS code, CAST(introduced AS INT) AS introduced, CAST(sunset AS INT) AS sunset FROM (SELECT vintage_b_code AS code, min(vintage_b_year) AS introduced FROM edges GROUP BY 1) b
        FULL JOIN (SELECT vintage_a_code AS code, max(vintage_a_year) AS sunset FROM edges GROUP BY 1) a ON a.code=b.code""",
    "obs": "SELECT code, min(year) AS obs_first, max(year) AS obs_last FROM ptot GROUP BY 1",
    "timed": "SELECT c.concept, c.code, obs_first, obs_last, introduced, sunset FROM cand c LEFT JOIN obs o ON o.code=c.code LEFT JOIN life l ON l.code=c.code",
    "ser": f"""SELECT concept, t.code, y.yr AS year, coalesce(b.value/w.total,0) AS share,
        coalesce(CASE WHEN concept='prehistory' THEN y.yr<coalesce(obs_first,introduced) ELSE y.yr>coalesce(obs_last,sunset) END,false) AS is_synthetic,
        coalesce(y.yr>=coalesce(obs_first,introduced) AND y.yr<=coalesce(obs_last,sunset),false) AS is_inlife
        FROM timed t CROSS JOIN yrs y LEFT JOIN (SELECT c.origin_year AS year, c.to_code AS code, sum(p.value*c.weight) AS value FROM chain c JOIN ptot p ON p.year=c.origin_year AND p.code=c.from_code GROUP BY 1,2) b ON b.year=y.yr AND b.code=t.code
        LEFT JOIN (SELECT year, sum(value) AS total FROM ptot GROUP BY 1) w ON w.year=y.yr""",
}


def _persistence_parts(tag: str, group_map: str, level: str = "bilateral") -> dict[str, str]:
    """scal<tag>, pan<tag>, reg<tag>: flows of ``group_map`` (code, group_id) in
    their denominators, the zero-completed panel, and its regressions."""
    unit, denominator = persistence.LEVELS[level], persistence.DENOMINATOR[level]
    cols = "".join(f"{u}, " for u in unit)
    on = lambda t: "".join(f" AND {t}.{u}=u.{u}" for u in unit)
    return {
        f"scal{tag}": f"""SELECT year, {cols}group_id, code, value/t AS flow FROM (SELECT *, sum(value) OVER (PARTITION BY {", ".join(["year", *denominator, "group_id"])}) AS t FROM
            (SELECT year, {cols}s.group_id, b.code, sum(value) AS value FROM bilc b JOIN {group_map} s ON s.code=b.code GROUP BY ALL)) WHERE t>0""",
        f"seen{tag}": f"SELECT DISTINCT year, {cols}group_id FROM scal{tag}",
        f"pan{tag}": f"""SELECT u.*, s.code, coalesce(n.flow,0) AS flow, coalesce(l.flow,0) AS lag FROM
            (SELECT * FROM seen{tag} UNION SELECT * REPLACE (year+1 AS year) FROM seen{tag}) u JOIN (SELECT DISTINCT group_id, code FROM {group_map}) s ON s.group_id=u.group_id
            LEFT JOIN scal{tag} n ON n.year=u.year AND n.group_id=u.group_id AND n.code=s.code{on("n")}
            LEFT JOIN scal{tag} l ON l.year=u.year-1 AND l.group_id=u.group_id AND l.code=s.code{on("l")}
            WHERE u.year IN (SELECT year FROM scal{tag}) AND u.year-1 IN (SELECT year FROM scal{tag})""",
        f"reg{tag}": f"""SELECT year, b AS coef, sqrt((n::DOUBLE/(n-1))*sum(lag*lag*(flow-b*lag)*(flow-b*lag))/(any_value(xx)*any_value(xx))) AS se, n,
            CASE WHEN var_pop(flow)*n>0 THEN 1-sum((flow-lag)*(flow-lag))/(var_pop(flow)*n) END AS r2_45 FROM
            (SELECT *, sum(lag*flow) OVER (PARTITION BY year)/sum(lag*lag) OVER (PARTITION BY year) AS b, sum(lag*lag) OVER (PARTITION BY year) AS xx, count(*) OVER (PARTITION BY year) AS n FROM pan{tag}) GROUP BY year, b, n""",
    }


PARTS |= _persistence_parts("", "smp") | _persistence_parts("imp", "smp", "importer") | _persistence_parts("agg", "smp", "aggregate")
# contaminated groups, by many-sided links of half the blocks in the last step, which no later year repeats
PARTS |= {
    "cont": f"SELECT DISTINCT group_id FROM smp WHERE code IN (SELECT code FROM bad{BASE})",
    "smpc": "SELECT * FROM smp WHERE group_id NOT IN (SELECT group_id FROM cont)",
    "smpd": f"""SELECT u.code, coalesce(s.group_id, 'singleton::{BASE}::'||u.code) AS group_id FROM univ u LEFT JOIN smp s ON s.code=u.code WHERE u.year={BASE}""",
}
PARTS |= _persistence_parts("cl", "smpc") | _persistence_parts("det", "smpd")

# ----------------------------------------------------------------- inputs
def _totals(spark, sf_dir):
    """Imports by year and code, written once; of queries that need the code lists too."""
    by_code = fixture.trade_by_code(spark, sf_dir)
    return fixture.held(spark, sf_dir, "totals", lambda: checkpointed(panels.product_totals(by_code, flow="1")))


def _at(spark, sf_dir, target, first, last):
    """Shares of the years first..last at a target vintage, in its own groups."""
    g = groups_of(spark, sf_dir)
    own = g.summary.where((F.col("period") == f"{target - 1}{target}") & F.col("a_to_b_ambiguous")).select("group_id")
    group_map = g.edges.select(F.col("vintage_b_code").alias("code"), "group_id").distinct().join(own, "group_id", "left_semi")
    totals = _totals(spark, sf_dir).where(F.col("year").between(first, last))
    chains = uniform_chains(spark, sf_dir, target=target, first=first, last=last).weights
    return panels.group_shares(panels.group_values(panels.target_totals(totals, chains), group_map))


def _base(spark, sf_dir):
    """group_map, totals, chains, shares at the base vintage."""
    g = groups_of(spark, sf_dir)
    codes = g.edges.where(F.col("period") == BREAK).select(F.col("vintage_b_code").alias("code"), "group_id").distinct()
    amb = g.summary.where((F.col("period") == BREAK) & F.col("a_to_b_ambiguous")).select("group_id")
    group_map = checkpointed(codes.join(amb, "group_id", "left_semi"))
    totals = _totals(spark, sf_dir)
    chains = uniform_chains(spark, sf_dir).weights
    shares = panels.group_shares(panels.group_values(panels.target_totals(totals, chains), group_map))
    return g, group_map, totals, chains, shares


# ----------------------------------------------------------------- panels
@query("SELECT year, group_id, code, round(value+1e-6,2) AS value, round(share,6) AS share FROM bsh")
def target_shares(spark, sf_dir):
    return _base(spark, sf_dir)[4].select("year", "group_id", "code", F.round(F.col("value") + 1e-6, 2).alias("value"), *r6("share"))


@query("SELECT x_year, y_year, group_id, code, round(share_t,6) AS share_t, round(share_t1,6) AS share_t1 FROM pairs")
def panel_pairs(spark, sf_dir):
    return panels.year_pairs(_base(spark, sf_dir)[4]).select("x_year", "y_year", "group_id", "code", *r6("share_t", "share_t1"))


_PANEL = """count(*) AS n, round(1-sum((share_t1-share_t)*(share_t1-share_t))/(var_pop(share_t1)*count(*)),6) AS r2_45,
round(1-sum(w*(share_t1-share_t)*(share_t1-share_t))/(sum(w*share_t1*share_t1)-sum(w*share_t1)*sum(w*share_t1)/sum(w)),6) AS r2_45_symmetric,
round(avg(abs(share_t1-share_t)),6) AS mae, round(sum(w*abs(share_t1-share_t))/sum(w),6) AS mae_weighted, count(DISTINCT group_id) AS n_groups, count(DISTINCT code) AS n_codes"""
_PANEL_COLS = ["r2_45", "r2_45_symmetric", "mae", "mae_weighted"]


@query(f"SELECT x_year, {_PANEL} FROM (SELECT *, (value_x+value_y)/2 AS w FROM pairs) GROUP BY 1")
def panel_metrics(spark, sf_dir):
    out = panels.panel_metrics(panels.year_pairs(_base(spark, sf_dir)[4]))
    return out.select("x_year", "n", *r6(*_PANEL_COLS), "n_groups", "n_codes")


_STRESS = f"SELECT y.year AS compare_year, x.group_id, x.code, x.share AS share_t, y.share AS share_t1, (x.value+y.value)/2 AS w FROM bsh x JOIN bsh y USING (group_id, code) WHERE x.year={BASE} AND y.year<>{BASE}"


@query(f"SELECT {BASE} AS base_year, compare_year, {_PANEL} FROM ({_STRESS}) GROUP BY 2")
def stress_chains(spark, sf_dir):
    return panels.stress(_base(spark, sf_dir)[4], BASE).select("base_year", "compare_year", "n", *r6(*_PANEL_COLS), "n_groups", "n_codes")


@query(f"""SELECT direction, length, round(loss,6) AS loss, round(mae_weighted,6) AS mae_weighted, round(loss-lag(loss) OVER (PARTITION BY direction ORDER BY length),6) AS delta_loss FROM (
SELECT CASE WHEN compare_year>{BASE} THEN 'after' ELSE 'before' END AS direction, abs(compare_year-{BASE}) AS length, sum(w*abs(share_t1-share_t))/sum(w) AS mae_weighted,
sum(w*(share_t1-share_t)*(share_t1-share_t))/(sum(w*share_t1*share_t1)-sum(w*share_t1)*sum(w*share_t1)/sum(w)) AS loss FROM ({_STRESS}) GROUP BY 1,2)""")
def chain_length_points(spark, sf_dir):
    return panels.chain_length(_base(spark, sf_dir)[4], BASE).select("direction", "length", *r6("loss", "mae_weighted", "delta_loss"))


@query(f"""SELECT i.origin_year - {FIRST} + 1 AS step_index, i.origin_year AS source_year, round(sum(p.value)+1e-6,2) AS total_trade, round(coalesce(sum(CASE WHEN k.k>1 THEN p.value END),0)+1e-6,2) AS ambiguous_trade,
round(coalesce(sum(CASE WHEN k.k>1 THEN p.value END),0)/sum(p.value),6) AS exposure, round(sum(CASE WHEN k.k>1 THEN p.value END)/sum(CASE WHEN k.k>1 THEN p.value END),6) AS diffuseness, count(CASE WHEN k.k>1 THEN 1 END) AS n_ambiguous
FROM (SELECT DISTINCT origin_year, from_code FROM chain WHERE to_code IN (SELECT code FROM smp) AND origin_year<{BASE}) i JOIN ptot p ON p.year=i.origin_year AND p.code=i.from_code
LEFT JOIN (SELECT CAST(substr(period,1,4) AS INT) AS yr, from_code, count(*) AS k FROM ori WHERE direction='a_to_b' GROUP BY 1,2) k ON k.yr=i.origin_year AND k.from_code=i.from_code GROUP BY i.origin_year""")
def step_metrics(spark, sf_dir):
    g, group_map, totals, chains, _ = _base(spark, sf_dir)
    feasible = concordance.feasible_targets(concordance.oriented(g.edges))
    out = panels.step_metrics(group_map, totals, chains, feasible, uniform_steps(fixture.edges(spark, sf_dir)), FIRST, BASE)
    two = [F.round(F.col(c) + 1e-6, 2).alias(c) for c in ("total_trade", "ambiguous_trade")]
    return out.select(F.col("step_index"), "source_year", *two, *r6("exposure", "diffuseness"), "n_ambiguous")


def _steps_sql(sign: int) -> str:
    """Step metrics of the chains to the base from before (1) or after (-1)."""
    side, year, first = ("a_to_b", "substr(period,1,4)", FIRST) if sign > 0 else ("b_to_a", "substr(period,5,4)", LAST)
    entropy = f"""(SELECT CAST({year} AS INT) AS yr, from_code, CASE WHEN count(*)>1 THEN -sum(weight*ln(weight))/ln(count(*)) ELSE 0 END AS h, count(*) AS k FROM uni WHERE direction='{side}' GROUP BY 1,2)"""
    return f"""SELECT source_year, sum(value) AS total, coalesce(sum(CASE WHEN k>1 THEN value END),0) AS amb, coalesce(sum(CASE WHEN k>1 THEN value END),0)/sum(value) AS exposure,
     sum(CASE WHEN k>1 THEN h*value END)/sum(CASE WHEN k>1 THEN value END) AS diffuseness FROM
     (SELECT i.origin_year AS source_year, p.value, e.k, e.h FROM (SELECT DISTINCT origin_year, from_code FROM chain WHERE to_code IN (SELECT code FROM smp) AND origin_year {"<" if sign > 0 else ">"} {BASE}) i
      JOIN ptot p ON p.year=i.origin_year AND p.code=i.from_code LEFT JOIN {entropy} e ON e.yr=i.origin_year AND e.from_code=i.from_code) GROUP BY 1"""


PARTS |= {"stm_before": _steps_sql(1), "stm_after": _steps_sql(-1)}
_OVER = """sum(exposure*total)/sum(total) AS exposure, sum(CASE WHEN amb>0 THEN diffuseness*amb END)/sum(CASE WHEN amb>0 THEN amb END) AS diffuseness,
sum(CASE WHEN diffuseness IS NOT NULL THEN diffuseness*amb/total*total END)/sum(CASE WHEN diffuseness IS NOT NULL THEN total END) AS diffuse_exposure"""
PARTS["stm_chain"] = " UNION ALL ".join(
    f"SELECT '{name}' AS direction, {n} AS length, {_OVER} FROM stm_{name} WHERE abs(source_year-{BASE}) <= {n}" for name in ("before", "after") for n in range(1, BASE - FIRST + 1)
)


def _steps(spark, sf_dir):
    """Shares at the base, and the step metrics of the chains from before and after."""
    g, group_map, totals, chains, shares = _base(spark, sf_dir)
    feasible = concordance.feasible_targets(concordance.oriented(g.edges))
    steps = None
    for name, first in (("before", FIRST), ("after", LAST)):
        part = panels.step_metrics(group_map, totals, chains, feasible, uniform_steps(fixture.edges(spark, sf_dir)), first, BASE)
        part = part.withColumns({"direction": F.lit(name), "length": F.abs(F.col("source_year") - BASE)})
        steps = part if steps is None else steps.unionByName(part)
    return shares, checkpointed(steps)


@query("SELECT direction, round(exposure,6) AS exposure, round(diffuseness,6) AS diffuseness, round(diffuse_exposure,6) AS diffuse_exposure FROM stm_chain WHERE direction='before' AND length=3")
def chain_metrics(spark, sf_dir):
    _, steps = _steps(spark, sf_dir)
    return panels.chain_metrics(steps.where("direction = 'before'"), ("direction",)).select("direction", *r6("exposure", "diffuseness", "diffuse_exposure"))


_POINTS = f"""SELECT CASE WHEN compare_year>{BASE} THEN 'after' ELSE 'before' END AS direction, abs(compare_year-{BASE}) AS length, {_PANEL} FROM ({_STRESS}) GROUP BY 1,2"""


@query(f"""SELECT p.*, round(exposure,6) AS exposure, round(diffuseness,6) AS diffuseness, round(diffuse_exposure,6) AS diffuse_exposure FROM ({_POINTS}) p JOIN stm_chain c USING (direction, length)""")
def stress_run(spark, sf_dir):
    """Each chain's panel against the base, with the step metrics over the chain."""
    return panels.stress_run(*_steps(spark, sf_dir), BASE).select(
        "direction", "length", "n", *r6(*_PANEL_COLS), "n_groups", "n_codes", *r6("exposure", "diffuseness", "diffuse_exposure")
    )


@query(f"""SELECT direction, round(corr(rx, ry),6) AS spearman FROM (SELECT direction, rank() OVER (PARTITION BY direction ORDER BY loss)+(count(*) OVER (PARTITION BY direction, loss)-1)/2.0 AS rx,
rank() OVER (PARTITION BY direction ORDER BY exposure)+(count(*) OVER (PARTITION BY direction, exposure)-1)/2.0 AS ry FROM (SELECT direction, 1-r2_45_symmetric AS loss, exposure FROM ({_POINTS}) JOIN stm_chain USING (direction, length))) GROUP BY 1""")
def chain_length_spearman(spark, sf_dir):
    """Rank correlation of the loss on the exposure over the lengths of a chain."""
    points = panels.stress_run(*_steps(spark, sf_dir), BASE).withColumn("loss", F.round(1 - F.round("r2_45_symmetric", 6), 6))
    return M.spearman(points, "loss", "exposure", ("direction",)).select("direction", *r6("spearman"))


# stability: unstable codes of half the blocks in the last step
PARTS |= {
    "unst": f"SELECT DISTINCT {LAST - 1} AS year, vintage_a_code AS code FROM degs WHERE period='{LAST - 1}{LAST}' AND deg_a>1 AND CAST(vintage_a_code AS BIGINT)%32<16",
    "stab": "SELECT * FROM smp WHERE group_id NOT IN (SELECT s.group_id FROM smp s JOIN chain c ON c.to_code=s.code JOIN unst u ON u.year=c.origin_year AND u.code=c.from_code)",
    "pairs_stable": "SELECT * FROM pairs WHERE group_id IN (SELECT group_id FROM stab)",
    "lin_map": f"SELECT DISTINCT g.vintage_b_code AS code, g.group_id FROM ge g WHERE period='{FIRST}{FIRST + 1}' AND group_id NOT IN (SELECT group_id FROM ge LEFT JOIN (SELECT orig FROM lng1) l ON l.orig=ge.vintage_b_code WHERE ge.period='{FIRST}{FIRST + 1}' AND l.orig IS NULL)",
    "lin_rows": " UNION ALL ".join([f"SELECT orig, {FIRST + 1} AS year, code FROM (SELECT DISTINCT vintage_b_code AS orig, vintage_b_code AS code FROM edges WHERE period='{FIRST}{FIRST + 1}')", *[f"SELECT orig, {y}, code FROM lg{y}" for y in range(FIRST + 2, BASE + 1)]]),
    "lin_sh": """SELECT year, group_id, code, value, value/t AS share FROM (SELECT *, sum(value) OVER (PARTITION BY year, group_id) AS t FROM (SELECT r.year, m.group_id, r.orig AS code, coalesce(p.value,0) AS value
        FROM lin_map m JOIN lin_rows r ON r.orig=m.code LEFT JOIN ptot p ON p.year=r.year AND p.code=r.code)) WHERE t>0""",
    "pairs_lin": pairs_of("lin_sh"),
}


def _unstable(spark, sf_dir):
    links = concordance.with_degrees(fixture.edges(spark, sf_dir)).where(f"period = '{LAST - 1}{LAST}' and deg_a > 1 and cast(vintage_a_code as bigint) % 32 < 16")
    return links.select(F.lit(LAST - 1).alias("year"), F.col("vintage_a_code").alias("code")).distinct()


@query("SELECT 'all' AS panel, count(DISTINCT group_id) AS n_groups, count(DISTINCT code) AS n_codes FROM smp UNION ALL SELECT 'stable', count(DISTINCT group_id), count(DISTINCT code) FROM stab")
def stability_counts(spark, sf_dir):
    """Groups and codes before and after the stability filter."""
    _, group_map, _, chains, _ = _base(spark, sf_dir)
    kept = panels.stable_groups(group_map, _unstable(spark, sf_dir), chains)
    return panels.panel_counts(group_map).withColumn("panel", F.lit("all")).unionByName(panels.panel_counts(kept).withColumn("panel", F.lit("stable")))


@query(f"""SELECT 'focal' AS panel, x_year, {_PANEL} FROM (SELECT *, (value_x+value_y)/2 AS w FROM pairs_stable) GROUP BY 2
UNION ALL SELECT 'lineage', x_year, {_PANEL} FROM (SELECT *, (value_x+value_y)/2 AS w FROM pairs_lin) GROUP BY 2""")
def stability_run(spark, sf_dir):
    """Panels of the stable groups, and the placebo of deterministic lineages."""
    _, group_map, totals, chains, shares = _base(spark, sf_dir)
    focal = panels.year_pairs(shares, keep=panels.stable_groups(group_map, _unstable(spark, sf_dir), chains))
    first = groups_of(spark, sf_dir).edges.where(F.col("period") == f"{FIRST}{FIRST + 1}").select(F.col("vintage_b_code").alias("code"), "group_id").distinct()
    years = list(range(FIRST + 1, BASE + 1))
    lineage = checkpointed(panels.deterministic_lineage(first.select(F.col("code").alias("origin_code")), fixture.edges(spark, sf_dir), years))
    pairs = panels.placebo_pairs(panels.complete_groups(first, lineage, len(years)), lineage, totals, focal)
    out = panels.panel_metrics(pairs, ("panel", "x_year"))
    return out.select("panel", "x_year", "n", *r6(*_PANEL_COLS), "n_groups", "n_codes")


@query("""SELECT coalesce(o.x_year, c.x_year) AS x_year, round(o.r2,6) AS r2_own, round(c.r2,6) AS r2_common, round(o.r2-c.r2,6) AS delta FROM
(SELECT x_year, 1-sum((share_t1-share_t)*(share_t1-share_t))/(var_pop(share_t1)*count(*)) AS r2 FROM pairs_stable GROUP BY 1) o
FULL JOIN (SELECT x_year, 1-sum((share_t1-share_t)*(share_t1-share_t))/(var_pop(share_t1)*count(*)) AS r2 FROM pairs GROUP BY 1) c ON c.x_year=o.x_year""")
def stability_comparison(spark, sf_dir):
    """The stable panels against those of the common target."""
    _, group_map, _, chains, shares = _base(spark, sf_dir)
    own = panels.panel_metrics(panels.year_pairs(shares, keep=panels.stable_groups(group_map, _unstable(spark, sf_dir), chains)))
    return panels.compare_panels(own, panels.panel_metrics(panels.year_pairs(shares))).select("x_year", *r6("r2_own", "r2_common", "delta"))


@query("SELECT year, group_id, code, round(value+1e-6,2) AS value, round(share,6) AS share FROM lin_sh")
def lineage_shares(spark, sf_dir):
    first = groups_of(spark, sf_dir).edges.where(F.col("period") == f"{FIRST}{FIRST + 1}").select(F.col("vintage_b_code").alias("code"), "group_id").distinct()
    years = list(range(FIRST + 1, BASE + 1))
    lineage = checkpointed(panels.deterministic_lineage(first.select(F.col("code").alias("origin_code")), fixture.edges(spark, sf_dir), years))
    totals = panels.product_totals(fixture.trade(spark, sf_dir), flow="1")
    out = panels.lineage_shares(panels.complete_groups(first, lineage, len(years)), lineage, totals)
    return out.select("year", "group_id", "code", F.round(F.col("value") + 1e-6, 2).alias("value"), *r6("share"))


PARTS |= {
    # stars: an ambiguous group of a step and its codes at the base
    "cs_link": f"""SELECT DISTINCT 'S'||o.period||'|'||o.group_id AS u, 'C'||c.to_code AS v FROM ori o JOIN amb USING (period, direction, group_id)
        JOIN LATERAL (SELECT unnest([CAST(o.from_vintage_year AS INT), CAST(o.to_vintage_year AS INT)]) AS year, unnest([o.from_code, o.to_code]) AS code) x ON true
        JOIN chain c ON c.origin_year=x.year AND c.from_code=x.code WHERE o.direction='a_to_b' AND o.period < '{BASE}'""",
    "cs_both": "SELECT u, v FROM cs_link UNION SELECT v, u FROM cs_link",
    "cs_reach(node, root)": "SELECT u, u FROM cs_both UNION SELECT b.v, r.root FROM cs_reach r JOIN cs_both b ON b.u=r.node",
    "cs_comp": "SELECT node, min(root) AS comp FROM cs_reach GROUP BY 1",
    "cs_ids": f"""SELECT comp, '{FIRST}to{BASE}_g'||lpad(CAST(row_number() OVER (ORDER BY min(node)) AS STRING),6,'0') AS group_id FROM cs_comp WHERE node LIKE 'C%' GROUP BY 1""",
}


@query("SELECT substr(node,2) AS code, group_id FROM cs_comp JOIN cs_ids USING (comp) WHERE node LIKE 'C%'")
def chain_sample(spark, sf_dir):
    return panels.chain_sample(groups_of(spark, sf_dir), uniform_chains(spark, sf_dir).weights, FIRST, BASE)


@query("SELECT DISTINCT origin_year, from_code FROM chain WHERE to_code IN (SELECT code FROM smp)")
def sample_sources(spark, sf_dir):
    _, group_map, _, chains, _ = _base(spark, sf_dir)
    return panels.source_codes(group_map, chains)


@query(f"""SELECT orig AS origin_code, {FIRST} AS year, orig AS code FROM (SELECT code AS orig FROM univ WHERE year={FIRST}) """ + "".join(f" UNION ALL SELECT orig, {y}, code FROM lin{y}" for y in range(FIRST + 1, BASE + 1)))
def lineage_codes(spark, sf_dir):
    start = concordance.code_universe(fixture.trade(spark, sf_dir)).where(F.col("year") == FIRST).select(F.col("code").alias("origin_code"))
    return panels.deterministic_lineage(start, fixture.edges(spark, sf_dir), list(range(FIRST, BASE + 1)))


@query(f"""SELECT g.vintage_b_code AS code, g.group_id FROM (SELECT DISTINCT period, vintage_b_code, group_id FROM ge) g WHERE period='{FIRST}{FIRST + 1}'
AND group_id NOT IN (SELECT group_id FROM ge LEFT JOIN (SELECT orig FROM lng1) l ON l.orig=ge.vintage_b_code WHERE ge.period='{FIRST}{FIRST + 1}' AND l.orig IS NULL)""")
def lineage_groups(spark, sf_dir):
    group_map = groups_of(spark, sf_dir).edges.where(F.col("period") == f"{FIRST}{FIRST + 1}").select(F.col("vintage_b_code").alias("code"), "group_id").distinct()
    years = list(range(FIRST + 1, BASE + 1))
    lineage = panels.deterministic_lineage(group_map.select(F.col("code").alias("origin_code")), fixture.edges(spark, sf_dir), years)
    return panels.complete_groups(group_map, lineage, len(years))


PARTS |= _strict_carry("lg", FIRST + 1, BASE, f"SELECT DISTINCT vintage_b_code AS orig, vintage_b_code AS code FROM edges WHERE period='{FIRST}{FIRST + 1}'")
PARTS["lng1"] = f"SELECT DISTINCT orig FROM lg{BASE}"


# -------------------------------------------------------------- structure
@query("SELECT period, side, code, class FROM allfoc")
def focal_codes(spark, sf_dir):
    g = groups_of(spark, sf_dir)
    universe = concordance.code_universe(fixture.trade(spark, sf_dir))
    return structure.focal_codes(g).unionByName(structure.implied_identities(g, universe)).select("period", "side", "code", "class")


def _distribution(spark, sf_dir):
    g = groups_of(spark, sf_dir)
    universe = concordance.code_universe(fixture.trade(spark, sf_dir))
    return structure.link_distribution(structure.focal_codes(g).unionByName(structure.implied_identities(g, universe)))


@query("SELECT period, side, class, n, round(share,6) AS share FROM dist")
def link_distribution(spark, sf_dir):
    return _distribution(spark, sf_dir).select("period", "side", "class", "n", *r6("share"))


@query("SELECT period, side, class, count(*) AS n FROM foc GROUP BY 1,2,3")
def link_distribution_observed(spark, sf_dir):
    return structure.link_distribution(structure.focal_codes(groups_of(spark, sf_dir))).select("period", "side", "class", "n")


def _structure_inputs(spark, sf_dir):
    return fixture.edges(spark, sf_dir), universe_of(spark, sf_dir)


@query("""SELECT y.compare_year, c.class, coalesce(n,0) AS n, round(coalesce(n,0)/sum(coalesce(n,0)) OVER (PARTITION BY y.compare_year),6) AS share FROM (SELECT DISTINCT compare_year FROM rels) y
CROSS JOIN (SELECT unnest(['1:1','m:1','1:n','m:n']) AS class) c LEFT JOIN (SELECT compare_year, class, count(*) AS n FROM relc GROUP BY 1,2) r ON r.compare_year=y.compare_year AND r.class=c.class""")
def chained_link_distribution(spark, sf_dir):
    edges, universe = _structure_inputs(spark, sf_dir)
    out = structure.chained_link_distribution(edges, universe, FIRST, list(range(FIRST + 1, BASE + 1)))
    return out.select("compare_year", "class", "n", *r6("share"))


@query("""SELECT y.compare_year, c.class, coalesce(n,0) AS n, round(coalesce(n,0)/sum(coalesce(n,0)) OVER (PARTITION BY y.compare_year),6) AS share FROM (SELECT DISTINCT compare_year FROM relsb) y
CROSS JOIN (SELECT unnest(['1:1','m:1','1:n','m:n']) AS class) c LEFT JOIN (SELECT compare_year, class, count(*) AS n FROM relcb GROUP BY 1,2) r ON r.compare_year=y.compare_year AND r.class=c.class""")
def chained_link_distribution_back(spark, sf_dir):
    edges, universe = _structure_inputs(spark, sf_dir)
    out = structure.chained_link_distribution(edges, universe, LAST, list(range(LAST - 1, BASE - 1, -1)))
    return out.select("compare_year", "class", "n", *r6("share"))


@query(f"""SELECT e.compare_year, e.from_code, ever_non_one, ever_unknown, CAST(n_unknown AS BIGINT) AS n_unknown, n_unknown>=2 AS two_or_more, NOT ever_non_one AS strict_one, r.class AS final_class FROM (
 SELECT compare_year, from_code, max(non_one) OVER w > 0 AS ever_non_one, max(unk) OVER w > 0 AS ever_unknown, sum(unk) OVER w AS n_unknown FROM (
  SELECT b.compare_year-1 AS compare_year, b.from_code, max(CAST(s.class<>'1:1' AS INT)) AS non_one, max(CAST(s.class IN ('m:1','m:n') AS INT)) AS unk FROM
   (SELECT {LAST} AS compare_year, code AS from_code, code AS to_code FROM univ WHERE year={LAST} UNION ALL SELECT * FROM relsb) b JOIN stpcb s ON s.compare_year=b.compare_year-1 AND s.from_code=b.to_code GROUP BY 1,2)
 WINDOW w AS (PARTITION BY from_code ORDER BY compare_year DESC ROWS UNBOUNDED PRECEDING)) e JOIN relcb r ON r.compare_year=e.compare_year AND r.from_code=e.from_code""")
def exposure_codes_back(spark, sf_dir):
    edges, universe = _structure_inputs(spark, sf_dir)
    return structure.revision_exposure(edges, universe, LAST, list(range(LAST - 1, BASE - 1, -1)))


_EXPO = f"""SELECT e.compare_year, e.from_code, ever_non_one, ever_unknown, CAST(n_unknown AS BIGINT) AS n_unknown, n_unknown>=2 AS two_or_more, NOT ever_non_one AS strict_one, r.class AS final_class FROM (
 SELECT compare_year, from_code, max(non_one) OVER w > 0 AS ever_non_one, max(unk) OVER w > 0 AS ever_unknown, sum(unk) OVER w AS n_unknown FROM (
  SELECT b.compare_year+1 AS compare_year, b.from_code, max(CAST(s.class<>'1:1' AS INT)) AS non_one, max(CAST(s.class IN ('1:n','m:n') AS INT)) AS unk FROM
   (SELECT {FIRST} AS compare_year, code AS from_code, code AS to_code FROM univ WHERE year={FIRST} UNION ALL SELECT * FROM rels) b JOIN stpc s ON s.compare_year=b.compare_year+1 AND s.from_code=b.to_code GROUP BY 1,2)
 WINDOW w AS (PARTITION BY from_code ORDER BY compare_year ROWS UNBOUNDED PRECEDING)) e JOIN relc r ON r.compare_year=e.compare_year AND r.from_code=e.from_code"""


@query(_EXPO)
def exposure_codes(spark, sf_dir):
    edges, universe = _structure_inputs(spark, sf_dir)
    return structure.revision_exposure(edges, universe, FIRST, list(range(FIRST + 1, BASE + 1)))


@query(f"""SELECT compare_year, population, metric, CAST(sum(flag) AS BIGINT) AS n, count(*) AS total, round(sum(flag)/count(*),6) AS share FROM (
 SELECT compare_year, population, unnest(['ever_non_one','ever_unknown','two_or_more','strict_one']) AS metric, unnest([CAST(ever_non_one AS INT), CAST(ever_unknown AS INT), CAST(two_or_more AS INT), CAST(strict_one AS INT)]) AS flag FROM (
  SELECT *, 'all' AS population FROM ({_EXPO}) UNION ALL SELECT *, 'allowed' FROM ({_EXPO}) WHERE from_code LIKE '%1')) GROUP BY 1,2,3""")
def exposure_summary(spark, sf_dir):
    edges, universe = _structure_inputs(spark, sf_dir)
    expo = structure.revision_exposure(edges, universe, FIRST, list(range(FIRST + 1, BASE + 1)))
    allow = universe.where("code like '%1'").select("code").distinct()
    out = structure.exposure_summary(expo, allow)
    return out.select("compare_year", "population", "metric", "n", "total", *r6("share"))


@query(f"""SELECT compare_year, metric, CAST(sum(flag) AS BIGINT) AS n, round(sum(flag)/count(*),6) AS share FROM (
 SELECT compare_year, unnest(['ever_non_one','ever_unknown','two_or_more','strict_one']) AS metric, unnest([CAST(ever_non_one AS INT), CAST(ever_unknown AS INT), CAST(two_or_more AS INT), CAST(strict_one AS INT)]) AS flag
 FROM ({_EXPO}) WHERE compare_year={BASE}) GROUP BY 1,2""")
def exposure_benchmark(spark, sf_dir):
    """The exposure summary at chosen years."""
    edges, universe = _structure_inputs(spark, sf_dir)
    expo = structure.revision_exposure(edges, universe, FIRST, list(range(FIRST + 1, BASE + 1)))
    out = structure.exposure_summary(expo, universe.select("code").distinct())
    return structure.benchmark_slice(out.where("population = 'all'"), [BASE]).select("compare_year", "metric", "n", *r6("share"))


# ------------------------------------------------------------ persistence
def _group_map(spark, sf_dir):
    """Codes of the base vintage in groups that the last step before it makes ambiguous."""
    g = groups_of(spark, sf_dir)
    amb = g.summary.where((F.col("period") == BREAK) & F.col("a_to_b_ambiguous")).select("group_id")
    return g, checkpointed(g.edges.where(F.col("period") == BREAK).select(F.col("vintage_b_code").alias("code"), "group_id").distinct().join(amb, "group_id", "left_semi"))


def _carried(spark, sf_dir):
    rows = checkpointed(persistence.bilateral_totals(fixture.trade(spark, sf_dir)))
    return persistence.carry_to_basis(rows, fixture.edges(spark, sf_dir), BASE, FIRST, LAST)


def _panel(spark, sf_dir, level="bilateral"):
    _, group_map = _group_map(spark, sf_dir)
    return group_map, checkpointed(persistence.completed_panel(persistence.scaled_flows(_carried(spark, sf_dir), group_map, level), group_map, level))


@query("SELECT year, REPORTER, PARTNER, code, round(value+1e-6,2) AS value FROM bil")
def bilateral_totals(spark, sf_dir):
    return persistence.bilateral_totals(fixture.trade(spark, sf_dir)).withColumn("value", F.round(F.col("value") + 1e-6, 2))


@query("SELECT year, REPORTER, PARTNER, code, round(value+1e-6,2) AS value FROM bilc")
def carried_rows(spark, sf_dir):
    return _carried(spark, sf_dir).select("year", "REPORTER", "PARTNER", "code", F.round(F.col("value") + 1e-6, 2).alias("value"))


@query("SELECT year, REPORTER, PARTNER, group_id, code, round(flow,6) AS flow, round(lag,6) AS lag FROM pan")
def persistence_panel(spark, sf_dir):
    return _panel(spark, sf_dir)[1].select("year", "REPORTER", "PARTNER", "group_id", "code", *r6("flow", "lag"))


@query("SELECT year, round(coef,5) AS coef, round(se,5) AS se, n FROM reg")
def persistence_regression(spark, sf_dir):
    out = persistence.persistence(_panel(spark, sf_dir)[1])
    return out.select("year", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"), "n")


_REG = "year, round(coef,5) AS coef, round(se,5) AS se, n, round(r2_45,5) AS r2_45"


@query(f"SELECT 'bilateral' AS level, {_REG} FROM reg UNION ALL SELECT 'importer', {_REG} FROM regimp UNION ALL SELECT 'aggregate', {_REG} FROM regagg")
def persistence_levels(spark, sf_dir):
    _, group_map = _group_map(spark, sf_dir)
    carried, out = _carried(spark, sf_dir), None
    for level in persistence.LEVELS:
        panel = checkpointed(persistence.completed_panel(persistence.scaled_flows(carried, group_map, level), group_map, level))
        part = persistence.persistence(panel).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out.select("level", "year", *[F.round(c, 5).alias(c) for c in ("coef", "se")], "n", F.round("r2_45", 5).alias("r2_45"))


def _row_sets(spark, sf_dir):
    """Regressions of three row sets: all groups, those that no other revision
    contaminates, and the deterministic basis of every code."""
    lines, edges = fixture.stored_lines(spark, sf_dir), fixture.edges(spark, sf_dir)
    _, group_map = _group_map(spark, sf_dir)
    links = checkpointed(persistence.carry_links(edges))
    many = concordance.nonbijective_codes(edges.where(f"period = '{LAST - 1}{LAST}'")).where("side = 'a' and cast(code as bigint) % 32 < 16").select("code")
    hit = persistence.contaminated_groups(group_map, {LAST - 1: many}, edges, BASE, links)
    clean = group_map.join(hit.select("group_id").distinct(), "group_id", "left_anti")
    by_code, sets = fixture.trade_by_code(spark, sf_dir), None
    basis = persistence.deterministic_basis(concordance.code_universe(by_code), group_map, BASE)
    for name, rows in (("adjusted", group_map), ("clean", clean), ("deterministic", basis)):
        rows = rows.select(F.lit(name).alias("row"), "code", "group_id")
        sets = rows if sets is None else sets.unionByName(rows)
    codes = checkpointed(persistence.fact_codes(by_code))
    carried = persistence.code_map(codes, edges, BASE, FIRST, LAST, links)
    codes = codes.join(carried, ["code", "year"]).drop("code").withColumnRenamed("basis_code", "code")
    return persistence.panel_fits(persistence.bilateral_rows(lines), codes, checkpointed(sets), list(YEARS), ("row",))


@query(f"SELECT 'adjusted' AS \"row\", {_REG} FROM reg UNION ALL SELECT 'clean', {_REG} FROM regcl UNION ALL SELECT 'deterministic', {_REG} FROM regdet")
def persistence_row_sets(spark, sf_dir):
    return _row_sets(spark, sf_dir).select("row", "year", *[F.round(c, 5).alias(c) for c in ("coef", "se")], "n", F.round("r2_45", 5).alias("r2_45"))


@query(f"SELECT DISTINCT group_id, code FROM smp WHERE code IN (SELECT code FROM bad{BASE})")
def contaminated_codes(spark, sf_dir):
    _, group_map = _group_map(spark, sf_dir)
    edges = fixture.edges(spark, sf_dir)
    many = concordance.nonbijective_codes(edges.where(f"period = '{LAST - 1}{LAST}'")).where("side = 'a' and cast(code as bigint) % 32 < 16").select("code")
    return persistence.contaminated_groups(group_map, {LAST - 1: many}, edges, BASE)


@query("""SELECT year, count(DISTINCT group_id) AS n_groups, count(DISTINCT code) AS n_codes, count(DISTINCT REPORTER||PARTNER) AS n_units, count(*) AS n_cells,
count(CASE WHEN flow>0 THEN 1 END) AS n_positive, count(CASE WHEN lag>0 THEN 1 END) AS n_positive_lag FROM pan GROUP BY 1""")
def persistence_diagnostics(spark, sf_dir):
    return persistence.panel_diagnostics(_panel(spark, sf_dir)[1])


@query("SELECT \"row\", " + ", ".join(f"max(CASE WHEN year={y} THEN printf('%.3f (%.3f)', coef, se) END) AS \"{y}\"" for y in range(BASE + 1, LAST + 1)) + " FROM (SELECT 'adjusted' AS \"row\", * FROM reg UNION ALL SELECT 'clean', * FROM regcl UNION ALL SELECT 'deterministic', * FROM regdet) GROUP BY 1")
def persistence_table(spark, sf_dir):
    """Rows by row set, a cell for each year after the base."""
    return persistence.result_table(_row_sets(spark, sf_dir), "row", list(range(BASE + 1, LAST + 1)))


@query(f"""SELECT u.code, coalesce(s.group_id, 'singleton::{BASE}::'||u.code) AS group_id FROM univ u LEFT JOIN smp s ON s.code=u.code WHERE u.year={BASE}""")
def deterministic_basis(spark, sf_dir):
    _, group_map = _group_map(spark, sf_dir)
    return persistence.deterministic_basis(concordance.code_universe(fixture.trade(spark, sf_dir)), group_map, BASE)


# -------------------------------------------------------------- synthetic
def _timed(spark, sf_dir):
    edges = fixture.edges(spark, sf_dir).where(F.col("period") == BREAK)
    c = edges.select(F.lit("prehistory").alias("concept"), F.col("vintage_b_code").alias("code")).union(edges.select(F.lit("afterlife"), "vintage_a_code")).distinct()
    totals = _totals(spark, sf_dir)
    return checkpointed(synthetic.timing(c, totals, concordance.code_lifetimes(fixture.edges(spark, sf_dir)))), totals


@query(f"""SELECT concept, code, CAST(obs_first AS STRING) AS obs_first, CAST(obs_last AS STRING) AS obs_last, CAST(introduced AS STRING) AS introduced, CAST(sunset AS STRING) AS sunset, CASE WHEN concept='prehistory' AND (coalesce(obs_first,introduced)<={FIRST} OR coalesce(obs_first,introduced)>{LAST}) THEN 'introduced_outside_window'
WHEN obs_first IS NULL THEN 'absent_in_window_data' WHEN concept='afterlife' AND coalesce(obs_last,sunset)>={LAST} THEN 'concept_not_afterlife' ELSE 'included' END AS status FROM timed""")
def code_timing(spark, sf_dir):
    out = synthetic.inclusion(_timed(spark, sf_dir)[0], FIRST, LAST)
    return out.select("concept", "code", *[F.col(c).cast("string").alias(c) for c in ("obs_first", "obs_last", "introduced", "sunset")], "status")


def _series(spark, sf_dir):
    timed, totals = _timed(spark, sf_dir)
    values = synthetic.converted_values(totals, uniform_chains(spark, sf_dir).weights, timed.select("code"))
    return synthetic.share_series(timed, values, totals, list(YEARS))


@query("SELECT concept, code, year, round(share,6) AS share, is_synthetic, is_inlife FROM ser")
def candidate_series(spark, sf_dir):
    return _series(spark, sf_dir).select("concept", "code", "year", *r6("share"), "is_synthetic", "is_inlife")


@query("""SELECT concept, code, count(CASE WHEN is_synthetic THEN 1 END) AS n_synthetic, count(CASE WHEN is_inlife THEN 1 END) AS n_inlife, round(max(CASE WHEN is_synthetic THEN share END),6) AS peak_synthetic,
round(max(CASE WHEN is_inlife THEN share END),6) AS peak_inlife, round(median(CASE WHEN is_inlife THEN share END),6) AS median_inlife, round(sum(CASE WHEN is_synthetic THEN share END),6) AS sum_synthetic FROM ser GROUP BY 1,2""")
def candidate_evidence(spark, sf_dir):
    out = synthetic.evidence(_series(spark, sf_dir))
    return out.select("concept", "code", "n_synthetic", "n_inlife", *r6("peak_synthetic", "peak_inlife", "median_inlife", "sum_synthetic"))


# ------------------------------------------------------------- robustness
N_BINS = 20


def _robust(spark, sf_dir, n_bins=N_BINS):
    g = groups_of(spark, sf_dir)
    used, _ = estimation.used_shares(fixture.trade(spark, sf_dir), g)
    bins = robustness.dealt_pairs(used, n_bins)
    return g, used, bins


PARTS |= {**bin_parts(N_BINS), **fit_parts("b", "momb")}
PARTS |= {
    "lrun": "SELECT f.* FROM fitb f JOIN flt l USING (period, direction, group_id, from_code, to_code) WHERE l.n_to>1",
    "lsum": f"""SELECT period, direction, measure, group_id, from_code, to_code, min(weight) AS w_min, max(weight) AS w_max, avg(weight) AS w_mean, coalesce(stddev_samp(weight),0) AS w_std, max(weight)-min(weight) AS w_range,
        count(*) AS n_present, {N_BINS}-count(*) AS n_missing FROM lrun GROUP BY 1,2,3,4,5,6""",
    "limp": """SELECT l.*, coalesce(f.s,0)*coalesce(t.s,0) AS importance FROM lsum l
        LEFT JOIN (SELECT period, direction, measure, group_id, code AS from_code, sum(share) AS s FROM used WHERE is_from GROUP BY ALL) f USING (period, direction, measure, group_id, from_code)
        LEFT JOIN (SELECT period, direction, measure, group_id, code AS to_code, sum(share) AS s FROM used WHERE NOT is_from GROUP BY ALL) t USING (period, direction, measure, group_id, to_code)""",
}


@query("SELECT period, direction, measure, group_id, REPORTER, PARTNER, bin FROM hbin")
def holdout_bins(spark, sf_dir):
    """The bin of every pair."""
    _, _, bins = _robust(spark, sf_dir)
    return bins.drop("rows")


@query("SELECT period, direction, measure, group_id, from_code, to_code, bin, round(weight+1e-7,4) AS weight FROM fitb")
def bin_weights(spark, sf_dir):
    """The weights of every leave-one-bin-out fit, against closed forms of each."""
    g, used, bins = _robust(spark, sf_dir)
    return robustness.bin_weights(used, bins, g).select(*robustness.LINK, "bin", near("weight"))


def _link_runs(spark, sf_dir):
    g, used, bins = _robust(spark, sf_dir)
    runs = robustness.reported(robustness.weights_by_bin(used, bins, g))  # a code's links are in the same runs
    summary = robustness.link_summary(robustness.exploded(runs), N_BINS)
    return used, checkpointed(summary)


@query("""SELECT period, direction, measure, group_id, from_code, to_code, round(w_min+1e-7,4) AS w_min, round(w_max+1e-7,4) AS w_max, round(w_mean+1e-7,4) AS w_mean, round(w_std+1e-7,4) AS w_std, round(w_range+1e-7,4) AS w_range,
n_present, n_missing, round(importance+1e-7,4) AS importance FROM limp""")
def link_stability(spark, sf_dir):
    """Spread of each link's weight over the refits, with its importance."""
    used, summary = _link_runs(spark, sf_dir)
    out = summary.join(robustness.link_importance(used, summary), robustness.LINK)
    return out.select(*robustness.LINK, *map(near, ("w_min", "w_max", "w_mean", "w_std", "w_range")), "n_present", "n_missing", near("importance"))


_SPREAD = ["p50", "p75", "p90", "p95", "share_le_05", "share_le_1", "share_gt_20"]


@query("""SELECT period, direction, measure, count(*) AS n_links, round(quantile_cont(w_range,0.5)+1e-7,4) AS p50, round(quantile_cont(w_range,0.75)+1e-7,4) AS p75, round(quantile_cont(w_range,0.9)+1e-7,4) AS p90, round(quantile_cont(w_range,0.95)+1e-7,4) AS p95,
round(avg(CASE WHEN w_range<=0.05 THEN 1.0 ELSE 0 END)+1e-7,4) AS share_le_05, round(avg(CASE WHEN w_range<=0.1 THEN 1.0 ELSE 0 END)+1e-7,4) AS share_le_1, round(avg(CASE WHEN w_range>0.2 THEN 1.0 ELSE 0 END)+1e-7,4) AS share_gt_20,
round(sum(CASE WHEN importance>0 THEN importance*w_range END)/sum(CASE WHEN importance>0 THEN importance END)+1e-7,4) AS instability, count(CASE WHEN n_missing>0 THEN 1 END) AS n_absent FROM limp GROUP BY 1,2,3""")
def robustness_summary(spark, sf_dir):
    """Spread and importance-weighted instability by step, and links that a run lacks."""
    used, summary = _link_runs(spark, sf_dir)
    whole = robustness.robustness_row(summary)
    weighed = robustness.weighted_instability(summary, robustness.link_importance(used, summary))
    absent = robustness.uncovered_links(summary).groupBy("period", "direction", "measure").agg(F.count(F.lit(1)).alias("n_absent"))
    key = ["period", "direction", "measure"]
    out = whole.join(weighed, key).join(absent, key, "left").na.fill(0, ["n_absent"])
    return out.select(*key, "n_links", *map(near, _SPREAD), near("instability"), "n_absent")


@query("""SELECT s.period, s.direction, count(*) AS n_rows, round(sum(s.value)+1e-3,1) AS value FROM used s JOIN (SELECT DISTINCT period, direction, group_id, REPORTER, PARTNER FROM used WHERE measure='VALUE_EUR' AND REPORTER<>'C01') k
USING (period, direction, group_id, REPORTER, PARTNER) WHERE s.measure='VALUE_EUR' GROUP BY 1,2""")
def holdout_filter(spark, sf_dir):
    """Shares without the pairs of a bin: here the pairs of one reporter."""
    _, used, _ = _robust(spark, sf_dir)
    bins = used.select(*estimation.KEY, "REPORTER", "PARTNER").distinct().withColumn("bin", (F.col("REPORTER") == "C01").cast("int"))
    return robustness.without_bin(used, bins, 1).groupBy("period", "direction").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value") + 1e-3, 1).alias("value"))


@query(f"SELECT period, direction, measure, group_id, from_code, to_code, round(coalesce(f.s,0)*coalesce(t.s,0),6) AS importance FROM (SELECT o.period, o.direction, k.measure, o.group_id, o.from_code, o.to_code FROM ori o JOIN (SELECT DISTINCT period, direction, measure, group_id FROM used) k USING (period, direction, group_id) WHERE k.measure='VALUE_EUR') "
       "LEFT JOIN (SELECT period, direction, measure, group_id, code AS from_code, sum(share) AS s FROM used WHERE is_from GROUP BY ALL) f USING (period, direction, measure, group_id, from_code) LEFT JOIN (SELECT period, direction, measure, group_id, code AS to_code, sum(share) AS s FROM used WHERE NOT is_from GROUP BY ALL) t USING (period, direction, measure, group_id, to_code)")
def link_importance(spark, sf_dir):
    g, used, _ = _robust(spark, sf_dir)
    links = concordance.oriented(g.edges).join(used.select(*estimation.KEY).distinct(), ["period", "direction", "group_id"])
    return robustness.link_importance(used, links).select(*robustness.LINK, *r6("importance"))


TARGETS = robustness.target_years(FIRST, LAST)
for _t in TARGETS:
    if _t != BASE:
        PARTS |= chain_parts(_t, f"t{_t}_", years=tuple(range(_t - 1, _t + 3))) | panel_parts(_t, f"t{_t}_")
PARTS["pairs_targets"] = " UNION ALL ".join(f"SELECT {t} AS target_year, * FROM pairs{'' if t == BASE else f't{t}_'} WHERE x_year BETWEEN {t - 1} AND {t + 1}" for t in TARGETS)


def _panels_by_target(spark, sf_dir):
    """Pairs around every revision, each at its own target vintage and groups."""
    out = None
    for t in TARGETS:
        part = panels.year_pairs(_at(spark, sf_dir, t, t - 1, t + 2)).withColumn("target_year", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return robustness.panel_summary(robustness.panel_details(out))


_SUMMARY = """SELECT target_year, (pre+post)/2 AS r2_baseline, brk AS r2_break, (pre+post)/2-brk AS r2_penalty, mae_brk-(mae_pre+mae_post)/2 AS mae_excess FROM (SELECT target_year,
max(CASE WHEN x_year=target_year-1 THEN r2 END) AS pre, max(CASE WHEN x_year=target_year THEN r2 END) AS brk, max(CASE WHEN x_year=target_year+1 THEN r2 END) AS post,
max(CASE WHEN x_year=target_year-1 THEN mae END) AS mae_pre, max(CASE WHEN x_year=target_year THEN mae END) AS mae_brk, max(CASE WHEN x_year=target_year+1 THEN mae END) AS mae_post FROM
(SELECT target_year, x_year, 1-sum((share_t1-share_t)*(share_t1-share_t))/(var_pop(share_t1)*count(*)) AS r2, avg(abs(share_t1-share_t)) AS mae FROM pairs_targets GROUP BY 1,2) GROUP BY 1)"""


@query("""SELECT target_year, round((pre+post)/2,6) AS r2_baseline, round(brk,6) AS r2_break, round((pre+post)/2-brk,6) AS r2_penalty, round(mae_brk-(mae_pre+mae_post)/2,6) AS mae_excess FROM (SELECT target_year,
max(CASE WHEN x_year=target_year-1 THEN r2 END) AS pre, max(CASE WHEN x_year=target_year THEN r2 END) AS brk, max(CASE WHEN x_year=target_year+1 THEN r2 END) AS post,
max(CASE WHEN x_year=target_year-1 THEN mae END) AS mae_pre, max(CASE WHEN x_year=target_year THEN mae END) AS mae_brk, max(CASE WHEN x_year=target_year+1 THEN mae END) AS mae_post FROM
(SELECT target_year, x_year, 1-sum((share_t1-share_t)*(share_t1-share_t))/(var_pop(share_t1)*count(*)) AS r2, avg(abs(share_t1-share_t)) AS mae FROM pairs_targets GROUP BY 1,2) GROUP BY 1)""")
def revision_panels(spark, sf_dir):
    return _panels_by_target(spark, sf_dir).select("target_year", *r6("r2_baseline", "r2_break", "r2_penalty", "mae_excess"))


@query(f"""SELECT y.target_year, i.direction, round(r2_baseline,5) AS r2_baseline, round(r2_break,5) AS r2_break, round(r2_penalty,5) AS r2_penalty, round(mae_excess,5) AS mae_excess, round(instability+1e-7,4) AS instability,
CASE WHEN r2_break IS NULL AND instability IS NULL THEN 'skipped' ELSE 'done' END AS status FROM (SELECT unnest({list(TARGETS)})::INT AS target_year) y LEFT JOIN ({_SUMMARY}) s ON s.target_year=y.target_year
LEFT JOIN (SELECT direction, CAST(substr(period,5,4) AS INT) AS target_year, sum(CASE WHEN importance>0 THEN importance*w_range END)/sum(CASE WHEN importance>0 THEN importance END) AS instability FROM limp GROUP BY 1,2) i ON i.target_year=y.target_year""")
def revision_validation(spark, sf_dir):
    """All target years, with the instability of 20 refits in either direction."""
    fixture.stored_trade(spark, sf_dir)
    summary = _panels_by_target(spark, sf_dir)
    used, links = _link_runs(spark, sf_dir)
    weighed = robustness.weighted_instability(links, robustness.link_importance(used, links), ("period", "direction"))
    instability = weighed.select(F.substring("period", 5, 4).cast("int").alias("target_year"), "direction", "instability")
    years = spark.createDataFrame([(y,) for y in TARGETS], "target_year int")
    out = robustness.revision_validation(years, summary, instability)
    return out.select("target_year", "direction", *[F.round(c, 5).alias(c) for c in ("r2_baseline", "r2_break", "r2_penalty", "mae_excess")], near("instability"), "status")


# ---------------------------------------------------------------- figures
@query("""SELECT period, round(coalesce(sum(CASE WHEN class='1:1' THEN share END),0),6) AS "1:1", round(coalesce(sum(CASE WHEN class='m:1' THEN share END),0),6) AS "m:1",
round(coalesce(sum(CASE WHEN class='1:n' THEN share END),0),6) AS "1:n", round(coalesce(sum(CASE WHEN class='m:n' THEN share END),0),6) AS "m:n" FROM dist WHERE side='a' GROUP BY 1""")
def class_share_matrix(spark, sf_dir):
    out = figures.class_share_matrix(_distribution(spark, sf_dir).where("side = 'a'"), "period")
    return out.select("period", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in figures.CLASSES])


@query("""SELECT x_year, metric, round(CASE WHEN hi=lo THEN 0.5 ELSE (v-lo)/(hi-lo) END,5) AS scaled FROM (SELECT *, min(v) OVER (PARTITION BY metric) AS lo, max(v) OVER (PARTITION BY metric) AS hi FROM (
SELECT x_year, 'mae' AS metric, avg(abs(share_t1-share_t)) AS v FROM pairs GROUP BY 1 UNION ALL SELECT x_year, 'n', -ln(1+count(*)) FROM pairs GROUP BY 1))""")
def scaled_rows(spark, sf_dir):
    out = figures.scaled_rows(panels.panel_metrics(panels.year_pairs(_base(spark, sf_dir)[4])), "x_year", ["mae", "n"], ("n",))
    return out.select("x_year", "metric", F.round("scaled", 5).alias("scaled"))


@query("""SELECT CAST(least(floor(abs(share_t1-share_t)*20)+1,20) AS INT) AS bin, count(*) AS n FROM pairs GROUP BY 1""")
def change_histogram(spark, sf_dir):
    pairs = panels.year_pairs(_base(spark, sf_dir)[4]).withColumn("change", F.abs(F.col("share_t1") - F.col("share_t")))
    return figures.histogram(pairs, "change", 0.0, 1.0, 20)


@query("""SELECT PERIOD AS year, REPORTER, PARTNER, round(sum(VALUE_EUR)+1e-6,2) AS value FROM trade GROUP BY 1,2,3""")
def pair_totals(spark, sf_dir):
    t = fixture.trade(spark, sf_dir)
    return t.groupBy(F.col("PERIOD").alias("year"), "REPORTER", "PARTNER").agg(F.round(F.sum("VALUE_EUR") + 1e-6, 2).alias("value"))
