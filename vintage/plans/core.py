"""Registered queries: correspondence, estimation, chaining, re-coding."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.operators import apply, chain, concordance, estimation, weights
from vintage.plans import harmonise
from vintage.plans.fits_sql import LINKS, fit_parts
from vintage.plans.sql import BASE, PARTS, YEARS, step_of
from vintage.sources import fixture
from vintage.sources.storage import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Oracle statements without their common parts; the registry adds those.
BODIES: dict[str, str] = {}
BOTH = ["VALUE_EUR", "QUANTITY_KG"]


def query(body: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, with ``body``, its oracle statement."""

    def add(f: Query) -> Query:
        key = name or f.__name__

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with fixture.once():
                return f(spark, sf_dir)

        QUERIES[key] = run
        if body:
            BODIES[key] = body
        return f

    return add


def r6(*columns: str) -> list[F.Column]:
    return [F.round(c, 6).alias(c) for c in columns]


def groups_of(spark: SparkSession, sf_dir: str) -> concordance.Groups:
    return fixture.held(spark, sf_dir, "groups", lambda: concordance.build_groups(fixture.edges(spark, sf_dir)))


def universe_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.held(spark, sf_dir, "universe", lambda: checkpointed(concordance.code_universe(fixture.trade_by_code(spark, sf_dir))))


def uniform_steps(edges: DataFrame, measure: str = "VALUE_EUR") -> DataFrame:
    """Solver-free step weights, both directions: 1/k over a code's k links;
    for quantities the first link has twice the weight of each other one."""
    e = concordance.distinct_edges(edges)
    out = None
    for d, s, o in (("a_to_b", "a", "b"), ("b_to_a", "b", "a")):
        w = W.partitionBy("period", f"vintage_{s}_code")
        k, first = F.count(F.lit(1)).over(w), F.col(f"vintage_{o}_code") == F.min(f"vintage_{o}_code").over(w)
        weight = 1.0 / k if measure == "VALUE_EUR" else F.when(first, 2.0).otherwise(1.0) / (k + 1)
        part = e.select("period", F.lit(d).alias("direction"), F.col(f"vintage_{s}_code").alias("from_code"), F.col(f"vintage_{o}_code").alias("to_code"), weight.alias("weight"))
        out = part if out is None else out.union(part)
    return out.withColumn("measure", F.lit(measure))


def uniform_chains(spark: SparkSession, sf_dir: str, measures: list[str] = ["VALUE_EUR"], target: int = BASE, first: int = YEARS[0], last: int = YEARS[-1]) -> chain.Chained:  # noqa: B006
    edges = fixture.edges(spark, sf_dir)

    def all_steps() -> DataFrame:
        steps = uniform_steps(edges, measures[0])
        for m in measures[1:]:
            steps = steps.unionByName(uniform_steps(edges, m))
        return checkpointed(steps)

    steps, universe = fixture.held(spark, sf_dir, "steps " + " ".join(measures), all_steps), universe_of(spark, sf_dir)
    return chain.chain_range(steps, universe, first, last, target, measures, final=False)


# ------------------------------------------------------- correspondence
@query("SELECT period, vintage_a_year, vintage_b_year, vintage_a_code, vintage_b_code FROM edges")
def concordance_edges(spark, sf_dir):
    return concordance.distinct_edges(fixture.edges(spark, sf_dir))


@query("""SELECT period, 'a' AS side, vintage_a_code AS code, count(DISTINCT vintage_b_code) AS n_links, count(DISTINCT vintage_b_code)=1 AS deterministic FROM edges GROUP BY 1,3
UNION ALL SELECT period, 'b', vintage_b_code, count(DISTINCT vintage_a_code), count(DISTINCT vintage_a_code)=1 FROM edges GROUP BY 1,3""")
def node_degrees(spark, sf_dir):
    return concordance.node_degrees(fixture.edges(spark, sf_dir))


@query("SELECT period, vintage_a_year, vintage_b_year, vintage_a_code, vintage_b_code, group_id FROM ge")
def concordance_groups(spark, sf_dir):
    return groups_of(spark, sf_dir).edges


@query("SELECT period, vintage_a_year, vintage_b_year, group_id, n_vintage_a, n_vintage_b, n_edges, a_to_b_ambiguous, b_to_a_ambiguous FROM summ")
def group_summary(spark, sf_dir):
    return groups_of(spark, sf_dir).summary.select(
        "period", "vintage_a_year", "vintage_b_year", "group_id", "n_vintage_a", "n_vintage_b", "n_edges", "a_to_b_ambiguous", "b_to_a_ambiguous"
    )


@query("SELECT o.period, o.direction, o.from_code, o.to_code, o.group_id FROM ori o JOIN amb USING (period, direction, group_id)")
def ambiguous_edges(spark, sf_dir):
    return concordance.ambiguous_edges(groups_of(spark, sf_dir)).select("period", "direction", "from_code", "to_code", "group_id")


@query("""SELECT period, direction, from_code, to_code, group_id, CAST(1.0 AS DOUBLE) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY period, direction, from_code) AS n FROM ori) WHERE n=1""")
def deterministic_maps(spark, sf_dir):
    return concordance.deterministic_maps(groups_of(spark, sf_dir)).select("period", "direction", "from_code", "to_code", "group_id", "weight")


@query("SELECT period, direction, code FROM rev")
def revised_index(spark, sf_dir):
    return concordance.revised_codes(groups_of(spark, sf_dir))


@query("SELECT period, group_id FROM summ WHERE a_to_b_ambiguous OR b_to_a_ambiguous")
def ambiguous_either(spark, sf_dir):
    return concordance.ambiguous_either(groups_of(spark, sf_dir))


@query("SELECT period, vintage_a_year, vintage_b_year, vintage_a_code, vintage_b_code FROM degs WHERE deg_a=1 AND deg_b=1")
def strict_one_to_one(spark, sf_dir):
    return concordance.strict_one_to_one(fixture.edges(spark, sf_dir))


@query("SELECT period, 'a' AS side, vintage_a_code AS code FROM degs WHERE deg_a>1 OR deg_b>1 UNION SELECT period, 'b', vintage_b_code FROM degs WHERE deg_a>1 OR deg_b>1")
def nonbijective_codes(spark, sf_dir):
    return concordance.nonbijective_codes(fixture.edges(spark, sf_dir))


@query("""SELECT period, 'a' AS side, vintage_a_code AS code FROM edges GROUP BY 1,3 HAVING count(*)>1 OR min(vintage_b_code)<>vintage_a_code
UNION ALL SELECT period, 'b', vintage_b_code FROM edges GROUP BY 1,3 HAVING count(*)>1 OR min(vintage_a_code)<>vintage_b_code""")
def unstable_codes(spark, sf_dir):
    return concordance.unstable_codes(fixture.edges(spark, sf_dir))


@query("SELECT period, 'a' AS side, vintage_a_code AS code FROM edges UNION SELECT period, 'b', vintage_b_code FROM edges")
def revised_sides(spark, sf_dir):
    return concordance.revised_sides(fixture.edges(spark, sf_dir))


@query("SELECT period, direction, from_code, count(DISTINCT to_code) AS k FROM ori GROUP BY 1,2,3")
def feasible_targets(spark, sf_dir):
    return concordance.feasible_targets(concordance.oriented(groups_of(spark, sf_dir).edges))


@query("SELECT year, code FROM univ")
def code_universe(spark, sf_dir):
    return concordance.code_universe(fixture.trade(spark, sf_dir))


@query("""SELECT coalesce(b.code, a.code) AS code, introduced, sunset FROM (SELECT vintage_b_code AS code, min(vintage_b_year) AS introduced FROM edges GROUP BY 1) b
FULL JOIN (SELECT vintage_a_code AS code, max(vintage_a_year) AS sunset FROM edges GROUP BY 1) a ON a.code=b.code""")
def code_lifetimes(spark, sf_dir):
    return concordance.code_lifetimes(fixture.edges(spark, sf_dir))


@query("SELECT period, side, year, code, group_id FROM cg")
def code_groups(spark, sf_dir):
    return concordance.code_groups(groups_of(spark, sf_dir))


# ----------------------------------------------------------- estimation
def _shares(spark, sf_dir):
    g = groups_of(spark, sf_dir)
    shares = checkpointed(estimation.side_shares(fixture.trade(spark, sf_dir), g, measures=BOTH))
    return g, shares, checkpointed(estimation.group_totals(shares, g, BOTH))


@query("SELECT period, direction, measure, group_id, side, code, REPORTER, PARTNER, round(value,2) AS value, round(share,6) AS share FROM sh")
def estimation_shares(spark, sf_dir):
    shares = estimation.side_shares(fixture.trade(spark, sf_dir), groups_of(spark, sf_dir), measures=BOTH)
    return shares.select(*estimation.KEY, "side", "code", "REPORTER", "PARTNER", F.round("value", 2).alias("value"), *r6("share"))


@query("""SELECT period, direction, measure, group_id, round(total_a,2) AS total_a, round(total_b,2) AS total_b, n_rows_a, n_rows_b, n_pairs_a, n_pairs_b, skip_reason FROM tots""")
def group_totals(spark, sf_dir):
    _, _, totals = _shares(spark, sf_dir)
    return totals.select(*estimation.KEY, F.round("total_a", 2).alias("total_a"), F.round("total_b", 2).alias("total_b"), "n_rows_a", "n_rows_b", "n_pairs_a", "n_pairs_b", "skip_reason")


@query("SELECT DISTINCT period, direction, measure, group_id, REPORTER, PARTNER FROM used")
def pair_universe(spark, sf_dir):
    _, shares, totals = _shares(spark, sf_dir)
    return estimation.pair_universe(estimation.usable_shares(shares, totals))


@query("""SELECT k.period, k.direction, k.measure, k.group_id, c.side, c.code, round(coalesce(s.share,0),6) AS share FROM (SELECT DISTINCT period, direction, measure, group_id FROM used) k
JOIN cg c ON c.period=k.period AND c.group_id=k.group_id
LEFT JOIN (SELECT period, direction, measure, group_id, side, code, sum(share) AS share FROM used GROUP BY ALL) s ON s.period=k.period AND s.direction=k.direction AND s.measure=k.measure AND s.group_id=k.group_id AND s.side=c.side AND s.code=c.code""")
def design_columns(spark, sf_dir):
    g, shares, totals = _shares(spark, sf_dir)
    return estimation.design_columns(estimation.usable_shares(shares, totals), g).select(*estimation.KEY, "side", "code", *r6("share"))


@query("SELECT period, direction, measure, group_id, kind, i, j, round(value+1e-9,5) AS value FROM mom")
def normal_moments(spark, sf_dir):
    _, shares, totals = _shares(spark, sf_dir)
    return estimation.normal_moments(estimation.usable_shares(shares, totals)).where("kind <> 'y'").select(*estimation.KEY, "kind", "i", "j", F.round(F.col("value") + 1e-9, 5).alias("value"))


@query("""SELECT period, direction, measure, group_id, from_code, to_code, round(greatest(z - theta, 0.0), 6) AS weight FROM (
 SELECT *, max(CASE WHEN k=kmax THEN css/k END) OVER (PARTITION BY period, direction, measure, group_id, from_code) AS theta FROM (
  SELECT *, max(CASE WHEN z*k > css THEN k END) OVER (PARTITION BY period, direction, measure, group_id, from_code) AS kmax FROM (
   SELECT *, row_number() OVER w AS k, sum(z) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS css FROM (
    SELECT m.period, m.direction, m.measure, m.group_id, o.from_code, o.to_code, coalesce(n.value,0)/m.value AS z
    FROM mom m JOIN ori o ON o.period=m.period AND o.direction=m.direction AND o.group_id=m.group_id AND o.from_code=m.i
    JOIN (SELECT period, direction, group_id FROM ori GROUP BY 1,2,3 HAVING count(DISTINCT from_code)=1) g ON g.period=m.period AND g.direction=m.direction AND g.group_id=m.group_id
    LEFT JOIN mom n ON n.kind='n' AND n.period=m.period AND n.direction=m.direction AND n.measure=m.measure AND n.group_id=m.group_id AND n.i=m.i AND n.j=o.to_code
    WHERE m.kind='m' AND m.i=m.j)
   WINDOW w AS (PARTITION BY period, direction, measure, group_id, from_code ORDER BY z DESC, to_code))))""")
def pure_split_weights(spark, sf_dir):
    g, shares, totals = _shares(spark, sf_dir)
    moments = estimation.normal_moments(estimation.usable_shares(shares, totals))
    return estimation.pure_split_weights(moments, g).select(*estimation.KEY, "from_code", "to_code", *r6("weight"))


PARTS |= {**LINKS, "momf": "SELECT -1 AS bin, * FROM mom", **fit_parts("f", "momf")}


def near(column: str, places: int = 4) -> F.Column:
    """Rounded a little off the halves, which sums in another order may cross."""
    return F.round(F.col(column) + 1e-7, places).alias(column)


@query("SELECT period, direction, measure, group_id, from_code, to_code, round(weight+1e-7,4) AS weight, 'solved' AS status FROM fitf")
def fitted_weights(spark, sf_dir):
    """Row-stochastic weights on the allowed links, against closed forms of all shapes."""
    out = estimation.estimate(fixture.trade(spark, sf_dir), groups_of(spark, sf_dir))
    return out["weights_ambiguous"].select(*estimation.KEY, "from_code", "to_code", near("weight"), "status")


def _fits(spark, sf_dir):
    """Solver weights of the value measure, with moments."""
    g = groups_of(spark, sf_dir)
    out = estimation.estimate(fixture.trade(spark, sf_dir), g, ("VALUE_EUR",))
    return g, checkpointed(out["moments"]), out["weights_ambiguous"]


@query(BODIES["pure_split_weights"].replace("FROM mom m", "FROM (SELECT * FROM mom WHERE measure='VALUE_EUR') m").replace(", 6) AS weight", ", 4) AS weight"))
def fitted_split_weights(spark, sf_dir):
    """The solver's weights of groups with one from-code, against the closed form."""
    g, _, fitted = _fits(spark, sf_dir)
    single = concordance.oriented(g.edges).groupBy("period", "direction", "group_id").agg(F.countDistinct("from_code").alias("n")).where("n = 1").drop("n")
    return fitted.join(single, ["period", "direction", "group_id"], "left_semi").select(*estimation.KEY, "from_code", "to_code", F.round("weight", 4).alias("weight"))


# groups of two from-codes and two to-codes with all four links: B = [[p, 1-p], [q, 1-q]] minimises
# g = a p^2 + 2 b p q + d q^2 - p e - q f over the unit square, with M = [[a, b], [b, d]] and (e, f) = M 1 + n1 - n2;
# the minimum is inside or on one of four edges (with their ends), so all are tried
PARTS |= {
    "sq_groups": """SELECT period, direction, group_id, min(from_code) AS f1, max(from_code) AS f2, min(to_code) AS t1, max(to_code) AS t2 FROM ori
  GROUP BY 1,2,3 HAVING count(DISTINCT from_code)=2 AND count(DISTINCT to_code)=2 AND count(*)=4""",
    "sq_terms": """SELECT m.period, m.direction, m.measure, m.group_id, f1, f2, t1, t2,
  coalesce(sum(CASE WHEN kind='m' AND i=f1 AND j=f1 THEN value END),0) AS a, coalesce(sum(CASE WHEN kind='m' AND i=f1 AND j=f2 THEN value END),0) AS b, coalesce(sum(CASE WHEN kind='m' AND i=f2 AND j=f2 THEN value END),0) AS d,
  coalesce(sum(CASE WHEN kind='n' AND i=f1 AND j=t1 THEN value WHEN kind='n' AND i=f1 AND j=t2 THEN -value END),0) AS n1, coalesce(sum(CASE WHEN kind='n' AND i=f2 AND j=t1 THEN value WHEN kind='n' AND i=f2 AND j=t2 THEN -value END),0) AS n2
  FROM mom m JOIN sq_groups USING (period, direction, group_id) WHERE measure='VALUE_EUR' GROUP BY ALL""",
    "sq_good": "SELECT *, a+b+n1 AS e, b+d+n2 AS f FROM sq_terms WHERE a*d-b*b > 0.05*a*d",
    "sq_tries": """SELECT *, (d*e-b*f)/(2*(a*d-b*b)) AS p, (a*f-b*e)/(2*(a*d-b*b)) AS q FROM sq_good
  UNION ALL SELECT *, 0, greatest(0, least(1, f/(2*d))) FROM sq_good UNION ALL SELECT *, 1, greatest(0, least(1, (f-2*b)/(2*d))) FROM sq_good
  UNION ALL SELECT *, greatest(0, least(1, e/(2*a))), 0 FROM sq_good UNION ALL SELECT *, greatest(0, least(1, (e-2*b)/(2*a))), 1 FROM sq_good""",
    "sq_best": """SELECT *, row_number() OVER (PARTITION BY period, direction, measure, group_id ORDER BY a*p*p+2*b*p*q+d*q*q-p*e-q*f) AS k FROM sq_tries WHERE p BETWEEN 0 AND 1 AND q BETWEEN 0 AND 1""",
}


@query("""SELECT period, direction, measure, group_id, unnest([f1, f1, f2, f2]) AS from_code, unnest([t1, t2, t1, t2]) AS to_code, unnest([round(p,3), round(1-p,3), round(q,3), round(1-q,3)]) AS weight FROM sq_best WHERE k=1""")
def fitted_square_weights(spark, sf_dir):
    """The solver's weights of 2 x 2 groups with all links whose from-codes
    have well told apart trade, against the minimum over all faces."""
    g, moments, fitted = _fits(spark, sf_dir)
    size = concordance.oriented(g.edges).groupBy("period", "direction", "group_id").agg(F.countDistinct("from_code").alias("nf"), F.countDistinct("to_code").alias("nt"), F.count(F.lit(1)).alias("n"))
    m = moments.where("kind = 'm'").groupBy(*estimation.KEY).agg(
        F.sum(F.when(F.col("i") < F.col("j"), F.col("value"))).alias("b"), F.min(F.when(F.col("i") == F.col("j"), F.col("value"))).alias("a"),
        F.max(F.when(F.col("i") == F.col("j"), F.col("value"))).alias("d"), F.count(F.when(F.col("i") == F.col("j"), 1)).alias("k"),
    )
    b = F.coalesce("b", F.lit(0.0))
    good = m.where((F.col("k") == 2) & (F.col("a") * F.col("d") - b * b > 0.05 * F.col("a") * F.col("d"))).select(*estimation.KEY)
    rows = fitted.join(size.where("nf = 2 and nt = 2 and n = 4"), ["period", "direction", "group_id"], "left_semi").join(good, estimation.KEY, "left_semi")
    return rows.select(*estimation.KEY, "from_code", "to_code", F.round("weight", 3).alias("weight"))


PARTS |= {
    "fobj": """SELECT period, direction, measure, group_id, sum(v) AS objective FROM (
        SELECT m.period, m.direction, m.measure, m.group_id, m.value*x.weight*y.weight AS v FROM mom m JOIN fitf x ON x.period=m.period AND x.direction=m.direction AND x.measure=m.measure AND x.group_id=m.group_id AND x.from_code=m.i
          JOIN fitf y ON y.period=m.period AND y.direction=m.direction AND y.measure=m.measure AND y.group_id=m.group_id AND y.from_code=m.j AND y.to_code=x.to_code WHERE m.kind='m'
        UNION ALL SELECT m.period, m.direction, m.measure, m.group_id, -2*m.value*x.weight FROM mom m JOIN fitf x ON x.period=m.period AND x.direction=m.direction AND x.measure=m.measure AND x.group_id=m.group_id AND x.from_code=m.i AND x.to_code=m.j WHERE m.kind='n') GROUP BY 1,2,3,4""",
}


@query("""SELECT f.period, f.direction, f.measure, f.group_id, 'solved' AS status, count(*) AS n_vars, round(min(weight)+1e-7,4) AS min_weight, round(max(weight)+1e-7,4) AS max_weight, 0.0::DOUBLE AS max_row_sum_deviation,
round(any_value(objective)+1e-9,6) AS objective, any_value(n_pairs_a) AS n_pairs_a, any_value(n_pairs_b) AS n_pairs_b, any_value(n_vintage_a) AS n_vintage_a, any_value(n_vintage_b) AS n_vintage_b, any_value(n_edges) AS n_edges
FROM fitf f LEFT JOIN fobj o ON o.period=f.period AND o.direction=f.direction AND o.measure=f.measure AND o.group_id=f.group_id JOIN tots t ON t.period=f.period AND t.direction=f.direction AND t.measure=f.measure AND t.group_id=f.group_id
JOIN summ s ON s.period=f.period AND s.group_id=f.group_id GROUP BY 1,2,3,4""")
def fit_diagnostics(spark, sf_dir):
    d = estimation.estimate(fixture.trade(spark, sf_dir), groups_of(spark, sf_dir))["diagnostics"]
    return d.select(
        *estimation.KEY, "status", "n_vars", near("min_weight"), near("max_weight"), F.round("max_row_sum_deviation", 6).alias("max_row_sum_deviation"),
        F.round(F.col("objective") + 1e-9, 6).alias("objective"), "n_pairs_a", "n_pairs_b", "n_vintage_a", "n_vintage_b", "n_edges",
    )


@query("""SELECT period, direction, measure, count(*) AS n_groups, count(CASE WHEN skip_reason IS NULL THEN 1 END) AS n_with_data, count(CASE WHEN skip_reason IS NULL AND n_rows_a%3<>0 THEN 1 END) AS n_solved,
count(CASE WHEN skip_reason IS NULL AND n_rows_a%3=0 THEN 1 END) AS n_failed, count(skip_reason) AS n_skipped, CAST(sum(n_rows_a) AS BIGINT) AS n_rows_a, CAST(sum(n_rows_b) AS BIGINT) AS n_rows_b,
round(max(CASE WHEN skip_reason IS NULL THEN (n_rows_b%7)/100.0 END),6) AS deviation_max FROM tots GROUP BY 1,2,3""")
def estimation_summary(spark, sf_dir):
    """The run summary over stated outcomes: fits of groups whose rows divide by three count as failed."""
    _, _, totals = _shares(spark, sf_dir)
    ok = totals.where("skip_reason is null")
    outcome = ok.select(*estimation.KEY, F.when(F.col("n_rows_a") % 3 == 0, "max_iter").otherwise("solved").alias("status"), ((F.col("n_rows_b") % 7) / 100.0).alias("max_row_sum_deviation"))
    out = estimation.run_summary(totals, outcome)
    return out.select("period", "direction", "measure", "n_groups", "n_with_data", "n_solved", "n_failed", "n_skipped", "n_rows_a", "n_rows_b", *r6("deviation_max"))


@query("""SELECT period, direction, measure, count(*) AS n_from, CAST(sum(k) AS BIGINT) AS n_links, round(sum(1.0),6) AS total FROM (
 SELECT o.period, o.direction, m.measure, o.from_code, CASE WHEN a.group_id IS NOT NULL THEN count(*) ELSE 1 END AS k FROM ori o CROSS JOIN (SELECT 'VALUE_EUR' AS measure UNION ALL SELECT 'QUANTITY_KG') m
 LEFT JOIN (SELECT period, direction, measure, group_id FROM tots WHERE skip_reason IS NULL) a ON a.period=o.period AND a.direction=o.direction AND a.measure=m.measure AND a.group_id=o.group_id
 GROUP BY o.period, o.direction, m.measure, o.from_code, a.group_id HAVING a.group_id IS NOT NULL OR count(*)=1) GROUP BY 1,2,3""")
def step_weights(spark, sf_dir):
    """Ambiguous and deterministic weights together, ambiguous ones winning:
    codes, links (zero weights too) and the sum of the weights of each step."""
    w = estimation.estimate(fixture.trade(spark, sf_dir), groups_of(spark, sf_dir))["weights"]
    by = w.groupBy("period", "direction", "measure", "from_code").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("s"))
    return by.groupBy("period", "direction", "measure").agg(F.count(F.lit(1)).alias("n_from"), F.sum("k").alias("n_links"), F.round(F.sum("s"), 6).alias("total"))


# -------------------------------------------------------------- weights
_NOISY = "SELECT period, direction, from_code, to_code, CASE WHEN to_code=(max(to_code) OVER (PARTITION BY period, direction, from_code)) THEN weight*0.998 ELSE weight*0.5 END AS weight FROM uni"


@query(f"""SELECT period, direction, from_code, to_code, round(weight/sum(weight) OVER (PARTITION BY period, direction, from_code),6) AS weight FROM ({_NOISY})""")
def finalised_weights(spark, sf_dir):
    u = uniform_steps(fixture.edges(spark, sf_dir))
    last = F.max("to_code").over(W.partitionBy("period", "direction", "from_code"))
    noisy = u.withColumn("weight", F.when(F.col("to_code") == last, F.col("weight") * 0.998).otherwise(F.col("weight") * 0.5))
    return weights.finalise(noisy, ["period", "direction"]).select("period", "direction", "from_code", "to_code", *r6("weight"))


@query(f"""SELECT period, direction, round(max(abs(s-1)),6) AS deviation FROM (SELECT period, direction, from_code, sum(weight) AS s FROM ({_NOISY}) GROUP BY 1,2,3) GROUP BY 1,2""")
def row_sum_deviation(spark, sf_dir):
    u = uniform_steps(fixture.edges(spark, sf_dir))
    last = F.max("to_code").over(W.partitionBy("period", "direction", "from_code"))
    noisy = u.withColumn("weight", F.when(F.col("to_code") == last, F.col("weight") * 0.998).otherwise(F.col("weight") * 0.5))
    return weights.row_sum_deviation(noisy, ["period", "direction"]).select("period", "direction", *r6("deviation"))


_STEP = "SELECT CAST(substr(period,1,4) AS INT) AS year, from_code, to_code, weight FROM uni WHERE direction='a_to_b'"


@query(f"""SELECT u.year, u.code AS from_code, coalesce(w.to_code, u.code) AS to_code, round(coalesce(w.weight,1.0),6) AS weight FROM univ u LEFT JOIN ({_STEP}) w ON w.year=u.year AND w.from_code=u.code""")
def identity_completion(spark, sf_dir):
    step = uniform_steps(fixture.edges(spark, sf_dir)).where("direction = 'a_to_b'").withColumn("year", F.substring("period", 1, 4).cast("int"))
    codes = concordance.code_universe(fixture.trade(spark, sf_dir)).withColumnRenamed("code", "from_code")
    return weights.complete(codes, step, ["year"]).select("year", "from_code", "to_code", *r6("weight"))


@query(f"""SELECT u.year, u.code AS from_code FROM univ u LEFT JOIN ({_STEP}) w ON w.year=u.year AND w.from_code=u.code WHERE w.from_code IS NULL""")
def missing_codes(spark, sf_dir):
    step = uniform_steps(fixture.edges(spark, sf_dir)).where("direction = 'a_to_b'").withColumn("year", F.substring("period", 1, 4).cast("int"))
    codes = concordance.code_universe(fixture.trade(spark, sf_dir)).withColumnRenamed("code", "from_code")
    return weights.missing_codes(codes, step, ["year"])


# ------------------------------------------------------------- chaining
@query("SELECT origin_year, from_code, to_code, round(weight,6) AS weight FROM chain")
def chained_weights(spark, sf_dir):
    c = uniform_chains(spark, sf_dir).weights
    return c.select("origin_year", "from_code", "to_code", *r6("weight"))


def _diagnostics_sql() -> str:
    out = []
    for y in YEARS:
        if y != BASE:
            sign = 1 if y < BASE else -1
            before = f"s{y}" if y + sign == BASE else f"c{y + sign}"
            out.append(
                f"SELECT {y} AS origin_year, '{step_of(y, sign)[1]}' AS direction, '{step_of(y, sign)[0]}' AS period, {abs(y - BASE) - 1} AS step_index, "
                f"(SELECT count(*) FROM {before}) AS n_rows_in, (SELECT count(DISTINCT from_code) FROM {before}) AS n_from_in, (SELECT count(*) FROM s{y}) AS n_rows_step, "
                f"(SELECT count(*) FROM c{y}) AS n_rows_out, (SELECT count(DISTINCT from_code) FROM c{y}) AS n_from_out, "
                f"(SELECT round(max(abs(s-1)),6) FROM (SELECT sum(weight) AS s FROM c{y} GROUP BY from_code)) AS deviation"
            )
    return " UNION ALL ".join(out)


@query(_diagnostics_sql())
def chain_diagnostics(spark, sf_dir):
    out = uniform_chains(spark, sf_dir).diagnostics
    return out.select("origin_year", "direction", "period", "step_index", "n_rows_in", "n_from_in", "n_rows_step", "n_rows_out", "n_from_out", *r6("deviation"))


def _unresolved_sql() -> str:
    """Links of a third of the codes are left out: of those codes the revised
    ones have no step, and are not carried either."""
    kept, out = "CAST(from_code AS BIGINT)%3<>0", []
    for sign, walk in ((1, range(BASE - 1, YEARS[0] - 1, -1)), (-1, range(BASE + 1, YEARS[-1] + 1))):
        later = None
        for y in walk:
            p, d = step_of(y, sign)
            rev = f"(SELECT code FROM rev WHERE period='{p}' AND direction='{d}')"
            step = f"(SELECT from_code, to_code FROM uni WHERE period='{p}' AND direction='{d}' AND {kept})"
            PARTS[f"ks{y}"] = f"SELECT from_code, to_code FROM {step} UNION ALL SELECT code, code FROM univ WHERE year={y} AND code NOT IN (SELECT from_code FROM {step}) AND code NOT IN {rev}"
            out.append(f"SELECT {y} AS origin_year, code, 'step_missing_revised' AS reason FROM univ WHERE year={y} AND code NOT IN (SELECT from_code FROM {step}) AND code IN {rev}")
            if later is None:
                PARTS[f"kf{y}"] = f"SELECT DISTINCT from_code FROM ks{y}"
            else:
                after = "(SELECT code FROM rev WHERE period='{}' AND direction='{}')".format(*step_of(later, sign))
                gone = f"(to_code NOT IN (SELECT from_code FROM kf{later}) AND to_code IN {after})"
                PARTS[f"kf{y}"] = f"SELECT DISTINCT from_code FROM ks{y} WHERE NOT {gone}"
                out.append(f"SELECT DISTINCT {y}, to_code, 'missing_mid_revised' FROM ks{y} WHERE {gone}")
            later = y
    return " UNION ALL ".join(out)


@query(_unresolved_sql())
def unresolved_codes(spark, sf_dir):
    """Revised codes whose step lacks weights, where a third of the codes has none."""
    edges = fixture.edges(spark, sf_dir)
    steps = checkpointed(uniform_steps(edges).where("cast(from_code as bigint) % 3 <> 0"))
    universe = universe_of(spark, sf_dir)
    revised = checkpointed(concordance.revised_codes(concordance.build_groups(edges)))
    out = chain.chain_range(steps, universe, YEARS[0], YEARS[-1], BASE, ["VALUE_EUR"], revised, final=False)
    return out.unresolved.select("origin_year", "code", "reason")


@query(f"""SELECT from_code, to_code, round(weight,6) AS weight FROM (
 SELECT l.from_code, coalesce(r.to_code, l.to_code) AS to_code, sum(l.weight*coalesce(r.weight,1.0)) AS weight FROM (
  SELECT l.from_code, coalesce(r.to_code, l.to_code) AS to_code, sum(l.weight*coalesce(r.weight,1.0)) AS weight FROM s1995 l LEFT JOIN s1996 r ON l.to_code=r.from_code GROUP BY 1,2) l
 LEFT JOIN s1997 r ON l.to_code=r.from_code GROUP BY 1,2)""")
def chain_single_origin(spark, sf_dir):
    edges = fixture.edges(spark, sf_dir)
    steps = checkpointed(uniform_steps(edges))
    universe = universe_of(spark, sf_dir)
    return chain.chain_origin(steps, universe, 1995, BASE, ["VALUE_EUR"]).weights.select("from_code", "to_code", *r6("weight"))


# ------------------------------------------------------------ re-coding
_ID = "REPORTER, PARTNER, TRADE_TYPE, FLOW, PERIOD"
_TAGS = {"VALUE_EUR": "chain", "QUANTITY_KG": "chainq"}
_WIDE = {f"{m}_w_{n}": (m, t) for t, n in (("VALUE_EUR", "value"), ("QUANTITY_KG", "quantity")) for m in BOTH}


def _recoded(table: str, year: str, outputs: dict[str, tuple[str, str]]) -> str:
    """Outputs (measure, tag of its weights) by ids and new code, not rounded."""
    rows = [
        f"SELECT t.*, coalesce(c.to_code, t.PRODUCT_NC) AS code, "
        + ", ".join(f"{f't.{m}*coalesce(c.weight,1.0)' if tag == own else '0.0'} AS o_{name}" for name, (m, own) in outputs.items())
        + f" FROM {table} t LEFT JOIN {chain_} c ON c.origin_year={year} AND c.from_code=t.PRODUCT_NC"
        for tag, chain_ in _TAGS.items() if tag in {own for _, own in outputs.values()}
    ]
    return f"SELECT {_ID}, code AS PRODUCT_NC, " + ", ".join(f"sum(o_{n}) AS {n}" for n in outputs) + f" FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL"


def _recode_sql(table: str, year: str, outputs: dict[str, tuple[str, str]]) -> str:
    return f"SELECT {_ID}, PRODUCT_NC, " + ", ".join(f"round({n}+1e-6,2) AS {n}" for n in outputs) + f" FROM ({_recoded(table, year, outputs)})"


def _applied(spark, sf_dir, monthly=False):
    trade = apply.with_year(fixture.trade_monthly(spark, sf_dir) if monthly else fixture.stored_trade(spark, sf_dir))
    return trade, uniform_chains(spark, sf_dir, BOTH).weights


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 1e-6, 2).alias(c) if c.startswith(("VALUE_EUR", "QUANTITY_KG")) else F.col(c) for c in df.columns]).drop("origin_year")


def _strategy_query(strategy: str) -> None:
    @query(_recode_sql("trade", "t.PERIOD", {m: (m, weights.STRATEGIES[strategy][m]) for m in BOTH}), name=f"apply_annual_{strategy.removeprefix('weights_')}")
    def run(spark, sf_dir):
        trade, w = _applied(spark, sf_dir)
        return _rounded(apply.apply_strategy(trade, w, strategy))


for _s in weights.STRATEGIES:
    _strategy_query(_s)


@query(_recode_sql("trade", "t.PERIOD", _WIDE))
def apply_wide(spark, sf_dir):
    trade, w = _applied(spark, sf_dir)
    return _rounded(apply.apply_wide(trade, w))


@query(_recode_sql("trade_monthly", "CAST(floor(t.PERIOD/100) AS INT)", _WIDE))
def apply_monthly(spark, sf_dir):
    trade, w = _applied(spark, sf_dir, monthly=True)
    return _rounded(apply.apply_wide(trade, w))


@query(_recode_sql("trade", "t.PERIOD", {"QUANTITY_KG": ("QUANTITY_KG", "QUANTITY_KG")}))
def recode_one_measure(spark, sf_dir):
    trade, w = _applied(spark, sf_dir)
    return _rounded(apply.recode(trade, w.where("measure = 'QUANTITY_KG'"), "QUANTITY_KG", ["origin_year"]))


@query(f"""SELECT REPORTER, PARTNER, TRADE_TYPE, PRODUCT_NC, FLOW, PERIOD, round(VALUE_EUR+1e-6,2) AS VALUE_EUR_w_value, round(QUANTITY_KG+1e-6,2) AS QUANTITY_KG_w_value,
round(VALUE_EUR+1e-6,2) AS VALUE_EUR_w_quantity, round(QUANTITY_KG+1e-6,2) AS QUANTITY_KG_w_quantity FROM trade WHERE PERIOD={BASE}""")
def apply_target_year(spark, sf_dir):
    return _rounded(apply.identity_wide(fixture.trade(spark, sf_dir).where(F.col("PERIOD") == BASE)))


@query(f"""SELECT i.PERIOD, n_rows_in, n_codes_in, round(v_in+1e-3,1) AS value_in, n_rows_out, n_codes_out, round(v_out+1e-3,1) AS value_out, coalesce(n_codes_missing,0) AS n_codes_missing
FROM (SELECT PERIOD, count(*) AS n_rows_in, count(DISTINCT PRODUCT_NC) AS n_codes_in, sum(VALUE_EUR) AS v_in FROM trade GROUP BY 1) i
JOIN (SELECT PERIOD, count(*) AS n_rows_out, count(DISTINCT PRODUCT_NC) AS n_codes_out, sum(VALUE_EUR_w_quantity) AS v_out FROM ({_recoded("trade", "t.PERIOD", _WIDE)}) GROUP BY 1) o ON o.PERIOD=i.PERIOD
LEFT JOIN (SELECT year, count(*) AS n_codes_missing FROM univ WHERE (CAST(code AS BIGINT)%5=0) GROUP BY 1) m ON m.year=i.PERIOD""")
def apply_summary(spark, sf_dir):
    """Weights of a fifth of the codes are left out of the summary's table, so that some are missing."""
    trade, w = _applied(spark, sf_dir)
    out = apply.apply_summary(trade, apply.apply_wide(trade, w), w.where("cast(from_code as bigint) % 5 <> 0"))
    return out.select("PERIOD", "n_rows_in", "n_codes_in", F.round(F.col("VALUE_EUR_in") + 1e-3, 1).alias("value_in"), "n_rows_out", "n_codes_out", F.round(F.col("VALUE_EUR_w_quantity_out") + 1e-3, 1).alias("value_out"), "n_codes_missing")


_CONSERVED = """SELECT PERIOD, o.output, round(CASE WHEN o.output LIKE 'VALUE%' THEN sum(VALUE_EUR) ELSE sum(QUANTITY_KG) END+1e-3,1) AS total_in, round(CASE WHEN o.output LIKE 'VALUE%' THEN sum(VALUE_EUR) ELSE sum(QUANTITY_KG) END+1e-3,1) AS total_out
FROM trade CROSS JOIN (SELECT unnest(['VALUE_EUR_w_value','QUANTITY_KG_w_value','VALUE_EUR_w_quantity','QUANTITY_KG_w_quantity']) AS output) o GROUP BY 1,2"""


def _conserved(rows: DataFrame) -> DataFrame:
    return rows.select("PERIOD", "output", F.round(F.col("total_in") + 1e-3, 1).alias("total_in"), F.round(F.col("total_out") + 1e-3, 1).alias("total_out"))


@query(_CONSERVED)
def conservation(spark, sf_dir):
    trade, w = _applied(spark, sf_dir)
    return _conserved(apply.conservation(trade, apply.apply_wide(trade, w)))


@query(_CONSERVED)
def harmonise_conservation(spark, sf_dir):
    """The whole composition with fitted weights: what goes in comes out."""
    trade = fixture.stored_trade(spark, sf_dir)
    return _conserved(harmonise.harmonise(trade, fixture.edges(spark, sf_dir), BASE, YEARS[0], YEARS[-1])["conservation"])


@query(_recode_sql("trade", "t.PERIOD", _WIDE))
def harmonise_given_steps(spark, sf_dir):
    """The whole composition from stored step weights."""
    trade, edges = fixture.stored_trade(spark, sf_dir), fixture.edges(spark, sf_dir)
    steps = checkpointed(uniform_steps(edges).unionByName(uniform_steps(edges, "QUANTITY_KG")))
    return _rounded(harmonise.harmonise(trade, edges, BASE, YEARS[0], YEARS[-1], steps=steps)["recoded"])


@query(f"""SELECT o.yr AS origin_year, m.measure FROM (SELECT DISTINCT yr FROM yrs) o CROSS JOIN (SELECT 'VALUE_EUR' AS measure UNION ALL SELECT 'QUANTITY_KG') m WHERE NOT (o.yr%2=1 AND m.measure='VALUE_EUR')""")
def missing_weights(spark, sf_dir):
    """Requested origins and measures that value chains of odd years lack."""
    w = uniform_chains(spark, sf_dir).weights.where("origin_year % 2 = 1")
    return harmonise.missing_weights(w, list(YEARS), BOTH)


@query("SELECT year, code, round(value+1e-6,2) AS value FROM btot")
def recoded_totals(spark, sf_dir):
    t = product_totals_of(spark, sf_dir)
    w = uniform_chains(spark, sf_dir).weights.withColumn("year", F.col("origin_year"))
    return apply.recode_totals(t, w, ["year"]).select("year", "code", F.round(F.col("value") + 1e-6, 2).alias("value"))


def product_totals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixture.trade(spark, sf_dir).where("FLOW = '1'")
    return t.groupBy(F.col("PERIOD").alias("year"), F.col("PRODUCT_NC").alias("code")).agg(F.sum("VALUE_EUR").alias("value"))


@query("SELECT year, code, round(value,2) AS value FROM ptot")
def product_totals(spark, sf_dir):
    return product_totals_of(spark, sf_dir).select("year", "code", F.round("value", 2).alias("value"))


@query("""SELECT code AS PRODUCT_NC, round(sum(v)+1e-6,2) AS value_eur, count(*) AS n_rows FROM (
 SELECT REPORTER, PARTNER, TRADE_TYPE, FLOW, PERIOD, coalesce(w.to_code, t.PRODUCT_NC) AS code, sum(t.VALUE_EUR*coalesce(w.weight,1.0)) AS v FROM trade t LEFT JOIN (
  SELECT from_code, to_code, weight/sum(weight) OVER (PARTITION BY from_code) AS weight FROM (
   SELECT from_code, to_code, CASE WHEN weight<1e-10 THEN 0 ELSE weight END AS weight FROM fitf WHERE period='19951996' AND direction='a_to_b' AND measure='VALUE_EUR'
   UNION ALL SELECT from_code, to_code, 1.0 FROM flt WHERE period='19951996' AND direction='a_to_b' AND n_to=1 AND from_code NOT IN (SELECT from_code FROM fitf WHERE period='19951996' AND direction='a_to_b' AND measure='VALUE_EUR'))) w
  ON w.from_code=t.PRODUCT_NC AND w.weight>0 WHERE t.PERIOD=1995 GROUP BY ALL) GROUP BY 1""")
def recode_1995_to_1996(spark, sf_dir):
    """The flagship: 1995 trade in the 1996 vintage, value by code, with fitted weights."""
    trade = checkpointed(fixture.trade(spark, sf_dir).where("PERIOD in (1995, 1996)"))
    groups = concordance.build_groups(checkpointed(fixture.edges(spark, sf_dir).where("period = '19951996'")))
    steps = estimation.estimate(trade, groups, ("VALUE_EUR",))["weights"].where("direction = 'a_to_b'")
    w = steps.select(F.lit(1995).alias("origin_year"), "measure", "from_code", "to_code", "weight")
    rows = apply.with_year(trade.where("PERIOD = 1995"))
    out = apply.apply_strategy(rows, w, "weights_value")
    return out.groupBy("PRODUCT_NC").agg(F.round(F.sum("VALUE_EUR") + 1e-6, 2).alias("value_eur"), F.count(F.lit(1)).alias("n_rows"))
