"""Registered queries: stored tables, stream sink, gates, basis choice, relations between all years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.functions import codes as C
from vintage.functions import metrics as M
from vintage.operators import apply, chain, chain_store, concordance, estimation, figures, panels, persistence, structure, weights
from vintage.plans.analysis import BREAK, FIRST, LAST, _base, _persistence_parts, _relations, _series, _strict_carry  # shared inputs
from vintage.plans.core import BOTH, _WIDE, _NOISY, _applied, _recode_sql, _rounded, groups_of, query, r6, uniform_chains, uniform_steps, universe_of
from vintage.plans.sql import BASE, PARTS, YEARS, chain_parts, step_of
from vintage.sources import fixture, trade
from vintage.sources.storage import checkpointed, shared_path
from vintage.streaming import monthly

# ------------------------------------------------------------ stored chains
_CHANGED = step_of(1996, 1)
PARTS |= {"uniz": f"SELECT * FROM uni WHERE NOT (period='{_CHANGED[0]}' AND direction='{_CHANGED[1]}') UNION ALL SELECT * FROM uniq WHERE period='{_CHANGED[0]}' AND direction='{_CHANGED[1]}'"}
PARTS |= chain_parts(BASE, "z", "uniz")


@query(f"SELECT origin_year, origin_year<=1996 AS built, from_code, to_code, round(weight,6) AS weight FROM chainz")
def refreshed_chains(spark, sf_dir):
    """A store of chains, after the weights of one step have changed: all chains
    as they now should be, and which of them were built again. S10, Z2"""
    edges, path = fixture.edges(spark, sf_dir), shared_path(spark)
    steps, universe = checkpointed(uniform_steps(edges)), universe_of(spark, sf_dir)
    chain_store.refresh(path, steps, universe, FIRST, LAST, BASE, ["VALUE_EUR"])
    at = (F.col("period") == _CHANGED[0]) & (F.col("direction") == _CHANGED[1])
    other = uniform_steps(edges, "QUANTITY_KG").where(at).withColumn("measure", F.lit("VALUE_EUR"))
    chains, built, _ = chain_store.refresh(path, checkpointed(steps.where(~at).unionByName(other)), universe, FIRST, LAST, BASE, ["VALUE_EUR"])
    return chains.select("origin_year", F.col("origin_year").isin(built).alias("built"), "from_code", "to_code", *r6("weight"))


# ------------------------------------------------------------ stored layout
@query(_recode_sql("trade", "t.PERIOD", _WIDE))
def apply_stored(spark, sf_dir):
    """Re-coding of facts and weights that are stored in equal buckets."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the facts are written once, in buckets, and the code lists read from there
    facts = apply.store_facts(apply.with_year(fixture.trade(spark, sf_dir)), buckets)
    fixture.held(spark, sf_dir, "universe", lambda: checkpointed(concordance.code_universe(facts)))
    pivoted = apply.store_weights(uniform_chains(spark, sf_dir, BOTH).weights, buckets)
    return _rounded(apply.recode_stored(facts, pivoted))


# ------------------------------------------------------------ ranks at scale
PARTS["lnk"] = "SELECT v.origin_year, v.from_code, v.to_code, v.weight AS v, q.weight AS q FROM chain v JOIN chainq q USING (origin_year, from_code, to_code)"


def _both_weights(spark, sf_dir) -> DataFrame:
    w = checkpointed(uniform_chains(spark, sf_dir, BOTH).weights)
    w = w.groupBy("origin_year", "from_code", "to_code").pivot("measure", BOTH).agg(F.round(F.sum("weight"), 9))
    return w.select(F.lit("all").alias("links"), "origin_year", F.col("VALUE_EUR").alias("v"), F.col("QUANTITY_KG").alias("q"))


@query("""SELECT round(corr(rx, ry),6) AS spearman FROM (SELECT rank() OVER (ORDER BY v)+(count(*) OVER (PARTITION BY v)-1)/2.0 AS rx, rank() OVER (ORDER BY q)+(count(*) OVER (PARTITION BY q)-1)/2.0 AS ry FROM (SELECT round(v,9) AS v, round(q,9) AS q FROM lnk))""")
def weight_rank_correlation(spark, sf_dir):
    """Rank correlation of value and quantity weights over all chained links. M11"""
    return M.spearman(_both_weights(spark, sf_dir), "v", "q", ("links",)).select(*r6("spearman"))


@query("SELECT origin_year, " + ", ".join(f"round(quantile_cont(v,{p / 100}),6) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM lnk GROUP BY 1")
def weight_quantiles(spark, sf_dir):
    """Quantiles of the chained weights of each origin. M12"""
    return M.quantiles(_both_weights(spark, sf_dir), "v", ("origin_year",), (5, 25, 50, 75, 95)).select("origin_year", *r6("p5", "p25", "p50", "p75", "p95"))


# ------------------------------------------------------------------- months
def _sink(spark, sf_dir) -> str:
    """A sink fed by three files: two with the halves of all months, one that
    corrects the months of 1997; the second batch comes twice, as after a failure."""
    months = checkpointed(fixture.trade_monthly(spark, sf_dir).withColumn(monthly.REVISION, F.lit(0)))
    source, path = shared_path(spark), shared_path(spark)
    half = F.col("REPORTER") < "C13"
    fixed = months.where("PERIOD div 100 = 1997 and FLOW = '1'").withColumns({"VALUE_EUR": F.col("VALUE_EUR") * 2, monthly.REVISION: F.lit(1)})
    w = checkpointed(uniform_chains(spark, sf_dir, BOTH).weights)
    for k, rows in enumerate((months.where(half), months.where(~half), fixed)):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(months.schema).parquet(source)
        monthly.sink_months(stream, w, path, f"{path}/log").awaitTermination()
        if k == 1:
            monthly.write_batch(months.where(~half), 1, w, path)
    return path


_MONTHS = "SELECT * FROM trade_monthly WHERE NOT (CAST(floor(PERIOD/100) AS INT)=1997) UNION ALL SELECT * REPLACE (VALUE_EUR*2 AS VALUE_EUR) FROM trade_monthly WHERE CAST(floor(PERIOD/100) AS INT)=1997 AND FLOW='1'"
PARTS["months_now"] = _MONTHS


@query(_recode_sql("months_now", "CAST(floor(t.PERIOD/100) AS INT)", _WIDE))
def monthly_sink(spark, sf_dir):
    """Monthly files summed by a stream, each batch once and the last revision of each month. A7"""
    return _rounded(monthly.read_months(spark, _sink(spark, sf_dir)))


@query("SELECT PERIOD, CASE WHEN CAST(floor(PERIOD/100) AS INT)=1997 THEN 1 ELSE 0 END AS REVISION, count(*) AS n_rows_in, round(sum(VALUE_EUR)+1e-3,1) AS value_in FROM months_now GROUP BY 1")
def finished_months(spark, sf_dir):
    """What the sink has of each month: the summaries of all batches, merged. A9"""
    out = monthly.finished_months(spark, _sink(spark, sf_dir))
    return out.select("PERIOD", "REVISION", "n_rows_in", F.round(F.col("value_in") + 1e-3, 1).alias("value_in"))


@query("SELECT DISTINCT PERIOD, 1 AS REVISION FROM trade_monthly WHERE CAST(floor(PERIOD/100) AS INT)<>1997")
def pending_months(spark, sf_dir):
    """A second revision planned of all months: those that the sink lacks. S10"""
    planned = fixture.trade_monthly(spark, sf_dir).select("PERIOD").distinct().withColumn("REVISION", F.lit(1))
    return monthly.pending_months(planned, spark, _sink(spark, sf_dir))


# ---------------------------------------------------- relations of all years
for _a in YEARS:
    if _a < LAST:
        PARTS |= _relations(_a, LAST, f"f{_a}_")
    if _a > FIRST:
        PARTS |= _relations(_a, FIRST, f"g{_a}_")
PARTS["relall"] = " UNION ALL ".join([f"SELECT {a} AS anchor, * FROM relsf{a}_" for a in YEARS if a < LAST] + [f"SELECT {a} AS anchor, * FROM relsg{a}_" for a in YEARS if a > FIRST])
PARTS |= {
    "ra_l": "SELECT anchor, compare_year, 'A'||from_code AS u, 'B'||to_code AS v FROM relall UNION SELECT anchor, compare_year, 'B'||to_code, 'A'||from_code FROM relall",
    "ra_r(anchor, compare_year, node, root)": "SELECT anchor, compare_year, u, u FROM ra_l UNION SELECT r.anchor, r.compare_year, l.v, r.root FROM ra_r r JOIN ra_l l ON l.anchor=r.anchor AND l.compare_year=r.compare_year AND l.u=r.node",
    "ra_c": "SELECT anchor, compare_year, node, min(root) AS comp FROM ra_r GROUP BY 1,2,3",
    "ra_s": "SELECT anchor, compare_year, comp, count(CASE WHEN node LIKE 'A%' THEN 1 END) AS nf, count(CASE WHEN node LIKE 'B%' THEN 1 END) AS no FROM ra_c GROUP BY 1,2,3",
    "ra_n": """SELECT anchor, compare_year, CASE WHEN nf=1 AND no=1 THEN '1:1' WHEN nf=1 THEN '1:n' WHEN no=1 THEN 'm:1' ELSE 'm:n' END AS class, CAST(sum(nf) AS BIGINT) AS n FROM ra_s GROUP BY 1,2,3""",
}


@query("""SELECT y.anchor, y.compare_year, c.class, coalesce(n,0) AS n, round(coalesce(n,0)/sum(coalesce(n,0)) OVER (PARTITION BY y.anchor, y.compare_year),6) AS share FROM (SELECT DISTINCT anchor, compare_year FROM relall) y
CROSS JOIN (SELECT unnest(['1:1','m:1','1:n','m:n']) AS class) c LEFT JOIN ra_n r ON r.anchor=y.anchor AND r.compare_year=y.compare_year AND r.class=c.class""")
def all_link_distributions(spark, sf_dir):
    """Classes of every anchor's codes in every other year, both ways in time. D8"""
    edges, universe = fixture.edges(spark, sf_dir), universe_of(spark, sf_dir)
    return structure.all_link_distributions(edges, universe, FIRST, LAST).select("anchor", "compare_year", "class", "n", *r6("share"))


# ------------------------------------------------------------- basis choice
BREAK_A = BASE - 1
for _y in range(FIRST, BASE + 1):
    if _y != BREAK_A:
        PARTS |= _strict_carry(f"h{_y}_", _y, BREAK_A, f"SELECT code AS orig, code FROM univ WHERE year={_y}")
PARTS |= {
    "bila": " UNION ALL ".join(
        [f"SELECT year, REPORTER, PARTNER, code, value FROM bil WHERE year={BREAK_A}"]
        + [f"SELECT b.year, REPORTER, PARTNER, k.code, sum(value) AS value FROM bil b JOIN h{y}_{BREAK_A} k ON k.orig=b.code WHERE b.year={y} GROUP BY 1,2,3,4" for y in range(FIRST, BASE + 1) if y != BREAK_A]
    ),
    "bilb": f"SELECT * FROM bilc WHERE year>={BREAK_A}",
    "smpa": f"SELECT DISTINCT s.vintage_a_code AS code, s.group_id FROM ge s JOIN summ m USING (period, group_id) WHERE s.period='{BREAK}' AND m.a_to_b_ambiguous",
    "smpad": f"SELECT u.code, coalesce(s.group_id, 'singleton::{BREAK_A}::'||u.code) AS group_id FROM univ u LEFT JOIN smpa s ON s.code=u.code WHERE u.year={BREAK_A}",
    "smpac": "SELECT * FROM smpa WHERE group_id NOT IN (SELECT group_id FROM cont)",
}
for _tag, _rows, _map in (("pa", "bila", "smpa"), ("pb", "bilb", "smp"), ("pac", "bila", "smpac"), ("pbc", "bilb", "smpc"), ("pad", "bila", "smpad"), ("pbd", "bilb", "smpd")):
    PARTS |= {k: v.replace("FROM bilc b", f"FROM {_rows} b") for k, v in _persistence_parts(_tag, _map).items()}


@query(" UNION ALL ".join(f"SELECT '{name}' AS \"row\", '{side}' AS side, year, year={BASE} AS across, round(coef,5) AS coef, round(se,5) AS se, n, round(r2_45,5) AS r2_45 FROM regp{side}{tag}" for name, tag in (("adjusted", ""), ("clean", "c"), ("deterministic", "d")) for side in ("a", "b")))
def basis_persistence(spark, sf_dir):
    """Persistence of every pair of years in the vintage of its own side of the
    break, the pair across it in both, for the three row sets. B11, B12"""
    lines, edges = fixture.stored_lines(spark, sf_dir), fixture.edges(spark, sf_dir)
    g = concordance.build_groups(edges.where(F.col("period") == BREAK))  # those of other steps are not used
    maps = checkpointed(persistence.side_maps(g.edges, g.summary.where("a_to_b_ambiguous").select("group_id"), BREAK))
    links = checkpointed(persistence.carry_links(edges))
    many = concordance.nonbijective_codes(edges.where(f"period = '{LAST - 1}{LAST}'")).where("side = 'a' and cast(code as bigint) % 32 < 16").select("code")
    hit = persistence.contaminated_groups(maps.where("side = 'b'").drop("side"), {LAST - 1: many}, edges, BASE, links).select("group_id").distinct()
    by_code, whole = fixture.trade_by_code(spark, sf_dir), None
    for side, year in (("a", BREAK_A), ("b", BASE)):
        part = persistence.deterministic_basis(concordance.code_universe(by_code), maps.where(F.col("side") == side), year).withColumn("side", F.lit(side))
        whole = part if whole is None else whole.unionByName(part)
    sets = None
    for name, rows in (("adjusted", maps), ("clean", maps.join(hit, "group_id", "left_anti")), ("deterministic", whole)):
        rows = rows.select(F.lit(name).alias("row"), "side", "code", "group_id")
        sets = rows if sets is None else sets.unionByName(rows)
    codes = checkpointed(persistence.fact_codes(by_code))
    carried = persistence.side_codes(codes, edges, BREAK_A, FIRST, LAST, links)
    codes = codes.join(carried, ["code", "year"]).drop("code").withColumnRenamed("basis_code", "code")
    out = persistence.panel_fits(persistence.bilateral_rows(lines), codes, checkpointed(sets), list(range(FIRST, LAST + 1)), ("row", "side"))
    out = out.withColumn("across", F.col("year") == BASE)
    return out.select("row", "side", "year", "across", *[F.round(c, 5).alias(c) for c in ("coef", "se")], "n", F.round("r2_45", 5).alias("r2_45"))


for _y in range(FIRST, LAST):
    if _y + 1 <= BREAK_A:
        PARTS |= _strict_carry(f"w{_y}_", _y + 1, BREAK_A, f"SELECT DISTINCT vintage_b_code AS orig, vintage_b_code AS code FROM degs WHERE period='{_y}{_y + 1}' AND (deg_a>1 OR deg_b>1)")
    elif _y >= BASE:
        PARTS |= _strict_carry(f"w{_y}_", _y, BASE, f"SELECT DISTINCT vintage_a_code AS orig, vintage_a_code AS code FROM degs WHERE period='{_y}{_y + 1}' AND (deg_a>1 OR deg_b>1)")


def _reached(y: int) -> str:
    """Codes at the break that the non-bijective links of year y reach."""
    source, at, side = (y + 1, BREAK_A, "b") if y + 1 <= BREAK_A else (y, BASE, "a")
    if source == at:
        return f"SELECT DISTINCT vintage_{side}_code AS code FROM degs WHERE period='{y}{y + 1}' AND (deg_a>1 OR deg_b>1)"
    return f"SELECT code FROM w{y}_{at}"


@query(" UNION ALL ".join(f"SELECT DISTINCT {y} AS year, '{'a' if y < BASE else 'b'}' AS side, group_id, code FROM {'smpa' if y < BASE else 'smp'} WHERE code IN ({_reached(y)})" for y in range(FIRST, LAST) if y != BREAK_A))
def contamination(spark, sf_dir):
    """Codes of the ambiguous groups at the break that other revisions reach, by year. B8"""
    edges, g = fixture.edges(spark, sf_dir), groups_of(spark, sf_dir)
    amb = g.summary.where((F.col("period") == BREAK) & F.col("a_to_b_ambiguous")).select("group_id")
    return persistence.contamination(checkpointed(persistence.side_maps(g.edges, amb, BREAK)), edges, BREAK_A, list(range(FIRST, LAST)))


# -------------------------------------------------------------------- gates
@query("""SELECT period, vintage_a_code, vintage_b_code FROM edges WHERE CAST(vintage_a_code AS BIGINT)%7=0""")
def nonadjacent_links(spark, sf_dir):
    """Links whose years do not follow each other: here those of a seventh of the codes, moved on a year. G21"""
    moved = F.when(F.col("vintage_a_code").cast("long") % 7 == 0, (F.col("vintage_b_year").cast("int") + 1).cast("string")).otherwise(F.col("vintage_b_year"))
    return concordance.nonadjacent(fixture.edges(spark, sf_dir).withColumn("vintage_b_year", moved)).select("period", "vintage_a_code", "vintage_b_code")


def _noisy(spark, sf_dir) -> DataFrame:
    u = uniform_steps(fixture.edges(spark, sf_dir))
    last = F.max("to_code").over(W.partitionBy("period", "direction", "from_code"))
    return u.withColumn("weight", F.when(F.col("to_code") == last, F.col("weight") * 0.998).otherwise(F.col("weight") * 0.5))


@query(f"SELECT period, direction, from_code, 'row sum' AS reason FROM ({_NOISY}) GROUP BY 1,2,3 HAVING abs(sum(weight)-1)>0.1")
def invalid_weights(spark, sf_dir):
    """What a finished table may not hold: here codes whose weights do not sum to one. W2"""
    return weights.invalid(_noisy(spark, sf_dir), ["period", "direction"], 0.1)


@query(f"SELECT round(min(weight),6) AS least, round(max(weight),6) AS greatest, min(weight)>=-1e-9 AND max(weight)<=1+1e-9 AS ok FROM ({_NOISY})")
def weight_bounds(spark, sf_dir):
    """W3"""
    return weights.within_bounds(_noisy(spark, sf_dir)).select(*r6("least", "greatest"), "ok")


@query("SELECT DISTINCT year AS origin_year, code AS from_code FROM univ WHERE CAST(code AS BIGINT)%5=0")
def uncovered_codes(spark, sf_dir):
    """Origin codes without a chain, where those of a fifth of the codes were lost. C8"""
    edges = fixture.edges(spark, sf_dir)
    universe = universe_of(spark, sf_dir)
    w = uniform_chains(spark, sf_dir).weights.where("cast(from_code as bigint) % 5 <> 0")
    return chain.uncovered(chain.Chained(w, None, None), universe).select("origin_year", "from_code")


@query(f"""SELECT DISTINCT u.year AS origin_year, u.code AS from_code FROM univ u JOIN rev r ON r.code=u.code AND CAST(CASE WHEN r.direction='a_to_b' THEN substr(r.period,1,4) ELSE substr(r.period,5,4) END AS INT)=u.year
WHERE CAST(u.code AS BIGINT)%3=0""")
def unaccepted_codes(spark, sf_dir):
    """Revised origin codes that the chains lack, where those of a third of the codes were lost. A10"""
    universe = universe_of(spark, sf_dir)
    revised = concordance.revised_codes(groups_of(spark, sf_dir))
    return apply.unaccepted(uniform_chains(spark, sf_dir).weights.where("cast(from_code as bigint) % 3 <> 0"), revised, universe)


@query("SELECT code, max(year) AS year, round(arg_max(value, year)+1e-6,2) AS value FROM ptot GROUP BY 1")
def last_totals(spark, sf_dir):
    """Summaries of all years merged, the last of each code kept. A9"""
    t = panels.product_totals(fixture.trade(spark, sf_dir), flow="1")
    return apply.keep_last(t, ["code"], "year").select("code", "year", F.round(F.col("value") + 1e-6, 2).alias("value"))


@query("SELECT period, direction, measure, group_id FROM tots WHERE skip_reason IS NULL AND n_rows_a%3=0")
def unsolved_fits(spark, sf_dir):
    """Fits to refuse, over stated outcomes: those of groups whose rows divide by three. E9"""
    shares = checkpointed(estimation.side_shares(fixture.trade(spark, sf_dir), g := groups_of(spark, sf_dir), measures=BOTH))
    ok = estimation.group_totals(shares, g, BOTH).where("skip_reason is null")
    status = F.when(F.col("n_rows_a") % 3 == 0, "max_iter").otherwise("solved")
    return estimation.unsolved(ok.select(*estimation.KEY, status.alias("status"))).drop("status")


@query("""SELECT x_year, 'mae' AS metric, round(avg(abs(share_t1-share_t)),6) AS value FROM pairs GROUP BY 1 UNION ALL
SELECT x_year, 'r2_45', round(1-sum((share_t1-share_t)*(share_t1-share_t))/(var_pop(share_t1)*count(*)),6) FROM pairs GROUP BY 1 UNION ALL
SELECT x_year, 'r2_45_weighted', round(1-sum(w*(share_t1-share_t)*(share_t1-share_t))/(sum(w*share_t1*share_t1)-sum(w*share_t1)*sum(w*share_t1)/sum(w)),6) FROM (SELECT *, value_x AS w FROM pairs WHERE value_x>0) GROUP BY 1""")
def named_metrics(spark, sf_dir):
    """Panel statistics by their names; one with the earlier year's values as weights. M3, M9"""
    pairs = checkpointed(panels.year_pairs(_base(spark, sf_dir)[4]))
    x, y, w = F.col("share_t"), F.col("share_t1"), F.col("value_x")
    args = {"mae": (x, y), "r2_45": (x, y), "r2_45_weighted": (x, y, w)}
    wide = pairs.groupBy("x_year").agg(*[M.metric(name)(*of).alias(name) for name, of in args.items()])
    return wide.unpivot(["x_year"], list(args), "metric", "value").select("x_year", "metric", *r6("value"))


# ------------------------------------------------------------------ figures
@query(f"SELECT concept, code, year, round(share,6) AS share FROM ser UNION ALL SELECT DISTINCT concept, code, {FIRST - 1}, 0.0 FROM ser")
def anchored_series(spark, sf_dir):
    """Candidate series with a zero at the year before the window. V4"""
    return figures.anchored(_series(spark, sf_dir), FIRST - 1, "year", "share", ["concept", "code"]).select("concept", "code", "year", *r6("share"))


PARTS |= {
    "seg0": "SELECT *, CASE WHEN is_synthetic<>lag(is_synthetic) OVER (PARTITION BY concept, code ORDER BY year) THEN 1 ELSE 0 END AS new FROM ser",
    "seg": "SELECT *, sum(new) OVER (PARTITION BY concept, code ORDER BY year) AS segment FROM seg0",
}


@query("SELECT concept, code, year, CAST(segment AS BIGINT) AS segment, false AS bridge FROM seg UNION ALL SELECT concept, code, year, CAST(segment-1 AS BIGINT), true FROM seg WHERE new=1")
def regime_segments(spark, sf_dir):
    """Candidate series cut where they turn synthetic or real, with bridge points. V5"""
    return figures.regime_segments(_series(spark, sf_dir), "is_synthetic", ["concept", "code"]).select("concept", "code", "year", "segment", "bridge")


@query("SELECT concept, code, year, round(sum(share) OVER (PARTITION BY concept, code ORDER BY year)+1e-9,5) AS cumulative FROM ser")
def cumulative_series(spark, sf_dir):
    from vintage.operators.synthetic import cumulative_shares

    return cumulative_shares(_series(spark, sf_dir)).select("concept", "code", "year", F.round(F.col("cumulative") + 1e-9, 5).alias("cumulative"))


# -------------------------------------------------------- codes and sources
PARTS["rawc"] = """SELECT CASE WHEN p_partkey%11=0 THEN '2000' WHEN p_partkey%11=1 THEN ' 19951996.0' ELSE '19951996' END AS period,
    CASE WHEN p_partkey%7=0 THEN '' WHEN p_partkey%7=1 THEN CAST(p_partkey AS STRING)||'x' WHEN p_partkey%7=2 THEN CAST(p_partkey AS STRING)||'.5' WHEN p_partkey%7=3 THEN CAST(p_partkey AS STRING)||'.0' WHEN p_partkey%7=4 THEN '123456789' ELSE ' '||CAST(p_partkey AS STRING) END AS origin,
    CAST(p_partkey+1 AS STRING) AS destination FROM part"""


def _raw(spark, sf_dir) -> DataFrame:
    """Raw correspondence rows, good and bad, from the keys of ``part``."""
    return spark.sql(" ".join(PARTS["rawc"].replace("FROM part", "FROM {part}").split()), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


@query("""SELECT DISTINCT '19951996' AS period, '1995' AS vintage_a_year, '1996' AS vintage_b_year, lpad(replace(trim(origin),'.0',''),8,'0') AS vintage_a_code, lpad(destination,8,'0') AS vintage_b_code FROM rawc
WHERE period<>'2000' AND regexp_matches(trim(origin), '^[0-9]{1,8}(\\.0)?$')""")
def ingested_links(spark, sf_dir):
    """Links of a raw table whose periods and codes can be read. S6, N2, N3"""
    return trade.ingest_concordance(_raw(spark, sf_dir), "period", "origin", "destination")[0]


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN period='2000' THEN 'bad period' WHEN origin='' THEN 'missing' WHEN origin LIKE '%x' THEN 'not digits' WHEN origin LIKE '%.5' THEN 'not an integer' WHEN origin='123456789' THEN 'too long' END AS reason FROM rawc) WHERE reason IS NOT NULL GROUP BY 1""")
def rejected_links(spark, sf_dir):
    """Why rows of a raw table are refused. S6, N3"""
    return trade.ingest_concordance(_raw(spark, sf_dir), "period", "origin", "destination")[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT PERIOD AS year, PERIOD BETWEEN 1000 AND 9999 AS valid, count(DISTINCT REPORTER||'|'||PARTNER) AS n_pairs FROM trade GROUP BY 1")
def year_pairs_seen(spark, sf_dir):
    """Years that can be read, with their distinct reporter and partner keys. N4, N13"""
    t = fixture.trade(spark, sf_dir)
    return t.groupBy(F.col("PERIOD").alias("year")).agg(F.bool_and(C.is_year(F.col("PERIOD"))).alias("valid"), F.countDistinct(C.pair_key("REPORTER", "PARTNER")).alias("n_pairs"))


def _stored_trade(spark, sf_dir) -> str:
    path = shared_path(spark)
    months = fixture.trade_monthly(spark, sf_dir).withColumns({"year": (F.col("PERIOD") / 100).cast("int"), "month": F.col("PERIOD") % 100})
    months.repartition("year", "month").write.partitionBy("year", "month").parquet(path)
    return path


@query("SELECT CAST(floor(PERIOD/100) AS INT) AS year, PRODUCT_NC, round(sum(VALUE_EUR)+1e-6,2) AS value, count(*) AS n FROM trade_monthly WHERE floor(PERIOD/100) IN (1996, 1999) GROUP BY 1,2")
def scanned_years(spark, sf_dir):
    """Two years of a partitioned table, five columns. S1"""
    rows = trade.scan_year(spark, _stored_trade(spark, sf_dir), [1996, 1999])
    return rows.groupBy("year", "PRODUCT_NC").agg(F.round(F.sum("VALUE_EUR") + 1e-6, 2).alias("value"), F.count(F.lit(1)).alias("n"))


@query("SELECT REPORTER, PARTNER, TRADE_TYPE, PRODUCT_NC, FLOW, PERIOD, round(VALUE_EUR+1e-6,2) AS VALUE_EUR FROM trade_monthly WHERE PERIOD=199703")
def scanned_month(spark, sf_dir):
    """S2"""
    rows = trade.scan_month(spark, _stored_trade(spark, sf_dir), 199703)
    return rows.select("REPORTER", "PARTNER", "TRADE_TYPE", "PRODUCT_NC", "FLOW", "PERIOD", F.round(F.col("VALUE_EUR") + 1e-6, 2).alias("VALUE_EUR"))


def _stored_steps(spark, sf_dir) -> str:
    """Steps by kind: uniform weights as ambiguous ones of codes that divide by 3, and 1 as the deterministic ones of all links of a single-link code."""
    path, u = shared_path(spark), checkpointed(uniform_steps(fixture.edges(spark, sf_dir)))
    amb = u.where("cast(from_code as bigint) % 3 = 0").withColumn("kind", F.lit("ambiguous"))
    n = F.count(F.lit(1)).over(W.partitionBy("period", "direction", "from_code"))
    det = u.withColumn("n", n).where("n = 1").drop("n").withColumns({"kind": F.lit("deterministic"), "weight": F.lit(1.0)})
    amb.unionByName(det).write.partitionBy("kind").parquet(path)
    return path


@query("""SELECT period, direction, from_code, to_code, round(weight,6) AS weight FROM uni WHERE CAST(from_code AS BIGINT)%3=0 UNION ALL
SELECT period, direction, from_code, to_code, 1.0 FROM (SELECT *, count(*) OVER (PARTITION BY period, direction, from_code) AS n FROM uni) WHERE n=1 AND CAST(from_code AS BIGINT)%3<>0""")
def stored_steps(spark, sf_dir):
    """Stored steps of both kinds, ambiguous ones winning. S3"""
    return trade.read_steps(spark, _stored_steps(spark, sf_dir)).select("period", "direction", "from_code", "to_code", *r6("weight"))


@query("SELECT period, direction, from_code, to_code, round(weight,6) AS weight FROM uni WHERE CAST(from_code AS BIGINT)%3=0")
def stored_ambiguous_steps(spark, sf_dir):
    """S4"""
    return trade.read_steps(spark, _stored_steps(spark, sf_dir), ambiguous_only=True).select("period", "direction", "from_code", "to_code", *r6("weight"))


@query("SELECT DISTINCT lpad(CAST(p_partkey AS STRING),8,'0') AS code FROM part WHERE p_partkey%2=1")
def allow_list(spark, sf_dir):
    """Codes of a CSV column, some of them empty. S5"""
    path = shared_path(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.select(F.when(F.col("p_partkey") % 2 == 1, F.col("p_partkey").cast("string")).alias("cn"), "p_name").write.option("header", True).csv(path)
    return trade.read_allow_list(spark, path, "cn")


@query("""SELECT t.PERIOD AS origin_year, coalesce(c.to_code, t.PRODUCT_NC) AS PRODUCT_NC, round(sum(t.VALUE_EUR*coalesce(c.weight,1.0))*CASE WHEN t.PERIOD=1996 THEN 2 ELSE 1 END+1e-6,2) AS value FROM trade t LEFT JOIN chain c ON c.origin_year=t.PERIOD AND c.from_code=t.PRODUCT_NC GROUP BY 1, 2""")
def written_recoded(spark, sf_dir):
    """Re-coded trade as stored, after one origin was written again with twice its values. S7"""
    rows, w = _applied(spark, sf_dir)
    out = apply.recode(rows, w.where("measure = 'VALUE_EUR'"), "VALUE_EUR", ["origin_year"]).withColumn("target_year", F.lit(BASE))
    path, out = shared_path(spark), checkpointed(out)
    trade.write_recoded(out, path)
    trade.write_recoded(out.where("origin_year = 1996").withColumn("VALUE_EUR", F.col("VALUE_EUR") * 2), path)
    return spark.read.parquet(path).groupBy("origin_year", "PRODUCT_NC").agg(F.round(F.sum("VALUE_EUR") + 1e-6, 2).alias("value"))


@query("SELECT 'one' AS run, period, direction, measure, skip_reason, count(*) AS n FROM tots GROUP BY ALL UNION ALL SELECT 'two', period, direction, measure, skip_reason, count(*) FROM tots WHERE skip_reason IS NOT NULL GROUP BY ALL")
def diagnostics_log(spark, sf_dir):
    """Diagnostics of two runs in one table. S8"""
    shares = checkpointed(estimation.side_shares(fixture.trade(spark, sf_dir), g := groups_of(spark, sf_dir), measures=BOTH))
    totals = checkpointed(estimation.group_totals(shares, g, BOTH).groupBy("period", "direction", "measure", "skip_reason").agg(F.count(F.lit(1)).alias("n")))
    path = shared_path(spark)
    trade.append_diagnostics(totals, path, "one")
    trade.append_diagnostics(totals.where("skip_reason is not null"), path, "two")
    return spark.read.parquet(path).select(F.col("run").cast("string").alias("run"), "period", "direction", "measure", "skip_reason", "n")


@query("SELECT DISTINCT period FROM edges WHERE CAST(substr(period,1,4) AS INT)<>1997 AND CAST(substr(period,5,4) AS INT)<>1997 AND CAST(substr(period,1,4) AS INT) IN (SELECT PERIOD FROM trade) AND CAST(substr(period,5,4) AS INT) IN (SELECT PERIOD FROM trade)")
def available_periods(spark, sf_dir):
    """Periods whose two years have trade, where that of 1997 is not there. S9"""
    periods = fixture.edges(spark, sf_dir).select("period").distinct()
    years = fixture.trade(spark, sf_dir).select(F.col("PERIOD").alias("year")).distinct()
    return trade.available(periods, years.where("year <> 1997"))


@query("SELECT DISTINCT period FROM edges WHERE CAST(substr(period,1,4) AS INT)%2=0")
def pending_periods(spark, sf_dir):
    """Periods without a finished row, where those of odd years are done. S10"""
    periods = fixture.edges(spark, sf_dir).select("period").distinct()
    return trade.pending(periods, periods.where("cast(substr(period, 1, 4) as int) % 2 = 1"), ["period"])
