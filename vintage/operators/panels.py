"""Samples, share panels and step metrics.

``chains`` has origin_year, from_code, to_code, weight to one target; years are
a column everywhere, so one job covers all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.functions import metrics as M
from vintage.functions.codes import chain_steps, normalise_code, not_in
from vintage.operators.apply import recode_totals
from vintage.operators.components import components
from vintage.operators.concordance import Groups, ambiguous_edges, group_number, ranked, strict_one_to_one


def map_codes(codes: DataFrame, chains: DataFrame, preserve_unmapped: bool = False) -> DataFrame:
    """codes (year, code, ...) -> distinct (..., year, to_code). G19"""
    c = chains.select(F.col("origin_year").alias("year"), F.col("from_code").alias("code"), "to_code")
    out = codes.join(c, ["year", "code"], "left" if preserve_unmapped else "inner")
    return out.withColumn("to_code", F.coalesce("to_code", "code")).drop("code").distinct()


def source_codes(sample: DataFrame, chains: DataFrame) -> DataFrame:
    """origin_year, from_code of chains that end in the sample (code). G20"""
    return chains.join(sample.select(F.col("code").alias("to_code")).distinct(), "to_code", "left_semi").select("origin_year", "from_code").distinct()


def chain_sample(groups: Groups, chains: DataFrame, base: int, target: int, preserve_unmapped: bool = False) -> DataFrame:
    """code (at the target), group_id: ambiguous groups of every step from base
    to target, joined where they share a target code. G18"""
    spark = chains.sparkSession
    steps = chain_steps(spark, base, target).select("period", "direction")
    e = ambiguous_edges(groups).join(F.broadcast(steps), ["period", "direction"])
    star = F.concat_ws("|", "period", "group_id").alias("star")
    codes = e.select(star, F.col("from_vintage_year").cast("int").alias("year"), F.col("from_code").alias("code")).union(
        e.select(star, F.col("to_vintage_year").cast("int").alias("year"), F.col("to_code").alias("code"))
    ).distinct()
    linked = map_codes(codes, chains, preserve_unmapped).select(F.lit(1).alias("one"), F.concat(F.lit("S"), "star").alias("u"), F.concat(F.lit("C"), "to_code").alias("v")).distinct()
    label = components(linked, ["one"]).where("node like 'C%'").select(F.substring("node", 2, 100).alias("code"), "component")
    first = label.groupBy("component").agg(F.min("code").alias("lo"))
    first = ranked(first.withColumn("_one", F.lit(1)), ["_one"], "lo", [])
    first = first.select("component", F.concat(F.lit(f"{base}to{target}_g"), group_number(F.col("rank"))).alias("group_id"))
    return label.join(first, "component").select("code", "group_id")


def product_totals(trade: DataFrame, measure: str = "VALUE_EUR", flow: str | None = None, no_reporters: tuple[str, ...] = (), no_partners: tuple[str, ...] = ()) -> DataFrame:
    """year, code, value. P1, N8"""
    rows = trade.where(not_in(F.col("REPORTER"), no_reporters) & not_in(F.col("PARTNER"), no_partners))
    if flow is not None:
        rows = rows.where(F.col("FLOW").cast("string") == flow)
    year = F.substring(F.col("PERIOD").cast("string"), 1, 4).cast("int").alias("year")
    return rows.groupBy(year, normalise_code(F.col("PRODUCT_NC")).alias("code")).agg(F.sum(measure).alias("value"))


def target_totals(totals: DataFrame, chains: DataFrame) -> DataFrame:
    """Totals of every year in the target's codes. P2-P4"""
    return recode_totals(totals, chains.withColumn("year", F.col("origin_year")), ["year"])


def group_values(totals: DataFrame, group_map: DataFrame) -> DataFrame:
    """year, group_id, code, value in levels. P4"""
    return totals.join(group_map, "code").select("year", "group_id", "code", F.coalesce("value", F.lit(0.0)).alias("value"))


def group_shares(values: DataFrame) -> DataFrame:
    """Adds the share in the group's total. P2, P3"""
    return values.withColumn("share", F.try_divide("value", F.sum("value").over(W.partitionBy("year", "group_id"))))


def year_pairs(shares: DataFrame, gap: int = 1, keep: DataFrame | None = None) -> DataFrame:
    """x_year, y_year, group_id, code, share_t, share_t1, value_x, value_y of
    codes present in both years. P5-P7"""
    if keep is not None:
        shares = shares.join(keep.select("group_id").distinct(), "group_id", "left_semi")
    x = shares.select(F.col("year").alias("x_year"), (F.col("year") + gap).alias("y_year"), "group_id", "code", F.col("share").alias("share_t"), F.col("value").alias("value_x"))
    y = shares.select(F.col("year").alias("y_year"), "group_id", "code", F.col("share").alias("share_t1"), F.col("value").alias("value_y"))
    return x.join(y, ["y_year", "group_id", "code"])


def panel_metrics(pairs: DataFrame, by: tuple[str, ...] = ("x_year",)) -> DataFrame:
    """r2_45, weighted and symmetric forms, MAE of each panel, each with its
    own years' values as weights. M1-M5, P10"""
    x, y, wx, wy = (F.col(c) for c in ("share_t", "share_t1", "value_x", "value_y"))
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), M.r2_45(x, y).alias("r2_45"), M.r2_45_weighted(x, y, wx).alias("r2_45_weighted"),
        M.r2_45_weighted_symmetric(x, y, wx, wy).alias("r2_45_symmetric"), M.mae(x, y).alias("mae"), M.mae_weighted(x, y, wx, wy).alias("mae_weighted"),
        F.countDistinct("group_id").alias("n_groups"), F.countDistinct("code").alias("n_codes"),
    )


def step_metrics(sample: DataFrame, totals: DataFrame, chains: DataFrame, feasible: DataFrame, steps_weights: DataFrame, base: int, target: int) -> DataFrame:
    """One row for each step of base -> target: trade of the sample, ambiguous
    trade, exposure, diffuseness, diffuse exposure, ambiguous codes. P8

    ``feasible``: period, direction, from_code, k; ``steps_weights``: period,
    direction, from_code, to_code, weight of ambiguous links.
    """
    spark = sample.sparkSession
    steps = chain_steps(spark, base, target).select((F.col("step_index") + 1).alias("step_index"), "period", "direction", "source_year")
    inside = source_codes(sample, chains).select(F.col("origin_year").alias("source_year"), F.col("from_code").alias("code"))
    t = totals.withColumnRenamed("year", "source_year").join(inside, ["source_year", "code"])
    t = t.join(F.broadcast(steps), "source_year")
    k = feasible.select("period", "direction", F.col("from_code").alias("code"), "k")
    h = steps_weights.join(feasible, ["period", "direction", "from_code"])
    h = M.normalised_entropy(h, "k", ("period", "direction", "from_code")).withColumnRenamed("from_code", "code")
    rows = t.join(k, ["period", "direction", "code"], "left").join(h, ["period", "direction", "code"], "left")
    ambiguous = F.coalesce(F.col("k") > 1, F.lit(False))
    out = rows.groupBy("step_index", "period", "direction", "source_year").agg(
        F.sum("value").alias("total_trade"), F.coalesce(F.sum(F.when(ambiguous, F.col("value"))), F.lit(0.0)).alias("ambiguous_trade"),
        M.exposure(F.col("value"), ambiguous).alias("exposure"), M.weighted_mean(F.when(ambiguous, F.col("entropy")), F.col("value")).alias("diffuseness"),
        F.count(F.when(ambiguous, 1)).alias("n_ambiguous"),
    )
    return out.withColumn("diffuse_exposure", F.col("diffuseness") * F.try_divide("ambiguous_trade", "total_trade"))


def chain_metrics(steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted means of step metrics over a chain. P9"""
    total, amb = F.col("total_trade"), F.col("ambiguous_trade")
    return steps.groupBy(*by).agg(
        M.weighted_mean(F.col("exposure"), total).alias("exposure"), M.weighted_mean(F.col("diffuseness"), amb).alias("diffuseness"),
        M.weighted_mean(F.col("diffuse_exposure"), total).alias("diffuse_exposure"),
    )


def stable_groups(group_map: DataFrame, unstable: DataFrame, chains: DataFrame) -> DataFrame:
    """Groups without a code that ``unstable`` (year, code) touches. P11"""
    touched = map_codes(unstable.select("year", "code"), chains).select(F.col("to_code").alias("code"))
    bad = group_map.join(touched.distinct(), "code", "left_semi").select("group_id").distinct()
    return group_map.join(bad, "group_id", "left_anti")


def panel_counts(group_map: DataFrame) -> DataFrame:
    """P12"""
    return group_map.agg(F.countDistinct("group_id").alias("n_groups"), F.countDistinct("code").alias("n_codes"))


def deterministic_lineage(start: DataFrame, edges: DataFrame, years: list[int]) -> DataFrame:
    """origin_code, year, code: codes followed through strict 1:1 links; a code
    that is not revised persists, one that is revised otherwise is dropped. P13

    ``start`` has origin_code; ``years`` begins with its year and goes up or
    down by one: a loop of one join for each year.
    """
    strict = strict_one_to_one(edges)
    now = start.select("origin_code", F.col("origin_code").alias("code"))
    out = now.select("origin_code", F.lit(years[0]).alias("year"), "code")
    for y, z in zip(years, years[1:]):
        s, o = ("a", "b") if z > y else ("b", "a")
        period = f"{min(y, z)}{max(y, z)}"
        links = strict.where(F.col("period") == period).select(F.col(f"vintage_{s}_code").alias("code"), F.col(f"vintage_{o}_code").alias("next"))
        touched = edges.where(F.col("period") == period).select(F.col(f"vintage_{s}_code").alias("code")).distinct().withColumn("revised", F.lit(True))
        now = now.join(links, "code", "left").join(touched, "code", "left")
        now = now.select("origin_code", F.coalesce("next", F.when(F.col("revised").isNull(), F.col("code"))).alias("code")).where("code is not null")
        out = out.unionByName(now.select("origin_code", F.lit(z).alias("year"), "code"))
    return out


def complete_groups(group_map: DataFrame, lineage: DataFrame, n_years: int) -> DataFrame:
    """Rows of groups all of whose codes are alive in every year. P14"""
    alive = lineage.groupBy(F.col("origin_code").alias("code")).agg(F.countDistinct("year").alias("n"))
    whole = group_map.join(alive, "code", "left").groupBy("group_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("n")).where(F.col("n") == n_years)
    return group_map.join(whole, "group_id", "left_semi")


def lineage_shares(group_map: DataFrame, lineage: DataFrame, totals: DataFrame) -> DataFrame:
    """year, group_id, code (of the origin year), value (0 without trade),
    share; groups with trade in the year only. P15"""
    rows = group_map.select(F.col("code").alias("origin_code"), "group_id").join(lineage, "origin_code")
    rows = rows.join(totals, ["year", "code"], "left").select("year", "group_id", F.col("origin_code").alias("code"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return group_shares(rows).where("share is not null")


def placebo_pairs(group_map: DataFrame, lineage: DataFrame, totals: DataFrame, focal: DataFrame) -> DataFrame:
    """Pairs of the years before and after by lineage, and the focal pairs as
    they are. P16"""
    return year_pairs(lineage_shares(group_map, lineage, totals)).withColumn("panel", F.lit("lineage")).unionByName(focal.withColumn("panel", F.lit("focal")))


def compare_panels(ours: DataFrame, common: DataFrame) -> DataFrame:
    """x_year, both r2_45 and their difference. P17"""
    a = ours.select("x_year", F.col("r2_45").alias("r2_own"))
    b = common.select("x_year", F.col("r2_45").alias("r2_common"))
    return a.join(b, "x_year", "full").withColumn("delta", F.col("r2_own") - F.col("r2_common"))


def base_pairs(shares: DataFrame, base: int) -> DataFrame:
    """Pairs of the base year with every other year. P6, P18"""
    x = shares.where(F.col("year") == base).select("group_id", "code", F.col("share").alias("share_t"), F.col("value").alias("value_x"))
    y = shares.where(F.col("year") != base).select(F.col("year").alias("compare_year"), "group_id", "code", F.col("share").alias("share_t1"), F.col("value").alias("value_y"))
    return y.join(x, ["group_id", "code"]).withColumn("base_year", F.lit(base))


def stress(shares: DataFrame, base: int) -> DataFrame:
    """compare_year: r2, symmetric r2 and weighted MAE against the base. P18"""
    return panel_metrics(base_pairs(shares, base), ("base_year", "compare_year"))


def stress_run(shares: DataFrame, steps: DataFrame, base: int) -> DataFrame:
    """direction, length: panel metrics of the chain against the base, and the
    step metrics (``steps``: direction, length of the step) over the chain. P18, P19"""
    s = stress(shares, base).withColumns({
        "direction": F.when(F.col("compare_year") > base, "after").otherwise("before"), "length": F.abs(F.col("compare_year") - base),
    })
    chains = s.select("direction", "length").join(steps.withColumnRenamed("length", "_step"), "direction").where("_step <= length")
    return s.join(chain_metrics(chains, ("direction", "length")), ["direction", "length"])


def chain_length(shares: DataFrame, base: int) -> DataFrame:
    """direction, length: loss (1 - symmetric r2), weighted MAE, change from one
    length to the next. P19, M14"""
    s = stress(shares, base).withColumns({
        "direction": F.when(F.col("compare_year") > base, "after").otherwise("before"),
        "length": F.abs(F.col("compare_year") - base), "loss": 1 - F.col("r2_45_symmetric"),
    })
    return s.select("direction", "length", "loss", "mae_weighted", M.first_difference("loss", "length", ("direction",)).alias("delta_loss"))
