"""Estimation of conversion weights from trade shares.

Everything is keyed by period, direction, measure and group. What reaches the
fits (see ``fits``) are moments, codes by codes, however many trade rows there are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.functions.codes import by_measure, flow_is, normalise_code, not_in
from vintage.operators.concordance import Groups, ambiguous_groups, code_groups, deterministic_maps, oriented
from vintage.operators.fits import GROUP, fixed_links, link_table, one_free_code, several_free_codes
from vintage.operators.weights import merge_ambiguous, refused
from vintage.sources.storage import checkpointed

#: Fixed codes that are no partner or reporter in estimation.
SPECIAL_CODES = ("QP", "QQ", "QR", "QS", "QU", "QV", "QW", "QX", "QY", "QZ")
KEY = ["period", "direction", "measure", "group_id"]


def side_shares(
    trade: DataFrame, groups: Groups, flow: str = "1", measures: Iterable[str] = ("VALUE_EUR",), exclude: Iterable[str] = SPECIAL_CODES
) -> DataFrame:
    """period, direction, measure, side, group_id, code, REPORTER, PARTNER,
    value, total, share of ambiguous groups. Trade types are summed. E1

    The direction only decides which groups count as ambiguous; codes are
    normalised before the join, as they are when weights are applied.
    """
    found = _side_values(trade, groups, flow, measures, exclude)
    total = found.groupBy(*KEY, "side").agg(F.sum("value").alias("total"))  # not a window: a giant group's pairs stay where they are
    return _with_share(found.join(total, [*KEY, "side"]))


def _side_values(trade: DataFrame, groups: Groups, flow: str, measures: Iterable[str], exclude: Iterable[str]) -> DataFrame:
    """KEY, side, code, REPORTER, PARTNER, value of ambiguous groups, written once."""
    exclude = tuple(exclude) or SPECIAL_CODES
    rows = trade.where(flow_is(flow) & not_in(F.col("REPORTER"), exclude) & not_in(F.col("PARTNER"), exclude))
    rows = rows.select(F.substring(F.col("PERIOD").cast("string"), 1, 4).alias("year"), normalise_code(F.col("PRODUCT_NC")).alias("code"), "REPORTER", "PARTNER", *measures)
    codes = checkpointed(code_groups(groups).join(ambiguous_groups(groups), ["period", "group_id"]))
    # rows of other codes go first; the sums and the join then find the rows dealt by year and code
    rows = rows.join(codes.select("year", "code").distinct(), ["year", "code"], "left_semi")
    rows = rows.groupBy("year", "code", "REPORTER", "PARTNER").agg(*[F.sum(m).alias(m) for m in measures])
    return checkpointed(by_measure(rows.join(codes, ["year", "code"]), measures).withColumn("value", F.coalesce("value", F.lit(0.0))))


def _with_share(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, "side", "code", "REPORTER", "PARTNER", "value", "total", F.try_divide("value", "total").alias("share"))


def used_shares(
    trade: DataFrame, groups: Groups, flow: str = "1", measures: Iterable[str] = ("VALUE_EUR",), exclude: Iterable[str] = SPECIAL_CODES
) -> tuple[DataFrame, DataFrame]:
    """(usable shares, totals of all groups), written: ``side_shares``, ``group_totals`` and
    ``usable_shares`` with one join, as the totals of the sides are among those of the groups. E1-E3"""
    measures = tuple(measures)
    found = _side_values(trade, groups, flow, measures, exclude)
    totals = checkpointed(group_totals(found, groups, measures))
    fit = totals.where("skip_reason is null").select(*KEY, "total_a", "total_b")
    total = F.when(F.col("side") == "a", F.col("total_a")).otherwise(F.col("total_b"))
    return checkpointed(_with_share(found.join(fit, KEY).withColumn("total", total))), totals


def group_totals(shares: DataFrame, groups: Groups, measures: Iterable[str] = ("VALUE_EUR",)) -> DataFrame:
    """KEY..., total, n_rows and n_pairs of both sides, skip_reason. E2, E3"""
    # by pair first: counts of distinct pairs beside sums would copy every share for each of them
    side, zero = F.col("side"), F.lit(0)
    pairs = shares.groupBy(*KEY, "side", "REPORTER", "PARTNER").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    by = pairs.groupBy(*KEY).agg(*[
        f.alias(f"{name}_{s}") for s in ("a", "b") for name, f in (
            ("total", F.coalesce(F.sum(F.when(side == s, F.col("value"))), F.lit(0.0))), ("n_rows", F.coalesce(F.sum(F.when(side == s, F.col("n"))), zero)),
            ("n_pairs", F.count(F.when(side == s, 1))))
    ])
    every = ambiguous_groups(groups).crossJoin(F.broadcast(shares.sparkSession.createDataFrame([(m,) for m in measures], "measure string")))
    out = every.join(by, KEY, "left").na.fill(0)
    zero_a, zero_b = F.col("total_a") <= 0, F.col("total_b") <= 0
    reason = F.when(zero_a & zero_b, "zero_total_a_b").when(zero_a, "zero_total_a").when(zero_b, "zero_total_b")
    return out.withColumn("skip_reason", reason)


def usable_shares(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """Shares of groups that are not skipped. E3"""
    return shares.join(totals.where("skip_reason is null").select(*KEY), KEY, "left_semi")


def pair_universe(shares: DataFrame) -> DataFrame:
    """Pairs of either side of each group. E4"""
    return shares.select(*KEY, "REPORTER", "PARTNER").distinct()


def design_columns(shares: DataFrame, groups: Groups) -> DataFrame:
    """Every code of the groups with its total share, 0 without trade. E5"""
    codes = code_groups(groups).select("period", "side", "code", "group_id")
    keys = shares.select(*KEY).distinct()
    sums = shares.groupBy(*KEY, "side", "code").agg(F.sum("share").alias("share"))
    return keys.join(codes, ["period", "group_id"]).join(sums, [*KEY, "side", "code"], "left").na.fill(0.0, ["share"])


def _sides(shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From side and to side, by direction."""
    return shares.where(_is_from()), shares.where(~_is_from())


def _is_from() -> Column:
    return (F.col("side") == "a") == (F.col("direction") == "a_to_b")


def normal_moments(shares: DataFrame) -> DataFrame:
    """KEY..., kind, i, j, value: M = X'X (kind m, from by from) and N = X'Y
    (kind n, from by to), plus yy = |Y|^2. E6

    One join of the from side with both sides within a pair: its rows are
    bounded by the codes of a group, not by its trade.
    """
    on = [*KEY, "REPORTER", "PARTNER"]
    from_side, to_side = _sides(shares)
    x = from_side.select(*on, F.col("code").alias("i"), F.col("share").alias("x"))
    every = shares.select(*on, F.col("code").alias("j"), F.col("share").alias("y"), F.when(_is_from(), "m").otherwise("n").alias("kind"))
    mn = x.join(every, on).groupBy(*KEY, "kind", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
    yy = to_side.groupBy(*KEY, F.lit("y").alias("kind"), F.lit("").alias("i"), F.lit("").alias("j")).agg(F.sum(F.col("share") * F.col("share")).alias("value"))
    return mn.unionByName(yy)


# --------------------------------------------------------------------- fit
def fitted_weights(moments: DataFrame, groups: Groups, extra: tuple[str, ...] = (), start: DataFrame | None = None) -> DataFrame:
    """KEY..., extra..., from_code, to_code, weight, status of every link of the
    fitted groups; ``extra`` are further key columns of the moments, such as a
    resampling run, and ``start`` (KEY..., extra..., from_code, to_code, weight) is where
    refits begin. E7"""
    key = [*KEY, *extra]
    moments = checkpointed(moments)
    links = link_table(oriented(groups.edges)).join(moments.select(*key).distinct(), GROUP)
    links = checkpointed(links)
    plain = fixed_links(links.where("n_free = 0"), key).unionByName(one_free_code(links, moments, key)).withColumn("status", F.lit("solved"))
    return plain.unionByName(several_free_codes(links, moments, key, start))


def pure_split_weights(moments: DataFrame, groups: Groups) -> DataFrame:
    """The fit in closed form where a group has one from-code, all in SQL. E7a"""
    links = link_table(oriented(groups.edges)).where("n_links = n_to").join(moments.select(*KEY).distinct(), GROUP)
    return one_free_code(links, moments, KEY)


def objectives(weights: DataFrame, moments: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key..., objective: tr(B'MB) - 2 tr(B'N), from the entries that are not 0."""
    b = weights.where("weight <> 0").select(*key, "from_code", "to_code", "weight")
    one = b.select(*key, F.col("from_code").alias("i"), F.col("to_code").alias("t"), F.col("weight").alias("b_i"))
    two = b.select(*key, F.col("from_code").alias("j"), F.col("to_code").alias("t"), F.col("weight").alias("b_j"))
    m = moments.where("kind = 'm'").select(*key, "i", "j", "value").join(one, [*key, "i"]).join(two, [*key, "j", "t"])
    n = moments.where("kind = 'n'").select(*key, "i", F.col("j").alias("t"), "value").join(one, [*key, "i", "t"])
    parts = m.select(*key, (F.col("value") * F.col("b_i") * F.col("b_j")).alias("v")).unionByName(n.select(*key, (-2 * F.col("value") * F.col("b_i")).alias("v")))
    return parts.groupBy(*key).agg(F.sum("v").alias("objective"))


def fit_diagnostics(weights: DataFrame, totals: DataFrame, groups: Groups, moments: DataFrame) -> DataFrame:
    """One row for each fitted group. E8"""
    rows = weights.groupBy(*KEY, "from_code").agg(F.sum("weight").alias("s"))
    rows = rows.groupBy(*KEY).agg(F.max(F.abs(F.col("s") - 1)).alias("max_row_sum_deviation"))
    by = weights.groupBy(*KEY).agg(
        F.first("status").alias("status"), F.count(F.lit(1)).alias("n_vars"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"),
    )
    size = groups.summary.select("period", "group_id", "n_vintage_a", "n_vintage_b", "n_edges")
    out = by.join(rows, KEY).join(objectives(weights, moments), KEY, "left").na.fill(0.0, ["objective"])
    return out.join(totals.select(*KEY, "n_pairs_a", "n_pairs_b"), KEY).join(size, ["period", "group_id"])


def unsolved(diagnostics: DataFrame) -> DataFrame:
    """E9"""
    return diagnostics.where(~F.col("status").startswith("solved"))


def run_summary(totals: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """period, direction, measure: groups in all, with data, solved, failed, skipped. E10"""
    d = diagnostics.select(*KEY, "status", "max_row_sum_deviation")
    return totals.join(d, KEY, "left").groupBy("period", "direction", "measure").agg(
        F.count(F.lit(1)).alias("n_groups"), F.count(F.when(F.col("skip_reason").isNull(), 1)).alias("n_with_data"),
        F.count(F.when(F.col("status").startswith("solved"), 1)).alias("n_solved"),
        F.count(F.when(F.col("status").isNotNull() & ~F.col("status").startswith("solved"), 1)).alias("n_failed"),
        F.count("skip_reason").alias("n_skipped"), F.sum("n_rows_a").alias("n_rows_a"), F.sum("n_rows_b").alias("n_rows_b"),
        F.max("max_row_sum_deviation").alias("deviation_max"), F.avg("max_row_sum_deviation").alias("deviation_mean"),
    )


def solved_only(weights: DataFrame) -> DataFrame:
    """The weights; one of an unsolved fit raises when it is computed. E9"""
    return weights.withColumn("weight", F.when(F.col("status").startswith("solved"), F.col("weight")).otherwise(refused("unsolved fit", "from_code")))


def estimate(
    trade: DataFrame, groups: Groups, measures: Iterable[str] = ("VALUE_EUR", "QUANTITY_KG"), flow: str = "1", exclude: Iterable[str] = SPECIAL_CODES, fail_on_status: bool = True
) -> dict[str, DataFrame]:
    """Shares, totals, moments, weights, diagnostics and summary of all
    periods, directions and measures in one job. Shares and fits are written
    once. ``weights`` raises on fits that are not solved unless told not to;
    ``weights_ambiguous`` and ``diagnostics`` show them. E9, E11"""
    used, totals = used_shares(trade, groups, flow, measures, exclude)
    moments = checkpointed(normal_moments(used))
    weights = checkpointed(fitted_weights(moments, groups))
    diagnostics = fit_diagnostics(weights, totals, groups, moments)
    fixed = deterministic_maps(groups).crossJoin(F.broadcast(trade.sparkSession.createDataFrame([(m,) for m in measures], "measure string")))
    steps = merge_ambiguous(solved_only(weights) if fail_on_status else weights, fixed, ["period", "direction", "measure"])
    return {
        "shares": used, "totals": totals, "moments": moments, "weights_ambiguous": weights, "weights_deterministic": fixed,
        "weights": steps, "diagnostics": diagnostics, "summary": run_summary(totals, diagnostics),
    }
