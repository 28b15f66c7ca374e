"""Statistics as aggregate columns (M1-M16). Non-finite inputs are left out;
a statistic without data or with a zero denominator is NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.operators.skew import crowded_keys, dealt_join
from vintage.sources.storage import checkpointed


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def _where(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def r2_45(x: Column, y: Column) -> Column:
    """1 - SSE / SST around the 45-degree line. M1"""
    ok = finite(x, y)
    sst = F.var_pop(_where(ok, y)) * F.count(_where(ok, y))
    return F.when(sst > 0, 1 - F.try_divide(F.sum(_where(ok, (y - x) * (y - x))), sst))


def mae(x: Column, y: Column) -> Column:
    """M2"""
    return F.avg(_where(finite(x, y), F.abs(y - x)))


def r2_45_weighted(x: Column, y: Column, w: Column) -> Column:
    """M3, weights > 0 only."""
    ok = finite(x, y, w) & (w > 0)
    sw, swy, swyy = F.sum(_where(ok, w)), F.sum(_where(ok, w * y)), F.sum(_where(ok, w * y * y))
    sst = swyy - F.try_divide(swy * swy, sw)
    return F.when(sst > 0, 1 - F.try_divide(F.sum(_where(ok, w * (y - x) * (y - x))), sst))


def r2_45_weighted_symmetric(x: Column, y: Column, w_x: Column, w_y: Column) -> Column:
    """M4"""
    return r2_45_weighted(x, y, (w_x + w_y) / 2)


def mae_weighted(x: Column, y: Column, w_x: Column, w_y: Column) -> Column:
    """M5"""
    w = (w_x + w_y) / 2
    ok = finite(x, y, w) & (w > 0)
    return F.try_divide(F.sum(_where(ok, w * F.abs(y - x))), F.sum(_where(ok, w)))


def weighted_mean(value: Column, w: Column) -> Column:
    """M6"""
    ok = finite(value, w) & (w > 0)
    return F.try_divide(F.sum(_where(ok, value * w)), F.sum(_where(ok, w)))


def exposure(value: Column, ambiguous: Column) -> Column:
    """Share of value in ambiguous codes. M7"""
    return F.try_divide(F.coalesce(F.sum(_where(ambiguous, value)), F.lit(0.0)), F.sum(value))


def normalised_entropy(weights: DataFrame, feasible: str = "k", by: tuple[str, ...] = ("from_code",)) -> DataFrame:
    """by..., entropy: -sum p ln p / ln k of each code's weights, 0 if k <= 1. M8"""
    p = F.col("weight")
    h = -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))
    k = F.max(feasible)
    return weights.groupBy(*by).agg(F.when(k > 1, h / F.log(k.cast("double"))).otherwise(0.0).alias("entropy"))


#: M9: statistics by name, for pairs (x, y) and for pairs with two weights.
REGISTRY: dict[str, Callable[..., Column]] = {
    "r2_45": r2_45, "mae": mae, "r2_45_weighted": r2_45_weighted,
    "r2_45_weighted_symmetric": r2_45_weighted_symmetric, "mae_weighted": mae_weighted,
}


def metric(name: str) -> Callable[..., Column]:
    if name not in REGISTRY:
        raise KeyError(f"unknown metric {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def slope_hc1(df: DataFrame, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """Least squares through the origin with HC1 errors: coef, se, n. M10

    The residuals take a second pass over the rows, which is steadier than a
    difference of fourth moments."""
    cx, cy = F.col(x), F.col(y)
    rows = df.where(finite(cx, cy))
    first = rows.groupBy(*by).agg(F.sum(cx * cx).alias("_xx"), F.sum(cx * cy).alias("_xy"), F.count(F.lit(1)).alias("n"))
    first = first.withColumn("coef", F.try_divide("_xy", "_xx"))
    e = cy - F.col("coef") * cx
    meat = rows.join(first.select(*by, "coef"), list(by)).groupBy(*by).agg(F.sum(cx * cx * e * e).alias("_meat"))
    out = first.join(meat, list(by))
    scale = F.try_divide(F.col("n").cast("double"), (F.col("n") - 1).cast("double"))
    return out.select(*by, "coef", F.sqrt(scale * F.try_divide(F.col("_meat"), F.col("_xx") * F.col("_xx"))).alias("se"), "n")


def line_sums(x: Column, y: Column) -> list[Column]:
    """Sums of which ``line_fit`` makes what ``slope_hc1`` and ``r2_45`` give, in one pass.
    Distances are taken from the 45-degree line, and rows with y = 0 apart, so that neither a
    line of slope one nor one of slope zero is a difference of large sums. M1, M10"""
    ok = finite(x, y)
    d, flat = y - x, y == 0
    total = lambda v, name, cond=None: F.sum(_where(ok if cond is None else ok & cond, v)).alias(name)
    return [
        F.count(_where(ok, F.lit(1))).alias("_rows"), F.count(_where(~ok, F.lit(1))).alias("_bad"), F.var_pop(_where(ok, y)).alias("_var"), F.avg(_where(ok, y)).alias("_mean"),
        total(x * x, "_xx"), total(x * y, "_xy"), total(x * d, "_xd"), total(d * d, "_dd"), total(x * x * x * x, "_flat", flat),
        total(x * x * d * d, "_xxdd", ~flat), total(x * x * x * d, "_xxxd", ~flat), total(x * x * x * x, "_xxxx", ~flat),
    ]


def line_fit(n: Column) -> list[Column]:
    """coef, se, n, r2_45 from ``line_sums`` of ``n`` rows, of which those not summed are zero in both. M1, M10"""
    c = F.try_divide("_xd", "_xx")  # the slope less one
    coef, some = F.try_divide("_xy", "_xx"), lambda name: F.coalesce(name, F.lit(0.0))
    meat = coef * coef * some("_flat") + F.greatest(some("_xxdd") - 2 * c * some("_xxxd") + c * c * some("_xxxx"), F.lit(0.0))
    scale = F.try_divide(n.cast("double"), (n - 1).cast("double"))
    sst = F.col("_var") * F.col("_rows") + F.col("_mean") * F.col("_mean") * F.try_divide(F.col("_rows") * (n - F.col("_rows")).cast("double"), n)
    return [
        coef.alias("coef"), F.sqrt(scale * F.try_divide(meat, F.col("_xx") * F.col("_xx"))).alias("se"), n.alias("n"),
        F.when(sst > 0, 1 - F.try_divide(F.col("_dd"), sst)).alias("r2_45"),
    ]


def value_ranks(df: DataFrame, column: str, by: tuple[str, ...]) -> DataFrame:
    """by..., column, n (rows of this value), before (rows of lower values).

    Values are counted first, so ties are one row, and dealt by ranges; a rank is
    that within its range and what the ranges before hold. No task sees all
    values of a key. M11, M12"""
    spark = df.sparkSession
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = checkpointed(counts.repartitionByRange(ranges, *by, column).withColumn("_p", F.spark_partition_id()))
    earlier = W.unboundedPreceding, -1
    within = F.coalesce(F.sum("n").over(W.partitionBy("_p", *by).orderBy(column).rowsBetween(*earlier)), F.lit(0))
    sizes = counts.groupBy("_p", *by).agg(F.sum("n").alias("_m"))  # keys and ranges together at most
    sizes = sizes.select("_p", *by, F.coalesce(F.sum("_m").over(W.partitionBy(*by).orderBy("_p").rowsBetween(*earlier)), F.lit(0)).alias("_before"))
    return counts.withColumn("_w", within).join(sizes, ["_p", *by]).select(*by, column, "n", (F.col("_w") + F.col("_before")).alias("before"))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """by..., spearman; NULL under two rows; ties have their mean rank. M11"""
    rows = checkpointed(df.where(finite(F.col(x), F.col(y))).select(*by, x, y))
    n = rows.count()
    for c, name in ((x, "_rx"), (y, "_ry")):
        rank = value_ranks(rows, c, by).select(*by, c, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
        rows = dealt_join(rows, rank, [*by, c], crowded_keys(rows, [*by, c], n), [y if c == x else "_rx"])
    return rows.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 2, F.corr("_rx", "_ry")).alias("spearman"))


def quantiles(df: DataFrame, column: str, by: tuple[str, ...], points: tuple[int, ...] = (50, 75, 90, 95)) -> DataFrame:
    """by..., p<point>...: exact quantiles in percent, between two values in
    proportion, read from ranks. M12"""
    ranks = value_ranks(df.where(finite(F.col(column))), column, by)
    total = ranks.groupBy(*by).agg(F.sum("n").alias("_n"))
    rows = ranks.join(total, list(by))
    picks = []
    for p in points:
        h = (F.col("_n") - 1) * (p / 100)
        for name, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            picks.append(F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(column))).alias(f"_{name}{p}"))
    picked = rows.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    h = lambda p: (F.col("_n") - 1) * (p / 100)
    return picked.select(*by, *[(F.col(f"_lo{p}") + (F.col(f"_hi{p}") - F.col(f"_lo{p}")) * (h(p) - F.floor(h(p)))).alias(f"p{p}") for p in points])


def limit_shares(column: str) -> list[Column]:
    """Shares under and over fixed limits. M12"""
    c = F.col(column)
    out = [F.avg((c <= t).cast("double")).alias(f"share_le_{str(t)[2:]}") for t in (0.05, 0.10)]
    return [*out, F.avg((c > 0.20).cast("double")).alias("share_gt_20")]


def link_spread(column: str) -> list[Column]:
    """min, max, mean, std (0 for one row), range. M13"""
    c = F.col(column)
    return [
        F.min(c).alias("w_min"), F.max(c).alias("w_max"), F.avg(c).alias("w_mean"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("w_std"), (F.max(c) - F.min(c)).alias("w_range"),
    ]


def first_difference(column: str, order: str, by: tuple[str, ...]) -> Column:
    """M14"""
    return F.col(column) - F.lag(column).over(W.partitionBy(*by).orderBy(order))


def peak(value: str, year: str) -> tuple[Column, Column]:
    """Largest value and the first year that has it. M15"""
    return F.max(value), F.max_by(F.col(year), F.struct(F.col(value), -F.col(year)))


def median(column: str) -> Column:
    """M16"""
    return F.median(F.col(column))
