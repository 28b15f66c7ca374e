"""Synthetic persistence of introduced and sunset codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def observed_years(totals: DataFrame) -> DataFrame:
    """code, obs_first, obs_last. Y1"""
    return totals.groupBy("code").agg(F.min("year").alias("obs_first"), F.max("year").alias("obs_last"))


def timing(candidates: DataFrame, totals: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """Candidates with observed and concordance years. Y2"""
    life = lifetimes.select("code", F.col("introduced").cast("int").alias("introduced"), F.col("sunset").cast("int").alias("sunset"))
    return candidates.join(observed_years(totals), "code", "left").join(life, "code", "left")


def inclusion(timed: DataFrame, first: int, last: int) -> DataFrame:
    """Adds status by concept (prehistory, afterlife). Y3"""
    born = F.coalesce("obs_first", "introduced")
    gone = F.coalesce("obs_last", "sunset")
    status = (
        F.when((F.col("concept") == "prehistory") & ((born <= first) | (born > last)), "introduced_outside_window")
        .when(F.col("obs_first").isNull(), "absent_in_window_data")
        .when((F.col("concept") == "afterlife") & (gone >= last), "concept_not_afterlife")
        .otherwise("included")
    )
    return timed.withColumn("status", status)


def converted_values(totals: DataFrame, chains: DataFrame, codes: DataFrame) -> DataFrame:
    """target_year, year, code, value: what each year's trade gives to a code
    of the target's vintage; raw at the target itself. Y4"""
    c = chains.select("origin_year", "target_year", "from_code", "to_code", "weight").join(codes.select(F.col("code").alias("to_code")).distinct(), "to_code", "left_semi")
    t = totals.select(F.col("year").alias("origin_year"), F.col("code").alias("from_code"), "value")
    return c.join(t, ["origin_year", "from_code"]).groupBy("target_year", F.col("origin_year").alias("year"), F.col("to_code").alias("code")).agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def share_series(timed: DataFrame, values: DataFrame, totals: DataFrame, years: list[int]) -> DataFrame:
    """concept, code, year, share, synthetic and in-life flags for each
    candidate and year. Y5"""
    spark = timed.sparkSession
    grid = timed.crossJoin(F.broadcast(spark.createDataFrame([(y,) for y in years], "year int")))
    whole = totals.groupBy("year").agg(F.sum("value").alias("_total"))
    rows = grid.join(values.select("year", "code", "value"), ["year", "code"], "left").join(F.broadcast(whole), "year", "left")
    born, gone = F.coalesce("obs_first", "introduced"), F.coalesce("obs_last", "sunset")
    synthetic = F.when(F.col("concept") == "prehistory", F.col("year") < born).otherwise(F.col("year") > gone)
    return rows.select(
        "concept", "code", "year", F.coalesce(F.try_divide("value", "_total"), F.lit(0.0)).alias("share"),
        F.coalesce(synthetic, F.lit(False)).alias("is_synthetic"), F.coalesce((F.col("year") >= born) & (F.col("year") <= gone), F.lit(False)).alias("is_inlife"),
    )


def evidence(series: DataFrame) -> DataFrame:
    """concept, code: counts, peaks, medians and sums of both windows, peak
    year, first and last, ratio of peaks. Y6"""
    share = F.col("share")
    out = []
    for name, flag in (("synthetic", F.col("is_synthetic")), ("inlife", F.col("is_inlife"))):
        v = F.when(flag, share)
        out += [
            F.count(v).alias(f"n_{name}"), F.max(v).alias(f"peak_{name}"), F.median(v).alias(f"median_{name}"), F.sum(v).alias(f"sum_{name}"),
            F.max_by(F.col("year"), F.when(flag, F.struct(share, -F.col("year")))).alias(f"peak_year_{name}"),
            F.min_by(share, F.when(flag, F.col("year"))).alias(f"first_{name}"), F.max_by(share, F.when(flag, F.col("year"))).alias(f"last_{name}"),
        ]
    return series.groupBy("concept", "code").agg(*out).withColumn("peak_ratio", F.try_divide("peak_synthetic", "peak_inlife"))


def cumulative_shares(series: DataFrame) -> DataFrame:
    """Running share of each candidate over the years."""
    w = W.partitionBy("concept", "code").orderBy("year").rowsBetween(W.unboundedPreceding, W.currentRow)
    return series.withColumn("cumulative", F.sum("share").over(w))
