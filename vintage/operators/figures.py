"""Tables behind figures (V1-V5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLASSES = ["1:1", "m:1", "1:n", "m:n"]


def class_share_matrix(distribution: DataFrame, row: str) -> DataFrame:
    """row by class of shares, 0 where missing. V1"""
    return distribution.groupBy(row).pivot("class", CLASSES).agg(F.sum("share")).na.fill(0.0)


def scaled_rows(df: DataFrame, row: str, metrics: list[str], counts: tuple[str, ...] = ()) -> DataFrame:
    """row, metric, scaled: min-max over each metric; counts are logged and
    turned round; 0.5 where a metric is constant. V2"""
    ready = df.select(row, *[(-F.log1p(F.col(m).cast("double")) if m in counts else F.col(m).cast("double")).alias(m) for m in metrics])
    long = ready.unpivot([row], metrics, "metric", "value")
    w = W.partitionBy("metric")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return long.select(row, "metric", F.when(hi == lo, 0.5).otherwise(F.try_divide(F.col("value") - lo, hi - lo)).alias("scaled"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1..bins), n; the upper end belongs to the last bin. V3"""
    b = F.when(F.col(column) == high, bins).otherwise(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)))
    return df.where(F.col(column).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def anchored(curves: DataFrame, anchor: int, year: str, value: str, by: list[str]) -> DataFrame:
    """Curves with (anchor, 0) added to each. V4"""
    zero = curves.select(*by).distinct().select(*by, F.lit(anchor).alias(year), F.lit(0.0).alias(value))
    return curves.select(*by, year, value).unionByName(zero)


def regime_segments(series: DataFrame, flag: str, by: list[str], year: str = "year") -> DataFrame:
    """Rows with a segment number; the first row of a new regime also ends the
    segment before it. V5"""
    w = W.partitionBy(*by).orderBy(year)
    new = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(0))
    rows = series.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w)).withColumn("bridge", F.lit(False))
    ends = rows.where("_new = 1").withColumns({"segment": F.col("segment") - 1, "bridge": F.lit(True)})
    return rows.unionByName(ends).drop("_new")
