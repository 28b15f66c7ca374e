"""Weight tables: finalise, validate, complete.

A weight table has from_code, to_code, weight and any key columns (period,
direction, measure, origin...), which are passed as ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def violations(weights: DataFrame, key: list[str], neg_tol: float = 1e-6) -> DataFrame:
    """Rows that cannot be finalised: null, too negative, or of a code whose
    clamped weights sum to zero. W1 gates"""
    w = weights.withColumn("_c", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0))
    w = w.withColumn("_s", F.sum("_c").over(W.partitionBy(*key, "from_code")))
    reason = F.when(F.col("weight").isNull() | F.isnan("weight"), "missing").when(F.col("weight") < -neg_tol, "negative").when(F.col("_s") <= 0, "zero row")
    return w.withColumn("reason", reason).where("reason is not null").drop("_c", "_s")


def finalise(weights: DataFrame, key: list[str], neg_tol: float = 1e-6, pos_tol: float = 1e-10) -> DataFrame:
    """Clamp, renormalise by code, drop zeros. What can't be finalised (see
    ``violations``) raises when the rows are computed, in the same pass. W1"""
    w = F.col("weight")
    clamped = (
        F.when(w.isNull() | F.isnan(w), refused("missing weight", "from_code")).when(w < -neg_tol, refused("weight below the tolerance", "from_code"))
        .when(w < pos_tol, 0.0).otherwise(w)
    )
    total = F.sum("weight").over(W.partitionBy(*key, "from_code"))
    out = weights.withColumn("weight", clamped).withColumn("_t", total)
    share = F.when(F.col("_t") <= 0, refused("weights that sum to zero", "from_code")).otherwise(F.try_divide("weight", "_t"))
    return out.withColumn("weight", share).where("weight > 0").drop("_t")


def refused(what: str, code: str, kind: str = "double") -> Column:
    """A weight (or weights, as ``kind`` says) that fails the job, naming the code."""
    return F.raise_error(F.concat_ws(" ", F.lit(what), F.lit("of code"), F.col(code))).cast(kind)


def invalid(weights: DataFrame, key: list[str], row_sum_tol: float = 1e-6) -> DataFrame:
    """Violations of a finished table: nulls, bounds, row sums. Empty if valid. W2"""
    nulls = F.col("from_code").isNull() | F.col("to_code").isNull() | F.col("weight").isNull()
    rows = weights.select(*key, "from_code", F.when(nulls, "null").when((F.col("weight") < 0) | (F.col("weight") > 1), "bounds").alias("reason"))
    sums = weights.groupBy(*key, "from_code").agg(F.sum("weight").alias("_s")).where(F.abs(F.col("_s") - 1) > row_sum_tol)
    return rows.where("reason is not null").unionByName(sums.select(*key, "from_code", F.lit("row sum").alias("reason")))


def within_bounds(weights: DataFrame, tol: float = 1e-9) -> DataFrame:
    """One row: least, greatest, ok. W3"""
    out = weights.agg(F.min("weight").alias("least"), F.max("weight").alias("greatest"))
    return out.withColumn("ok", F.coalesce((F.col("least") >= -tol) & (F.col("greatest") <= 1 + tol), F.lit(True)))


def row_sum_deviation(weights: DataFrame, key: list[str]) -> DataFrame:
    """key..., deviation: greatest |sum - 1|; use with key [] for one row. W4"""
    sums = weights.groupBy(*key, "from_code").agg(F.sum("weight").alias("_s"))
    return sums.groupBy(*key).agg(F.coalesce(F.max(F.abs(F.col("_s") - 1)), F.lit(0.0)).alias("deviation"))


def complete(codes: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
    """codes (on..., from_code) with their weights; a code without any maps to
    itself with weight 1. W5"""
    w = weights.select(*on, "from_code", "to_code", "weight")
    out = codes.join(w, [*on, "from_code"], "left")
    return out.withColumns({"to_code": F.coalesce("to_code", "from_code"), "weight": F.coalesce("weight", F.lit(1.0))})


def missing_codes(codes: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
    """Distinct codes without a weight. W6"""
    return codes.select(*on, "from_code").distinct().join(weights, [*on, "from_code"], "left_anti")


#: Which measure's weights convert which column.
STRATEGIES = {
    "weights_value": {"VALUE_EUR": "VALUE_EUR", "QUANTITY_KG": "VALUE_EUR"},
    "weights_quantity": {"VALUE_EUR": "QUANTITY_KG", "QUANTITY_KG": "QUANTITY_KG"},
    "weights_split": {"VALUE_EUR": "VALUE_EUR", "QUANTITY_KG": "QUANTITY_KG"},
}


def assert_empty(rows: DataFrame, message: str) -> None:
    """Gate: raises with a few of the rows."""
    some = rows.limit(10).collect()
    if some:
        raise ValueError(f"{message}: {[r.asDict() for r in some]}")


def merge_ambiguous(ambiguous: DataFrame, deterministic: DataFrame, key: list[str]) -> DataFrame:
    """Ambiguous weights win over deterministic ones of the same code. S3"""
    cols = [*key, "from_code", "to_code", "weight"]
    rest = deterministic.select(*cols).join(ambiguous.select(*key, "from_code").distinct(), [*key, "from_code"], "left_anti")
    return ambiguous.select(*cols).unionByName(rest)
