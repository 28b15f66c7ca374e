"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.functions.codes import code_rejection, normalise_code, period_text, period_years, strict_code
from vintage.operators.weights import merge_ambiguous


def scan_year(spark: SparkSession, path: str, years: list[int], measure: str = "VALUE_EUR") -> DataFrame:
    """Pruned columns of a dataset partitioned by year. S1"""
    cols = ["REPORTER", "PARTNER", "TRADE_TYPE", "PRODUCT_NC", "FLOW", measure, "year"]
    return spark.read.parquet(path).where(F.col("year").isin(years)).select(*cols)


def scan_month(spark: SparkSession, path: str, period: int) -> DataFrame:
    """One month of a dataset partitioned by year and month. S2"""
    return spark.read.parquet(path).where((F.col("year") == period // 100) & (F.col("month") == period % 100))


def read_steps(spark: SparkSession, path: str, ambiguous_only: bool = False) -> DataFrame:
    """Adjacent weights stored with a kind column (ambiguous, deterministic);
    ambiguous ones win. S3, S4"""
    rows = spark.read.parquet(path)
    ambiguous = rows.where("kind = 'ambiguous'").drop("kind")
    if ambiguous_only:
        return ambiguous
    return merge_ambiguous(ambiguous, rows.where("kind = 'deterministic'").drop("kind"), ["period", "direction", "measure"])


def read_allow_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct normalised codes of a CSV column. S5"""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.where(F.col(column).isNotNull()).select(normalise_code(F.col(column)).alias("code")).where("code <> ''").distinct()


def ingest_concordance(raw: DataFrame, period: str = "Period", origin: str = "Origin code", destination: str = "Destination code") -> tuple[DataFrame, DataFrame]:
    """(edges, rejected rows with reasons) of a raw correspondence table. S6"""
    text = period_text(F.col(period))
    a, b = period_years(text)
    reason = F.when(text.isNull(), "bad period").otherwise(F.coalesce(code_rejection(F.col(origin)), code_rejection(F.col(destination))))
    good = raw.where(reason.isNull()).select(
        text.alias("period"), a.alias("vintage_a_year"), b.alias("vintage_b_year"),
        strict_code(F.col(origin)).alias("vintage_a_code"), strict_code(F.col(destination)).alias("vintage_b_code"),
    )
    bad = raw.where(reason.isNotNull()).select(F.col(period), F.col(origin), F.col(destination), reason.alias("reason"))
    return good.dropDuplicates(["period", "vintage_a_code", "vintage_b_code"]), bad


def write_recoded(df: DataFrame, path: str) -> None:
    """One partition for each target and origin; written ones are replaced. S7"""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target_year", "origin_year").parquet(path)


def append_diagnostics(df: DataFrame, path: str, run: str) -> None:
    """S8"""
    df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def available(periods: DataFrame, years: DataFrame) -> DataFrame:
    """Periods (period) whose two years (year) are both there. S9"""
    y = years.select(F.col("year").cast("int").alias("_y")).distinct()
    a, b = F.substring("period", 1, 4).cast("int"), F.substring("period", 5, 4).cast("int")
    return periods.join(y, a == F.col("_y"), "left_semi").join(y, b == F.col("_y"), "left_semi")


def pending(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned rows without a row in the summary of finished ones. S10"""
    return planned.join(done.select(*key).distinct(), key, "left_anti")
