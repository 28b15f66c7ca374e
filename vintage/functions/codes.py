"""Column expressions on codes, periods and labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = {"VALUE_EUR": "VALUE_EUR", "QUANTITY_KG": "QUANTITY_KG"}


def normalise_code(code: Column) -> Column:
    """Trimmed, without inner spaces, digits padded to 8 (never cut). N1"""
    bare = F.replace(F.trim(code.cast("string")), F.lit(" "), F.lit(""))
    return F.when(bare.rlike("^[0-9]+$") & (F.length(bare) < 8), F.lpad(bare, 8, "0")).otherwise(bare)


def period_text(period: Column) -> Column:
    """Eight digits YYYYYYYY, a trailing ".0" dropped; null if invalid. N2"""
    bare = F.regexp_replace(F.trim(period.cast("string")), r"\.0$", "")
    return F.when(bare.rlike("^[0-9]{8}$"), bare)


def period_years(period: Column) -> tuple[Column, Column]:
    return F.substring(period, 1, 4), F.substring(period, 5, 4)


def code_rejection(code: Column) -> Column:
    """Why a concordance code is refused; null if it is good. N3"""
    bare = F.regexp_replace(F.trim(code.cast("string")), r"\.0$", "")
    return (
        F.when(code.isNull() | (bare == ""), "missing")
        .when(bare.rlike(r"^[0-9]+\.[0-9]+$"), "not an integer")
        .when(~bare.rlike("^[0-9]+$"), "not digits")
        .when(F.length(bare) > 8, "too long")
    )


def strict_code(code: Column) -> Column:
    """The padded code, or null where ``code_rejection`` says why. N3"""
    bare = F.regexp_replace(F.trim(code.cast("string")), r"\.0$", "")
    return F.when(code_rejection(code).isNull(), F.lpad(bare, 8, "0"))


def is_year(year: Column) -> Column:
    """N4"""
    return F.coalesce(year.cast("string").rlike("^[0-9]{4}$"), F.lit(False))


def chain_steps(spark: SparkSession, origin: int, target: int) -> DataFrame:
    """step_index, period, direction, source_year, target_year. N5"""
    schema = "step_index int, period string, direction string, source_year int, target_year int"
    if origin == target:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(
        F.posexplode(F.sequence(F.lit(origin), F.lit(target - 1 if target > origin else target + 1))).alias("step_index", "source_year")
    ).select(
        "step_index",
        (F.concat(F.col("source_year"), F.col("source_year") + 1) if target > origin else F.concat(F.col("source_year") - 1, F.col("source_year"))).alias("period"),
        F.lit("a_to_b" if target > origin else "b_to_a").alias("direction"),
        "source_year",
        (F.col("source_year") + (1 if target > origin else -1)).alias("target_year"),
    )


def measure_column(measure: str) -> str:
    """N6, one measure"""
    name = measure.strip().upper()
    if name not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known: {', '.join(MEASURES)}")
    return MEASURES[name]


def by_measure(df: DataFrame, measures: Iterable[str] = tuple(MEASURES)) -> DataFrame:
    """Rows (..., measure, value) instead of measure columns. N6"""
    names = [measure_column(m) for m in measures]
    ids = [c for c in df.columns if c not in MEASURES.values()]
    return df.unpivot(ids, names, "measure", "value")


def not_in(column: Column, values: Iterable[str]) -> Column:
    """Null-safe "not one of": a null is kept. N7, N8"""
    values = list(values)
    return F.coalesce(~column.isin(values), F.lit(True)) if values else F.lit(True)


def flow_is(code: str) -> Column:
    """N9"""
    return F.col("FLOW").cast("string") == code


def relationship(n_focal: Column, n_other: Column) -> Column:
    """N10"""
    return F.when((n_focal == 1) & (n_other == 1), "1:1").when(n_focal == 1, "1:n").when(n_other == 1, "m:1").otherwise("m:n")


def unknown_weight(kind: Column, direction: Column) -> Column:
    """N11"""
    return F.when(direction == "a_to_b", kind.isin("1:n", "m:n")).otherwise(kind.isin("m:1", "m:n"))


def panel_label(x_year: Column, target: Column) -> Column:
    """Pair (x, x + 1) around the revision target - 1 -> target + ..."""
    return F.when(x_year == target - 1, "pre_immediate").when(x_year == target, "break").when(x_year == target + 1, "post_immediate")


def pair_key(*columns: str) -> Column:
    """N13"""
    return F.concat_ws("|", *columns)


def coefficient_cell(coef: Column, se: Column) -> Column:
    """N14"""
    return F.format_string("%.3f (%.3f)", coef, se)
