"""Re-coding of trade rows with weights.

Re-coding is linear in the measures, so both measures and both weight tables
go through one join and one aggregate: the weight table is pivoted to a column for
each measure's weights, and the facts are read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.functions.codes import normalise_code
from vintage.operators.weights import STRATEGIES, assert_empty, finalise, missing_codes
from vintage.sources.storage import bucketed

MEASURES = ("VALUE_EUR", "QUANTITY_KG")
CODE = "PRODUCT_NC"
#: output -> measure and whose weights
WIDE = {f"{m}_w_{name}": (m, tag) for tag, name in (("VALUE_EUR", "value"), ("QUANTITY_KG", "quantity")) for m in MEASURES}


def with_year(trade: DataFrame) -> DataFrame:
    """Adds origin_year, also from YYYYMM periods, and normalises the code. A7"""
    return trade.withColumns({"origin_year": F.substring(F.col("PERIOD").cast("string"), 1, 4).cast("int"), CODE: normalise_code(F.col(CODE))})


def recode(trade: DataFrame, weights: DataFrame, measure: str, on: list[str], ids: list[str] | None = None, assume_identity: bool = True) -> DataFrame:
    """measure x weight by the new code and the id columns. A1, W5"""
    ids = ids or [c for c in trade.columns if c not in MEASURES]
    w = weights.select(*on, F.col("from_code").alias(CODE), "to_code", "weight")
    both = trade.join(w, [*on, CODE], "left" if assume_identity else "inner")
    code = F.coalesce("to_code", CODE).alias(CODE)
    return both.groupBy(*[i for i in ids if i != CODE], code).agg(F.sum(F.col(measure) * F.coalesce("weight", F.lit(1.0))).alias(measure))


def _pivoted(weights: DataFrame, on: list[str], tags: list[str], assume_identity: bool) -> DataFrame:
    """on..., code, to_code, w_<tag>...: a column of weights for each tag; a code
    that has weights of some tag only keeps itself under the others."""
    w = weights.where(F.col("measure").isin(tags)).select(*on, "measure", F.col("from_code").alias(CODE), "to_code", "weight")
    if assume_identity and len(tags) > 1:
        codes = w.groupBy(*on, CODE).agg(F.collect_set("measure").alias("has"))  # one or two names
        lacking = codes.withColumn("measure", F.explode(F.array_except(F.array(*map(F.lit, tags)), "has")))
        w = w.unionByName(lacking.select(*on, "measure", CODE, F.col(CODE).alias("to_code"), F.lit(1.0).alias("weight")))
    return w.groupBy(*on, CODE, "to_code").agg(*[F.sum(F.when(F.col("measure") == t, F.col("weight"))).alias(f"w_{t}") for t in tags])


def _weighted(trade: DataFrame, weights: DataFrame, on: list[str], outputs: dict[str, tuple[str, str]], assume_identity: bool) -> DataFrame:
    """Outputs (measure, tag of its weights) by the new code and the ids."""
    tags = sorted({t for _, t in outputs.values()})
    return recode_pivoted(trade, _pivoted(weights, on, tags, assume_identity), on, outputs, assume_identity)


def recode_pivoted(trade: DataFrame, pivoted: DataFrame, on: list[str], outputs: dict[str, tuple[str, str]], assume_identity: bool = True) -> DataFrame:
    """The same with weights that have a column for each tag (see
    ``store_for_recoding``): one join and one aggregate."""
    ids = [c for c in trade.columns if c not in MEASURES]
    both = trade.join(pivoted, [*on, CODE], "left" if assume_identity else "inner")
    same = F.col("to_code").isNull()
    return both.groupBy(*[i for i in ids if i != CODE], F.coalesce("to_code", CODE).alias(CODE)).agg(*[
        F.coalesce(F.sum(F.col(m) * F.when(same, 1.0).otherwise(F.coalesce(F.col(f"w_{t}"), F.lit(0.0)))), F.lit(0.0)).alias(name) for name, (m, t) in outputs.items()
    ])


def apply_strategy(trade: DataFrame, weights: DataFrame, strategy: str = "weights_split", assume_identity: bool = True, on: tuple[str, ...] = ("origin_year",)) -> DataFrame:
    """Each measure under the weights that the strategy names. A2, A5, W7

    ``weights`` has on..., measure, from_code, to_code, weight; they are
    finalised first, and bad ones refused. Without ``assume_identity`` a code
    that lacks weights is refused too (W6)."""
    by = STRATEGIES[strategy]
    return _apply(trade, weights, {m: (m, by[m]) for m in MEASURES}, assume_identity, list(on))


def apply_wide(trade: DataFrame, weights: DataFrame, assume_identity: bool = True, on: tuple[str, ...] = ("origin_year",)) -> DataFrame:
    """Both measures under value weights and under quantity weights, with the
    gates of ``apply_strategy``. A3, A5, A6"""
    return _apply(trade, weights, WIDE, assume_identity, list(on))


def store_for_recoding(trade: DataFrame, weights: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(facts, pivoted weights) as tables in equal buckets of (origin_year, code),
    sorted: ``recode_stored`` joins them bucket by bucket, without moving a row. Facts are laid
    out once and re-coded to any number of targets. S1, S2"""
    return store_facts(trade, buckets), store_weights(weights, buckets)


def store_facts(trade: DataFrame, buckets: int) -> DataFrame:
    """The facts of ``store_for_recoding``, which other steps may read too. S1"""
    return bucketed(trade, ["origin_year", CODE], buckets)


def store_weights(weights: DataFrame, buckets: int) -> DataFrame:
    """The pivoted weights of ``store_for_recoding``. S2"""
    final = finalise(weights.select("origin_year", "measure", "from_code", "to_code", "weight"), ["origin_year", "measure"])
    return bucketed(_pivoted(final, ["origin_year"], sorted(MEASURES), True), ["origin_year", CODE], buckets)


def recode_stored(facts: DataFrame, pivoted: DataFrame) -> DataFrame:
    """``apply_wide`` on stored tables. A3"""
    return recode_pivoted(facts, pivoted, ["origin_year"], WIDE)


def _apply(trade: DataFrame, weights: DataFrame, outputs: dict[str, tuple[str, str]], assume_identity: bool, on: list[str]) -> DataFrame:
    final = finalise(weights, [*on, "measure"])
    if not assume_identity:
        for tag in sorted({t for _, t in outputs.values()}):
            codes = trade.select(*on, F.col(CODE).alias("from_code"))
            assert_empty(missing_codes(codes, final.where(F.col("measure") == tag), on), f"codes without weights by {tag}")
    return _weighted(trade, final, on, outputs, assume_identity)


def identity_wide(trade: DataFrame) -> DataFrame:
    """Wide names for rows of the target year itself. A4"""
    ids = [c for c in trade.columns if c not in MEASURES]
    return trade.select(*ids, *[F.col(m).alias(f"{m}_w_{n}") for n in ("value", "quantity") for m in MEASURES])


def apply_summary(trade: DataFrame, recoded: DataFrame, weights: DataFrame, by: str = "PERIOD") -> DataFrame:
    """by, rows and codes in and out, sums, codes without weights. A8"""
    one = trade.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows_in"), F.countDistinct(CODE).alias("n_codes_in"), *[F.sum(m).alias(f"{m}_in") for m in MEASURES])
    cols = [c for c in recoded.columns if c.startswith(MEASURES)]
    two = recoded.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows_out"), F.countDistinct(CODE).alias("n_codes_out"), *[F.sum(c).alias(f"{c}_out") for c in cols])
    lacking = trade.select(by, "origin_year", F.col(CODE).alias("from_code")).distinct().join(weights.select("origin_year", "from_code").distinct(), ["origin_year", "from_code"], "left_anti")
    three = lacking.groupBy(by).agg(F.count(F.lit(1)).alias("n_codes_missing"))
    return one.join(two, by, "full").join(three, by, "left").na.fill(0)


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key, the last by ``order``. A9"""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def unaccepted(weights: DataFrame, revised: DataFrame, universe: DataFrame) -> DataFrame:
    """Revised origin codes that a chain lacks. A10"""
    w = weights.select("origin_year", "from_code").distinct()
    origin = F.when(F.col("direction") == "a_to_b", F.substring("period", 1, 4)).otherwise(F.substring("period", 5, 4)).cast("int")
    need = revised.select(origin.alias("year"), "code").distinct().join(universe, ["year", "code"], "left_semi")
    return need.select(F.col("year").alias("origin_year"), F.col("code").alias("from_code")).join(w, ["origin_year", "from_code"], "left_anti")


def conservation(trade: DataFrame, recoded: DataFrame, by: str = "PERIOD") -> DataFrame:
    """by, output, total_in, total_out, difference. A11"""
    cols = [c for c in recoded.columns if c.startswith(MEASURES)]
    out = recoded.groupBy(by).agg(*[F.sum(c).alias(c) for c in cols]).unpivot([by], cols, "output", "total_out")
    put = trade.groupBy(by).agg(*[F.sum(m).alias(m) for m in MEASURES]).unpivot([by], list(MEASURES), "measure", "total_in")
    out = out.withColumn("measure", F.when(F.col("output").startswith("VALUE_EUR"), "VALUE_EUR").otherwise("QUANTITY_KG"))
    both = out.join(put, [by, "measure"], "full")
    return both.select(by, "output", "total_in", "total_out", (F.coalesce("total_out", F.lit(0.0)) - F.coalesce("total_in", F.lit(0.0))).alias("difference"))


def conservation_summary(rows: DataFrame) -> DataFrame:
    """output, greatest and mean |difference|. A11"""
    return rows.groupBy("output").agg(F.max(F.abs("difference")).alias("max_abs"), F.avg(F.abs("difference")).alias("mean_abs"))


def recode_totals(totals: DataFrame, weights: DataFrame | None, on: list[str]) -> DataFrame:
    """on..., code, value by the new code, identity where a code has no weight;
    without weights the totals come back as they are. A12"""
    if weights is None:
        return totals
    w = weights.select(*on, F.col("from_code").alias("code"), "to_code", "weight")
    both = totals.join(w, [*on, "code"], "left")
    ids = [c for c in totals.columns if c not in ("code", "value")]
    return both.groupBy(*ids, F.coalesce("to_code", "code").alias("code")).agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(1.0))).alias("value"))
