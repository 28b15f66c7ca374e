"""Chaining of adjacent weight tables.

``steps`` has period, direction, measure, from_code, to_code, weight for all
steps; the chain itself is a loop over years (a fold does not commute with the
carry rule), and every measure and origin is in each of its joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.operators.weights import assert_empty, finalise, row_sum_deviation
from vintage.sources.storage import checkpointed

LINK = ["measure", "from_code", "to_code", "weight"]


@dataclass
class Chained:
    weights: DataFrame  # origin_year, target_year, direction, measure, from_code, to_code, weight
    diagnostics: DataFrame
    unresolved: DataFrame


def period_of(source: int, target: int) -> tuple[str, str]:
    return (f"{source}{target}", "a_to_b") if target > source else (f"{target}{source}", "b_to_a")


def complete_step(step: DataFrame, codes: DataFrame, revised: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The step (measure, from_code, to_code, weight) with identity for codes
    (measure, code) that it lacks; codes of ``revised`` (code) are left out and
    returned as unresolved. C1"""
    lacking = codes.withColumnRenamed("code", "from_code").join(step.select("measure", "from_code").distinct(), ["measure", "from_code"], "left_anti")
    if revised is None:
        bad = lacking.limit(0)
    else:
        bad = lacking.join(revised.select(F.col("code").alias("from_code")).distinct(), "from_code", "left_semi")
        lacking = lacking.join(revised.select(F.col("code").alias("from_code")).distinct(), "from_code", "left_anti")
    same = lacking.select("measure", "from_code", F.col("from_code").alias("to_code"), F.lit(1.0).alias("weight"))
    return step.select(*LINK).unionByName(same), bad.select("measure", F.col("from_code").alias("code"))


def compose(left: DataFrame, right: DataFrame, revised: DataFrame | None = None, key: tuple[str, ...] = ("measure",)) -> tuple[DataFrame, DataFrame]:
    """left . right over the code in the middle; middles that ``right`` lacks
    are carried as they are, unless revised: those are unresolved. C2"""
    key = list(key)
    r = right.select(*key, F.col("from_code").alias("mid"), F.col("to_code").alias("last"), F.col("weight").alias("w"))
    both = left.withColumnRenamed("to_code", "mid").join(r, [*key, "mid"], "left")
    if revised is None:
        bad = left.select(*key, F.col("to_code").alias("code")).limit(0)
    else:
        marked = revised.select(F.col("code").alias("mid"), F.lit(True).alias("_revised")).distinct()
        both = both.join(marked, "mid", "left")
        gone = F.col("last").isNull() & F.col("_revised").isNotNull()
        bad = both.where(gone).select(*key, F.col("mid").alias("code")).distinct()
        both = both.where(~gone)
    to = F.coalesce("last", "mid").alias("to_code")
    ids = [c for c in left.columns if c not in ("to_code", "weight")]
    return both.groupBy(*ids, to).agg(F.sum(F.col("weight") * F.coalesce("w", F.lit(1.0))).alias("weight")), bad


def _step(steps: DataFrame, source: int, target: int) -> DataFrame:
    period, direction = period_of(source, target)
    return steps.where((F.col("period") == period) & (F.col("direction") == direction)).select(*LINK)


def _revised(revised: DataFrame | None, source: int, target: int) -> DataFrame | None:
    period, direction = period_of(source, target)
    return None if revised is None else revised.where((F.col("period") == period) & (F.col("direction") == direction)).select("code")


def _codes(universe: DataFrame, year: int, measures: list[str]) -> DataFrame:
    names = universe.sparkSession.createDataFrame([(m,) for m in measures], "measure string")
    return universe.where(F.col("year") == year).select("code").distinct().crossJoin(F.broadcast(names)).select("measure", "code")


def _tag(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def chain_origin(steps: DataFrame, universe: DataFrame, origin: int, target: int, measures: list[str], revised: DataFrame | None = None, final: bool = False) -> Chained:
    """One origin, folded from the left: what an early step carries a later
    step may still map. C3"""
    sign = 1 if target >= origin else -1
    codes = _codes(universe, origin, measures)
    now = None
    bad, diag = None, None
    for i, year in enumerate(range(origin, target, sign)):
        step, gone = complete_step(_step(steps, year, year + sign), _codes(universe, year, measures), _revised(revised, year, year + sign))
        before = step if now is None else now
        rows = gone.withColumn("reason", F.lit("step_missing_revised"))
        if now is None:
            now = step
        else:
            now, lost = compose(now, step, _revised(revised, year, year + sign))
            rows = rows.unionByName(lost.withColumn("reason", F.lit("missing_mid_revised")))
        now = checkpointed(now)
        period, direction = period_of(year, year + sign)
        rows = _tag(rows, period=period, step_index=i)
        bad = rows if bad is None else bad.unionByName(rows)
        d = _tag(step_diagnostics(before, step, now), period=period, step_index=i)
        diag = d if diag is None else diag.unionByName(d)
    direction = "identity" if origin == target else "a_to_b" if sign > 0 else "b_to_a"
    if now is None:
        now = codes.select("measure", F.col("code").alias("from_code"), F.col("code").alias("to_code"), F.lit(1.0).alias("weight"))
    if final:
        now = finalise(now, ["measure"])
    tags = {"origin_year": origin, "target_year": target, "direction": direction}
    return Chained(_tag(now, **tags), _tag(diag, **tags) if diag is not None else None, _tag(bad, **tags) if bad is not None else None)


def chain_range(steps: DataFrame, universe: DataFrame, first: int, last: int, target: int, measures: list[str], revised: DataFrame | None = None, final: bool = True, ready: dict[int, DataFrame] | None = None) -> Chained:
    """Every year of first..last to the target, folded from the right: a year
    reuses the chain of the year next to it. Chains of ``ready`` (origin -> LINK) are taken
    as they are; the result has the others only. C4, C5"""
    ready = ready or {}
    weights, bad, diag = None, None, None

    def add(new: DataFrame | None, old: DataFrame | None) -> DataFrame | None:
        return new if old is None else old if new is None else old.unionByName(new)

    codes = _codes(universe, target, measures)
    same = codes.select("measure", F.col("code").alias("from_code"), F.col("code").alias("to_code"), F.lit(1.0).alias("weight"))
    if first <= target <= last and target not in ready:
        weights = _tag(same, origin_year=target, target_year=target, direction="identity")
    for sign, years in ((1, range(target - 1, first - 1, -1)), (-1, range(target + 1, last + 1))):
        later = None
        for year in years:
            if year in ready:
                later = ready[year]
                continue
            own_revised = _revised(revised, year, year + sign)
            step, gone = complete_step(_step(steps, year, year + sign), _codes(universe, year, measures), own_revised)
            if later is None:
                now, lost = step, None
            else:
                now, lost = compose(step, later, _revised(revised, year + sign, year + 2 * sign))
            now = checkpointed(now)
            period, direction = period_of(year, year + sign)
            tags = {"origin_year": year, "target_year": target, "direction": direction}
            bad = add(_tag(gone, reason="step_missing_revised", period=period, step_index=0, **tags), bad)
            if lost is not None:
                bad = add(_tag(lost, reason="missing_mid_revised", period=period_of(year + sign, year + 2 * sign)[0], step_index=1, **tags), bad)
            diag = add(_tag(step_diagnostics(later if later is not None else step, step, now), period=period, step_index=abs(year - target) - 1, **tags), diag)
            if year <= last and year >= first:
                weights = add(_tag(now, **tags), weights)
            later = now
    if final and weights is not None:
        weights = finalise(weights, ["origin_year", "target_year", "direction", "measure"])
    return Chained(weights, diag, bad)


def step_diagnostics(before: DataFrame, step: DataFrame, after: DataFrame) -> DataFrame:
    """measure, rows and codes in and out, deviation. C6"""
    one = before.groupBy("measure").agg(F.count(F.lit(1)).alias("n_rows_in"), F.countDistinct("from_code").alias("n_from_in"))
    two = step.groupBy("measure").agg(F.count(F.lit(1)).alias("n_rows_step"))
    three = after.groupBy("measure").agg(F.count(F.lit(1)).alias("n_rows_out"), F.countDistinct("from_code").alias("n_from_out"))
    return one.join(two, "measure", "full").join(three, "measure", "full").join(row_sum_deviation(after, ["measure"]), "measure", "left").na.fill(0)


def assert_complete(chained: Chained, universe: DataFrame, row_sum_tol: float = 1e-6) -> None:
    """Gate of a chain before use: no unresolved revised codes, no origin code
    without a chain, rows that sum to one. C6-C8"""
    if chained.unresolved is not None:
        assert_empty(chained.unresolved, "revised codes without weights")
    assert_empty(uncovered(chained, universe), "codes without a chain")
    keys = ["origin_year", "target_year", "direction", "measure"]
    assert_empty(row_sum_deviation(chained.weights, keys).where(F.col("deviation") > row_sum_tol), "chained rows that do not sum to one")


def uncovered(chained: Chained, universe: DataFrame) -> DataFrame:
    """Origin codes without a chain. C8"""
    w = chained.weights
    keys = w.select("origin_year", "target_year", "direction", "measure").distinct()
    want = universe.select(F.col("year").alias("origin_year"), F.col("code").alias("from_code")).join(keys, "origin_year")
    return want.join(w, ["origin_year", "target_year", "direction", "measure", "from_code"], "left_anti")
