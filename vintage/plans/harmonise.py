"""Estimate, chain, apply: the composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.operators import apply, chain, chain_store, concordance, estimation
from vintage.operators.weights import assert_empty, finalise, invalid, missing_codes
from vintage.sources.storage import checkpointed

KEYS = ["origin_year", "target_year", "direction", "measure"]


def harmonise(
    trade: DataFrame, edges: DataFrame, target: int, first: int, last: int, measures: tuple[str, ...] = ("VALUE_EUR", "QUANTITY_KG"),
    steps: DataFrame | None = None, chains: DataFrame | None = None, strict: bool = False, assume_identity: bool = True,
    do_apply: bool = True, flow: str = "1", store: str | None = None,
) -> dict[str, DataFrame]:
    """Every stage can be skipped by giving its result (``steps``, ``chains``)
    or switched off. Returns the tables that were made. With a ``store`` (a path),
    chains are kept there, and only those whose steps or codes have changed since are
    built again; ``out["built"]`` lists their origins. Z1-Z3, Z5-Z7, S10

    Refused, with an error that names some rows: years of links that do not
    follow each other, unsolved fits, weights that cannot be finalised, origin
    codes that a chain lacks and, if ``strict``, revised codes without a step
    or chain; origins and measures without any weights; and, unless identity
    is assumed, codes of the facts without weights."""
    assert_empty(concordance.nonadjacent(edges), "links between years that do not follow each other")
    out: dict[str, DataFrame] = {}
    groups = concordance.build_groups(edges)
    out["groups"] = groups.summary
    universe = checkpointed(concordance.code_universe(trade))
    revised = checkpointed(concordance.revised_codes(groups)) if strict else None
    if chains is None:
        if steps is None:
            made = estimation.estimate(trade, groups, measures, flow)
            out |= {k: made[k] for k in ("diagnostics", "summary")}
            steps = checkpointed(made["weights"])
        out["steps"] = steps
        if store is None:
            made = chain.chain_range(steps, universe, first, last, target, list(measures), revised, final=False)
            chains = made.weights
        else:
            chains, built, made = chain_store.refresh(store, steps, universe, first, last, target, list(measures), revised)
            out["built"] = trade.sparkSession.createDataFrame([(y,) for y in built], "origin_year int")
        if made is not None:
            out |= {"chain_diagnostics": made.diagnostics, "unresolved": made.unresolved}
        whole = chain.Chained(chains, None, made.unresolved if made is not None else None)
        chain.assert_complete(whole, universe)
    chains = checkpointed(finalise(chains, KEYS))
    assert_empty(invalid(chains, KEYS), "chained weights that are not valid")
    out["chains"] = chains
    if do_apply:
        rows = apply.with_year(trade).where(F.col("origin_year").between(first, last))
        origins = [r[0] for r in universe.where(F.col("year").between(first, last)).select("year").distinct().collect()]
        assert_empty(missing_weights(chains, origins, list(measures)), "origins and measures without weights")
        if strict:
            steps_of = F.when(F.col("direction") == "a_to_b", F.substring("period", 1, 4).cast("int") < target).otherwise(F.substring("period", 5, 4).cast("int") > target)
            assert_empty(apply.unaccepted(chains, revised.where(steps_of), universe.where(F.col("year").between(first, last))), "revised codes that a chain lacks")
        out["recoded"] = checkpointed(apply.apply_wide(rows, chains, assume_identity))
        out["apply_summary"] = apply.apply_summary(rows, out["recoded"], chains)
        out["conservation"] = apply.conservation(rows, out["recoded"])
    return out


def missing_weights(chains: DataFrame, origins: list[int], measures: list[str]) -> DataFrame:
    """Requested origins and measures without weights. Z4"""
    spark = chains.sparkSession
    want = spark.createDataFrame([(o, m) for o in origins for m in measures], "origin_year int, measure string")
    return want.join(chains.select("origin_year", "measure").distinct(), ["origin_year", "measure"], "left_anti")


def missing_codes_of(trade: DataFrame, chains: DataFrame) -> DataFrame:
    rows = apply.with_year(trade).select("origin_year", F.col("PRODUCT_NC").alias("from_code"))
    return missing_codes(rows, chains, ["origin_year"])
