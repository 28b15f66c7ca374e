"""Stored chains that know what they were made from.

A chain is a function of the steps between its origin and the target, of the codes
seen in these years, and of the revised codes that are refused. Each of them has an
order-free fingerprint (row count and sum of row hashes), and a chain's address is
a hash over the fingerprints from the target outwards. Stored rows carry the
address, so an origin's chain and its address are swapped in together by one
partition overwrite; only origins whose address has changed are built again, each on
the chain next to it, be that stored or new.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.operators.chain import LINK, Chained, chain_range, period_of
from vintage.sources.storage import checkpointed, exists

CHAIN = ["origin_year", "target_year", "direction", *LINK]


def fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, sum of row hashes: equal for equal rows in any order."""
    rest = sorted(c for c in rows.columns if c not in by)
    hashes = F.sum(F.xxhash64(*rest).cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), hashes.alias("hash"))


def addresses(steps: DataFrame, universe: DataFrame, first: int, last: int, target: int, measures: list[str], revised: DataFrame | None = None) -> dict[int, str]:
    """origin -> address of its chain. Few rows come to the driver: one a step and year."""
    steps = steps.where(F.col("measure").isin(measures)).select("period", "direction", *LINK)
    of = {("step", r.period, r.direction): (r.n, str(r.hash)) for r in fingerprints(steps, ["period", "direction"]).collect()}
    of |= {("codes", r.year): (r.n, str(r.hash)) for r in fingerprints(universe.select("year", "code").distinct(), ["year"]).collect()}
    if revised is not None:
        of |= {("revised", r.period, r.direction): (r.n, str(r.hash)) for r in fingerprints(revised.select("period", "direction", "code").distinct(), ["period", "direction"]).collect()}
    start = hashlib.sha256(repr((sorted(measures), of.get(("codes", target)), revised is not None)).encode()).hexdigest()
    out = {target: start}
    for sign, years in ((1, range(target - 1, first - 1, -1)), (-1, range(target + 1, last + 1))):
        before = start
        for y in years:
            step = period_of(y, y + sign)
            before = hashlib.sha256(repr((before, of.get(("step", *step)), of.get(("codes", y)), of.get(("revised", *step)))).encode()).hexdigest()
            out[y] = before
    return {y: a for y, a in out.items() if first <= y <= last}


def stored(spark, path: str, target: int) -> DataFrame | None:
    """The store's chains to a target, with their addresses."""
    return spark.read.parquet(path).where(F.col("target_year") == target) if exists(spark, path) else None


def refresh(path: str, steps: DataFrame, universe: DataFrame, first: int, last: int, target: int, measures: list[str], revised: DataFrame | None = None) -> tuple[DataFrame, list[int], Chained | None]:
    """(chains, origins built, what they were built with): the chains of
    first..last to the target, after those of other addresses than wanted were built
    and swapped in. Not finalised."""
    spark = steps.sparkSession
    want = addresses(steps, universe, first, last, target, measures, revised)
    there = stored(spark, path, target)
    have = {r.origin_year: r.address for r in there.select("origin_year", "address").distinct().collect()} if there is not None else {}
    built = sorted(y for y, a in want.items() if have.get(y) != a)
    made = None
    if built:
        ready = {y: there.where(F.col("origin_year") == y).select(*LINK) for y in want if y not in built}
        made = chain_range(steps, universe, first, last, target, measures, revised, final=False, ready=ready)
        names = spark.createDataFrame([(y, want[y]) for y in built], "origin_year int, address string")
        new = made.weights.select(*CHAIN).join(F.broadcast(names), "origin_year")
        new = checkpointed(new)  # rests on partitions that are about to be replaced
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target_year", "origin_year").parquet(path)
    out = spark.read.parquet(path).where((F.col("target_year") == target) & F.col("origin_year").between(first, last))
    return out.select(*CHAIN), built, made
