"""Joins on keys that hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is crowded if it has more rows than LEAST and than all rows over MOST_KEYS; so there are MOST_KEYS of them at most.
LEAST, MOST_KEYS = 10_000, 5_000


def crowded_keys(rows: DataFrame, on: list[str], total: int) -> DataFrame | None:
    """on..., _fan: into how many parts to deal each crowded key; None if there
    is none. MOST_KEYS rows at most, so they may be broadcast."""
    most = max(LEAST, -(-total // MOST_KEYS))
    if total <= most:
        return None
    found = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    found = found.select(*on, F.ceil(F.col("_n") / most).cast("int").alias("_fan"))
    keys = found.collect()
    return rows.sparkSession.createDataFrame([tuple(r) for r in keys], found.schema) if keys else None


def dealt_join(many: DataFrame, one: DataFrame, on: list[str], crowded: DataFrame | None, salt: list[str]) -> DataFrame:
    """``many`` joined with ``one`` (a row for each key). Rows of crowded keys
    are dealt by a hash of ``salt`` over as many parts, to each of which the row of ``one`` is copied."""
    if crowded is None:
        return many.join(one, on)
    fan = F.broadcast(crowded)
    left = many.join(fan, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("_fan")).cast("int"), F.lit(0))).drop("_fan")
    right = one.join(fan, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))).drop("_fan")
    return left.join(right, [*on, "_part"]).drop("_part")
