"""Connected components over a table of links, for operators on pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import hot_keys, materialize, spread_join

#: Links that a task labels at a time.
CHUNK = 1 << 18


def _counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (u, v); component is the least
    id that can be reached.

    Links are sorted and dealt by ranges, and chunks of bounded size labelled where
    they lie. Only labels that an id of several chunks links are labelled again: in
    one chunk if they fit, else in rounds of joins. Tables stay in the shared folder;
    counts and hot keys come to the driver. A large component's ids are dealt over several tasks.
    """
    rows = links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    near = materialize(_by_chunk(rows.repartitionByRange("u", "v").sortWithinPartitions("u", "v")), "near")
    nodes = near.groupBy("id").agg(F.min("component").alias("component"), F.max("component").alias("most"))
    nodes = materialize(nodes, "labels")
    several = nodes.where("component <> most").select("id", F.col("component").alias("v"))
    apart = near.join(several, "id").where("component <> v").select(F.col("component").alias("u"), "v").distinct()
    apart, labels = materialize(apart, "links"), nodes.select("id", "component")
    n = apart.count()
    if not n:
        return labels
    roots = materialize(_by_chunk(apart.coalesce(1)), "roots") if n <= CHUNK else _in_rounds(apart)
    large = hot_keys(_counts(labels, "component"), ["component"], labels.count())
    roots = roots.select(F.col("id").alias("component"), F.col("component").alias("root"))
    found = spread_join(labels, roots, ["component"], large, ["id"], "left")
    return materialize(found.select("id", F.coalesce("root", "component").alias("component")), "labels")


def _by_chunk(links: DataFrame) -> DataFrame:
    """(id, component), the least id reached within the chunk, once for each chunk that holds the id."""
    most = CHUNK

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= most:
                yield _labelled(held)
                held, n = [], 0
        if n:
            yield _labelled(held)

    return links.mapInPandas(label, "id long, component long")


def _labelled(held: list[pd.DataFrame]) -> pd.DataFrame:
    """Least labels by hooking roots on smaller ones and jumping to the root."""
    ends = np.concatenate([b[c].to_numpy() for c in ("u", "v") for b in held])
    ids, place = np.unique(ends, return_inverse=True)
    a, b = np.split(place, 2)
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return pd.DataFrame({"id": ids, "component": ids[label]})
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _in_rounds(links: DataFrame) -> DataFrame:
    """The components of links that are too many for one chunk.

    Each round takes the least label among the neighbours and then jumps to the
    label's own label, so the rounds grow with the logarithm of a chain's
    length. Labels are written to the shared folder as they change; only
    one sum comes to the driver, to see whether anything did. Hubs and the
    labels of large components are hot keys of the joins, and are dealt out.
    """
    both = links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct()
    both = materialize(both, "links")
    hubs = hot_keys(_counts(both, "v"), ["v"], both.count())
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), "labels")
    n, before = labels.count(), None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now is None or now == before:
            return labels
        before = now
        shared = hot_keys(_counts(labels, "component"), ["component"], n)
        own = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        jumped = spread_join(labels, own, ["component"], shared, ["id"])
        jumped = materialize(jumped.select("id", F.least("component", "further").alias("component")), "labels")
        near = spread_join(both, jumped.withColumnRenamed("id", "v"), ["v"], hubs, ["u"]).groupBy("u").agg(F.min("component").alias("m"))
        labels = materialize(jumped.join(near, jumped.id == near.u).select("id", F.least("component", "m").alias("component")), "labels")
