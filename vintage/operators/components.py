"""Connected components of keyed graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.operators.skew import crowded_keys, dealt_join
from vintage.sources.storage import checkpointed

#: Links that a task labels at a time.
CHUNK = 1 << 18


def components(edges: DataFrame, key: list[str]) -> DataFrame:
    """key..., node, component for edges (key..., u, v): component is the least
    node that can be reached. All keys are labelled in one job.

    Links are sorted, and chunks of bounded size labelled where they lie; a node
    that several chunks hold links their labels. Those links alone, few where
    neighbours sort near each other, are labelled again: in one chunk if they fit, else in rounds.
    """
    rows = checkpointed(edges.select(*key, "u", "v").dropna())
    near = _by_chunk(rows.repartitionByRange(*key, "u", "v").sortWithinPartitions(*key, "u", "v"), key)
    near = checkpointed(near)
    nodes = near.groupBy(*key, "node").agg(F.min("component").alias("component"), F.max("component").alias("_most"))
    nodes = checkpointed(nodes)
    several = nodes.where("component <> _most").select(*key, "node", F.col("component").alias("v"))
    links = near.join(several, [*key, "node"]).where("component <> v").select(*key, F.col("component").alias("u"), "v").distinct()
    links = checkpointed(links)
    nodes, n_links = nodes.drop("_most"), links.count()
    if not n_links:
        return nodes
    roots = _by_chunk(links.coalesce(1), key) if n_links <= CHUNK else _in_rounds(links, key)
    roots = checkpointed(roots.select(*key, F.col("node").alias("component"), F.col("component").alias("_root")))
    linked = nodes.join(F.broadcast(roots.select(*key, "component")), [*key, "component"], "left_semi") if n_links <= CHUNK else nodes
    crowded = crowded_keys(linked, [*key, "component"], linked.count())
    found = dealt_join(linked, roots, [*key, "component"], crowded, ["node"]).select(*key, "node", F.col("_root").alias("component"))
    return checkpointed(found.unionByName(nodes.join(roots, [*key, "component"], "left_anti").select(*key, "node", "component")))


def _by_chunk(links: DataFrame, key: list[str]) -> DataFrame:
    """key..., node, component (the least node reached within the chunk), once for each chunk that holds the node."""
    fields, most = {f.name: f.dataType.simpleString() for f in links.schema}, CHUNK

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= most:
                yield _labelled(pd.concat(held, ignore_index=True), key)
                held, n = [], 0
        if n:
            yield _labelled(pd.concat(held, ignore_index=True), key)

    schema = ", ".join([*[f"{k} {fields[k]}" for k in key], "node string", "component string"])
    return links.mapInPandas(label, schema)


def _labelled(links: pd.DataFrame, key: list[str]) -> pd.DataFrame:
    """Least labels by hooking roots on smaller ones and jumping to the root."""
    both = pd.concat([links["u"], links["v"]], ignore_index=True)
    number, names = pd.factorize(both, sort=True)
    of, values = links.groupby(key, sort=False).ngroup().to_numpy(), links[key].drop_duplicates()
    at, place = np.unique(np.tile(of, 2) * len(names) + number, return_inverse=True)
    a, b = place[: len(links)], place[len(links) :]
    label = np.arange(len(at))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    names = np.asarray(names, object)
    return values.iloc[at // len(names)].reset_index(drop=True).assign(node=names[at % len(names)], component=names[at[label] % len(names)])


def _in_rounds(edges: DataFrame, key: list[str]) -> DataFrame:
    """The components of links that are too many for one chunk.

    A round takes the least label among the neighbours and then jumps to the
    label's own label, so rounds grow with the logarithm of the longest path.
    Only counts and crowded keys come to the driver: a hub's links, and the
    nodes of a giant component at the jump to its label, are dealt over several tasks.
    """
    both = edges.select(*key, "u", "v").union(edges.select(*key, F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = checkpointed(both)
    n_links = both.count()
    hubs = crowded_keys(both, [*key, "v"], n_links)
    labels = both.groupBy(*key, F.col("u").alias("node")).agg(F.min("v").alias("m")).select(*key, "node", F.least("node", "m").alias("component"))
    labels = checkpointed(labels)
    while True:
        near = dealt_join(both, labels.select(*key, F.col("node").alias("v"), "component"), [*key, "v"], hubs, ["u"])
        near = near.groupBy(*key, F.col("u").alias("node")).agg(F.min("component").alias("m"))
        new = labels.join(near, [*key, "node"]).select(*key, "node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        if n_links > 10_000:  # the table is read three times below
            new = checkpointed(new)
        jump = new.select(*key, F.col("node").alias("c"), F.col("c").alias("further"))
        giant = crowded_keys(new, [*key, "c"], n_links)
        new = dealt_join(new, jump, [*key, "c"], giant, ["node"])
        new = checkpointed(new.select(*key, "node", "old", F.least("c", "further").alias("component")))
        labels = new.drop("old")
        if new.where("old <> component").isEmpty():
            return labels
