"""Operator 6: near-duplicate documents by circulant MinHash.

A document is its set of word shingles (``size`` words, A-Z lower-cased).
Shingles are hashed to a universe of 2**20 places and dealt by a permutation;
coordinate k of the signature is the least value that a second permutation,
shifted circularly by k, gives to the set: two permutations make all
coordinates. ``BANDS`` bands of ``ROWS`` coordinates name buckets.

Equal sets are one class from the start, so a group of copies is one node: a
class is named by the size and a cryptographic digest (BLAKE2b, 128 bits) of the
sorted set, for which no two different inputs are known to agree. In a bucket, not all pairs are tried:

1. every member against the least member;
2. members not yet connected to a member picked by a hash of bucket and member,
   another one in each bucket, against it;
3. what is then still in different components of a bucket, all of it, so that
   no link is lost to the short cuts: pair by pair in small buckets; in large
   ones block against block, each two blocks in a task that returns links only.

Each link is confirmed on the full sets: ``100 * |A & B| >= percent * |A | B|``.
Links, components and signatures stay in tables; none comes to the driver.
A link of similarity 0.8 is missed by all 40 bands of 6 with probability
(1 - 0.8**6)**40, about 5e-6.

Keys that hold many rows (the representative of a large group, a large
component, the digest of many copies) are dealt over several tasks in each join.
The universe holds 2**20 places: texts of near a million different shingles
fill it, have nearly equal signatures, and are then all compared, exactly.

Edge cases: null or wordless text has an empty set and is linked with nothing;
fewer words than ``size`` make one shingle; texts of any length are read whole;
rows with equal ids and texts are one class and all kept or dropped together; ids
that repeat with other texts are rows of their own; a null id never wins over
another id, and a component of null ids only has a null component and is kept;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.common import exact, hot_keys, materialize, mix, shingle_hashes, spread_join, table, word_hashes
from vintage.llm.graph import components

BANDS, ROWS = 40, 6
UNIVERSE = 1 << 20
#: Buckets of up to FEW members are compared pair by pair, larger ones in blocks
#: of about BLOCK members or BLOCK_SHINGLES shingles.
FEW, BLOCK, BLOCK_SHINGLES = 8, 256, 1 << 21


class Permutations:
    """The dealing permutation, and the second one as a view whose row i holds
    its values at i, i - 1, ..., all taken modulo the universe."""

    def __init__(self, coordinates: int, seed: int = 20) -> None:
        rng = np.random.default_rng(seed)
        self.deal = rng.permutation(UNIVERSE).astype(np.int32)
        second = rng.permutation(UNIVERSE).astype(np.int32)
        wrapped = np.concatenate([second[-(coordinates - 1) :], second])
        self.shifted = np.lib.stride_tricks.sliding_window_view(wrapped, coordinates)

    def signature(self, shingles: np.ndarray, at_once: int = 4096) -> np.ndarray:
        place = self.deal[(shingles >> np.uint64(44)).astype(np.int64)]
        least = self.shifted[place[:at_once]].min(axis=0)
        for s in range(at_once, len(place), at_once):
            least = np.minimum(least, self.shifted[place[s : s + at_once]].min(axis=0))
        return least


_made: dict[int, Permutations] = {}


def _permutations(coordinates: int) -> Permutations:
    if coordinates not in _made:
        _made[coordinates] = Permutations(coordinates)
    return _made[coordinates]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not text:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(word_hashes(np.frombuffer(text.encode(), np.uint8))[0], size))


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        with np.errstate(over="ignore"):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return key.view(np.int64)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())


SET = ["n", "digest_a", "digest_b"]


def signatures(df: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash, n (shingles), digest_a, digest_b and bands of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = _permutations(BANDS * ROWS)
        for b in batches:
            rows = []
            for t in b["_text"]:
                s = shingle_set(t, size)
                rows.append((len(s), *set_digest(s), band_keys(make.signature(s)) if len(s) else []))
            out = pd.DataFrame(rows, columns=[*SET, "bands"])
            out.insert(0, key, b[key].array)
            out.insert(1, "text_hash", b["text_hash"].array)
            yield out

    src, kind, back = exact(df.select(F.col(key), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text")), [key])
    return back(src.mapInPandas(run, kind + ", text_hash long, n long, digest_a long, digest_b long, bands array<long>"))


def shingle_sets(df: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of rows (node, text), one row for each node of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            b = b[~(b["node"].isin(seen) | b["node"].duplicated())]
            seen.update(b["node"])
            for s in range(0, len(b), 1000):
                some = b.iloc[s : s + 1000]
                yield pd.DataFrame({"node": some["node"], "shingles": [shingle_set(t, size).view(np.int64) for t in some["text"]]})

    return df.select("node", "text").mapInPandas(run, "node long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. ``pairs`` is a
    written table: it is read to find its hot members."""
    n, both = pairs.count(), pairs
    for side, other, name in (("u", "v", "a"), ("v", "u", "b")):
        hot = hot_keys(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_c")), [side], n)
        both = spread_join(both, sets.select(F.col("node").alias(side), F.col("shingles").alias(name)), [side], hot, [other])
    common = F.size(F.array_intersect("a", "b"))
    return both.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v").distinct()


def common_counts(sets: list[np.ndarray], at_once: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets, as a matrix."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[which]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for s in range(0, len(shared), at_once):
        lo, hi = np.searchsorted(column, [s, s + at_once])
        part = np.zeros((len(sets), min(at_once, len(shared) - s)), np.float32)
        part[owner[lo:hi], column[lo:hi] - s] = 1
        out += part @ part.T
    return out


def dealt_blocks(placed: DataFrame, percent: int) -> DataFrame:
    """bucket, size_class, i, j, node, part, n: which members of large buckets
    meet in which task.

    Sets whose sizes are too far apart cannot be linked, so a member meets only
    its own class of sizes and the next one (bounds of classes stand in the
    ratio that ``percent`` allows, so linked sets are never further apart). Each
    class with the next is cut into blocks of about BLOCK members or BLOCK_SHINGLES
    shingles, whichever are more, and each two of its blocks are a task's work. So
    a set is copied once for each block of its own class and of a neighbour."""
    own = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n")
    met = placed.select("bucket", "node", "part", "n", own.alias("own_class"))
    met = met.withColumn("size_class", F.explode(F.array(F.col("own_class") - 1, "own_class")))
    sums = met.groupBy("bucket", "size_class").agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("own_class").alias("least_class"), F.count(F.lit(1)).alias("_c"),
    )
    # a class with none of its own but the next one's members is compared there
    sums = materialize(sums.where("lo <> hi AND least_class = size_class"), "blocks")
    large = hot_keys(sums, ["bucket", "size_class"], sums.agg(F.sum("_c")).first()[0] or 0)
    dealt = spread_join(met, sums.select("bucket", "size_class", "blocks"), ["bucket", "size_class"], large, ["node"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("bucket", "size_class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "part", "n")


def compare_blocks(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different parts of large buckets: each two blocks of
    ``dealt_blocks`` are compared in a task of their own, which gives back the
    links alone. A pair that two tasks see is one link."""
    task = ["bucket", "size_class", "i", "j"]
    dealt = dealt_blocks(placed, percent).drop("n")

    def links(part: pd.DataFrame) -> pd.DataFrame:
        own = [np.asarray(s) for s in part["shingles"]]
        size = np.array([len(s) for s in own], np.int64)
        both = common_counts(own).astype(np.int64)
        near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        apart = part["part"].to_numpy()[:, None] < part["part"].to_numpy()[None, :]
        u, v = np.nonzero(near & apart)
        node = part["node"].to_numpy()
        return pd.DataFrame({"u": node[u], "v": node[v]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            last = (held[task] == held[task].iloc[-1]).all(axis=1)
            for _, part in held[~last].groupby(task, sort=False):
                yield links(part)
            held = held[last]
        if held is not None and len(held):
            yield links(held)

    full = dealt.join(sets, "node").repartition(*task).sortWithinPartitions(*task)
    found = full.mapInPandas(run, "u long, v long")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash (xxhash64 of the text), n_shingles, component_id (least
    key that can be reached) and kept (it is that key and the row is of the text
    that has it there) of every row of ``df``."""
    rows = materialize(signatures(df, size, key, text), "signatures")
    least = F.min(F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("key"), "text_hash"))
    classes = rows.where("n > 0").groupBy(*SET).agg(least.alias("least"), F.count(F.lit(1)).alias("_c"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    shared = materialize(shared, "buckets")
    crowded = hot_keys(shared, ["bucket"], shared.agg(F.sum("_c")).first()[0] or 0)
    members = materialize(spread_join(members, shared.select("bucket", "first"), ["bucket"], crowded, ["node"]), "members")

    def fits(a, b):
        """Sets of sizes a and b can be similar enough at all."""
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    pairs = members.where((F.col("node") != F.col("first.node")) & fits(F.col("n"), F.col("first.n")))
    pairs = pairs.select(F.col("first.node").alias("u"), F.col("node").alias("v")).distinct()
    pairs = materialize(pairs, "pairs")
    # full sets, of one text for each class that shares a bucket: its least key and that row's text
    own = ["_null", "_key", "text_hash"]
    holders = members.select("node").distinct().join(classes.select("node", "least"), "node")
    holders = holders.select("node", F.col("least.no").alias("_null"), F.coalesce(F.col("least.key").cast("string"), F.lit("")).alias("_key"), F.col("least.text_hash").alias("text_hash"))
    texts = df.select(F.col(key).isNull().alias("_null"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    # rows of equal id and text meet in one task; where a skewed one is split, a set may come twice, which changes no link
    holding = texts.where(F.length("text") > 0).join(holders, own)
    sets = materialize(shingle_sets(holding, size), "sets")

    links = materialize(confirm(pairs, sets, percent), "links")
    found = components(links)
    for last in (False, True):
        placed = members.join(found.withColumnRenamed("id", "node"), "node", "left")
        placed = placed.select("bucket", "node", "n", F.coalesce("component", "node").alias("part"))
        open_ = placed.groupBy("bucket").agg(
            F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("m"),
            F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), "node", "n", "part")).alias("first"),
        ).where("lo <> hi")
        placed = materialize(spread_join(placed, open_.select("bucket", "first", "m"), ["bucket"], crowded, ["node"]), "open")
        if last:
            few = placed.where(F.col("m") <= FEW)
            other = few.select("bucket", F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("part").alias("part_v"))
            pairs = few.join(other, "bucket").where((F.col("part") < F.col("part_v")) & fits(F.col("n"), F.col("n_v")))
            pairs = pairs.select(F.col("node").alias("u"), "v")
        else:
            pairs = placed.where((F.col("part") != F.col("first.part")) & fits(F.col("n"), F.col("first.n")))
            pairs = pairs.select(F.col("first.node").alias("u"), F.col("node").alias("v"))
        pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
        new = confirm(pairs, sets, percent)
        if last:
            new = new.union(compare_blocks(placed.where(F.col("m") > FEW), sets, percent))
        new = materialize(new, "links")
        if not new.isEmpty():
            links = links.union(new)
            found = components(links)

    named = classes.select(*SET, "node", "least", "_c").join(found.withColumnRenamed("id", "node"), "node", "left")
    named = materialize(named.select(*SET, "least", "_c", F.coalesce("component", "node").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("first"))
    large = hot_keys(named.groupBy("component").agg(F.count(F.lit(1)).alias("_c")), ["component"], named.count())
    named = materialize(spread_join(named, smallest, ["component"], large, SET).select(*SET, "_c", "first"), "named")
    copied = hot_keys(named, SET, rows.count())
    out = spread_join(rows.drop("bands"), named.drop("_c"), SET, copied, ["text_hash", key], "left")
    is_first = F.col(key).eqNullSafe(F.col("first.key")) & (F.col("text_hash") == F.col("first.text_hash"))
    empty = F.col("n") == 0
    return out.select(
        F.col(key), "text_hash", F.col("n").alias("n_shingles"), F.when(empty, F.col(key)).otherwise(F.col("first.key")).alias("component_id"),
        (empty | is_first).alias("kept"),
    )


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), size=4)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The contract by comparing all pairs that share a shingle, for small tables.
ORACLE = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w)=0 THEN [] WHEN len(w)<4 THEN [array_to_string(w,' ')] ELSE list_transform(range(1, len(w)-2), lambda i: array_to_string(w[i:i+3],' ')) END) AS g FROM w),
n AS (SELECT r, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM g a JOIN g b ON a.g=b.g AND a.r<>b.r GROUP BY 1,2),
l AS (SELECT u, v FROM p JOIN n x ON x.r=u JOIN n y ON y.r=v WHERE 100*c >= 80*(x.n+y.n-c)),
reach(node, root) AS (SELECT r, r FROM w UNION SELECT l.v, reach.root FROM reach JOIN l ON l.u=reach.node),
least AS (SELECT node, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r=reach.root GROUP BY 1)
SELECT w.doc_id, coalesce(n,0) AS n_shingles, component_id, w.doc_id=component_id AS kept FROM w JOIN least ON least.node=w.r LEFT JOIN n ON n.r=w.r"""
