"""Operator 4: benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased words with ASCII punctuation left out. A mask
picks some token positions of a window and ignores the others, so a window
whose changed tokens fall on ignored positions has the same hash. Hashes of
all windows of the benchmark under every mask are joined with those of the
documents; around each hit the diagonal (document position less item
position) is compared as far as the region of the hits reaches, ``MARGIN`` words to
either side of them, and the stretch of most matches with at least four to each
mismatch is the overlap. A document is contaminated by an item if the
overlap has ``least_words`` matching words, or 80 % of a shorter item.

Document windows are first held against a bitmap made from the benchmark's
hashes, of 512 bits for each hash and ``MOST_BITS`` at most, so it may be
broadcast whatever the benchmark; it only leaves out windows that cannot join.
What passes is joined through a shuffle; windows and items that very many
regions share are dealt over several tasks.

Edge cases: null or empty texts and items have no windows and no overlap; items
of no more words than a mask spans have masks of their own length; texts of any
length are read whole; repeated rows of an id and text count once; a null id,
of a document or an item, is reported as a null id, and each item row is an item
of its own; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.common import exact, hot_keys, materialize, mix, spread_join, table, word_hashes

#: Masks: 1 reads a position, 0 ignores it. Picked one by one from all masks of six
#: read positions and a span of up to 11, each adding most of the placements of
#: changed words that the others miss. Together they find every passage of 10 to 14 words
#: with up to 0, 1, 2, 2 and 2 changed words wherever these are, and of 15 with 3 all but 1 in 500.
MASKS = ("1111011", "11010001011", "1100011011")
SPAN = max(map(len, MASKS))
MOST_BITS = 1 << 27
#: Words kept on either side of a stretch of hits.
MARGIN = 64

_KEPT = np.ones(256, bool)
_KEPT[[c for c in range(33, 127) if not chr(c).isalnum()]] = False
_FACTORS = (np.random.default_rng(4).integers(1, 2**62, 2 * SPAN, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text."""
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    return word_hashes(data[_KEPT[data]])[0]


def short_masks(size: int) -> list[str]:
    """Masks as long as an item of ``size`` words: whichever words are changed,
    if 80 % are not, one of the masks ignores them all."""
    changed = size - -(-8 * size // 10)
    parts = 2 * changed + 1
    return ["".join("01"[j * parts // size not in out] for j in range(size)) for out in combinations(range(parts), changed)]


def window_hashes(words: np.ndarray, lengths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each mask, and then for each mask of each length of short items, the
    hash of the window that starts at each position."""
    numbered = [*enumerate(MASKS), *[(1000 * size + i, m) for size in lengths for i, m in enumerate(short_masks(size))]]
    for k, mask in numbered:
        n = len(words) - len(mask) + 1
        if n <= 0:
            yield np.zeros(0, np.uint64)
            continue
        h = np.full(n, np.uint64(k))
        with np.errstate(over="ignore"):
            for j, c in enumerate(mask):
                if c == "1":
                    h = h + words[j : j + n] * _FACTORS[j]
        yield mix(h)


def bit_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def item_seeds(items: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(h, item, at) of every masked window of every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, w in zip(b["item"], b["item_words"]):
                w = np.asarray(w, np.int64).view(np.uint64)
                own = (len(w),) if len(w) in lengths else ()
                for h in window_hashes(w, own):
                    yield pd.DataFrame({"h": h.view(np.int64), "item": np.full(len(h), i), "at": np.arange(len(h))})

    return items.select("item", "item_words").mapInPandas(run, "h long, item long, at int")


def bitmap(seeds: DataFrame) -> np.ndarray:
    """Bytes of a bitmap with two bits for each hash; at most MOST_BITS / 64
    rows come to the driver."""
    bits = 1 << 16
    need = min(MOST_BITS, 512 * seeds.count())
    while bits < need:
        bits *= 2
    u = lambda c: F.pmod(c, F.lit(bits))  # noqa: E731  a power of two, so as of unsigned numbers
    each = seeds.select(F.explode(F.array(u(F.col("h")), u(F.shiftrightunsigned("h", 32)))).alias("bit"))
    packed = each.groupBy((F.col("bit") / 64).cast("long").alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for r in packed.collect():
        out[r.place] = r.bits
    return out.view(np.uint8)


class Bits:
    """A bitmap as a worker reads it: a byte for each bit up to 32 MB, else packed."""

    def __init__(self, packed: np.ndarray) -> None:
        self.size = 8 * len(packed)
        self.packed = packed
        self.bytes = np.unpackbits(packed, bitorder="little").view(bool) if self.size <= 1 << 25 else None

    def has(self, at: np.ndarray) -> np.ndarray:
        if self.bytes is not None:
            return self.bytes[at]
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def regions(docs: DataFrame, bits, lengths: tuple[int, ...], key: str, text: str) -> DataFrame:
    """Stretches of documents with windows that may be in the benchmark:
    key, text_hash, start, words (with a margin) and hits (h, at)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = Bits(bits.value)
        columns = [key, "text_hash", "start", "words", "hits"]
        for b in batches:
            rows = []
            for k, x, t in zip(b[key].array, b["text_hash"], b["_text"]):
                words = tokens(t)
                at, found = [], []
                for h in window_hashes(words, lengths):
                    one, two = bit_places(h, there.size)
                    hit = np.flatnonzero(there.has(one))
                    hit = hit[there.has(two[hit])]
                    at.append(hit)
                    found.append(h[hit])
                at, found = np.concatenate(at), np.concatenate(found)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                for s in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > MARGIN) + 1):
                    start, stop = max(0, at[s[0]] - MARGIN), at[s[-1]] + SPAN + MARGIN
                    hits = [{"h": h, "at": a} for h, a in zip(found[s].view(np.int64).tolist(), at[s].tolist())]
                    rows.append((k, x, start, words[start:stop].view(np.int64), hits))
                if len(rows) >= 1000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    src, kind, back = exact(docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text")), [key])
    return back(src.mapInPandas(run, kind + ", text_hash long, start int, words array<long>, hits array<struct<h:long,at:int>>"))


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, worst: int = 4) -> int:
    """Most matching words of a stretch on the diagonal where item position j
    meets document position j + shift, with at least ``worst`` matches to each
    mismatch: a match scores 1, a mismatch -worst, and the sum is 0 or more."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high <= low:
        return 0
    same = item[low:high] == doc[low + shift : high + shift]
    matched = np.concatenate([[0], np.cumsum(same)])
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -worst))])
    # the first start whose sum is no more than that at the stop
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    return int((matched - matched[first]).max())


def contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, item_id, overlap) of every document and item that
    overlap; ``text_hash`` is xxhash64 of the document's text."""
    spark = docs.sparkSession

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"].array, "item_words": [tokens(t).view(np.int64) for t in b["_text"]]})

    items, id_kind, back = exact(benchmark.where(F.col("text").isNotNull()).select("item_id", F.col("text").alias("_text")), ["item_id"])
    items = back(items.mapInPandas(split, id_kind + ", item_words array<long>")).where(F.size("item_words") > 0)
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    short = items.select(F.size("item_words").alias("n")).where(F.col("n") <= SPAN).distinct()
    lengths = tuple(sorted(r.n for r in short.collect()))  # SPAN values at most
    seeds = materialize(item_seeds(items, lengths), "seeds")
    bits = spark.sparkContext.broadcast(bitmap(seeds))
    found = materialize(regions(docs, bits, lengths, key, text).withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = found.select("region", "start", F.explode("hits").alias("hit")).select("region", F.col("hit.h").alias("h"), (F.col("hit.at") - F.col("start")).alias("p"))

    counts = hits.groupBy("h").agg(F.count(F.lit(1)).alias("_c"))
    common = hot_keys(counts, ["h"], found.agg(F.sum(F.size("hits"))).first()[0] or 0)
    pairs = spread_join(hits, seeds, ["h"], common, ["region", "p"]).select("region", "item", (F.col("p") - F.col("at")).alias("shift")).distinct()
    pairs = materialize(pairs, "pairs")
    leaked = hot_keys(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("_c")), ["item"], pairs.count())
    both = pairs.join(found.select("region", F.col("words").alias("doc")), "region")
    both = spread_join(both, items, ["item"], leaked, ["region", "shift"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [overlap(np.asarray(d), np.asarray(i), s) for d, i, s in zip(b["doc"], b["item_words"], b["shift"])]
            size = [len(i) for i in b["item_words"]]
            out = pd.DataFrame({"region": b["region"], "item": b["item"], "overlap": n})
            yield out[[m >= min(least_words, -(-8 * z // 10)) for m, z in zip(n, size)]]

    checked = both.select("region", "item", "shift", "doc", "item_words").mapInPandas(verify, "region long, item long, overlap int")
    checked = checked.groupBy("region", "item").agg(F.max("overlap").alias("overlap"))
    checked = spread_join(checked.join(found.select("region", key, "text_hash"), "region"), items.select("item", "item_id"), ["item"], leaked, ["region"])
    return checked.groupBy(key, "text_hash", "item", "item_id").agg(F.max("overlap").alias("overlap")).drop("item")


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, each with its items and largest overlap."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("overlap").alias("max_overlap")
    )
