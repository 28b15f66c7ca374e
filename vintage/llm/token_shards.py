"""Operator 10: token ids as binary shards under a minimal perfect hash index.

Format: a Parquet table of blocks in ascending key order. A block holds the
raw little-endian ids of its documents back to back (``payload``, unsigned 16
bits when the vocabulary fits, else 32; ``width`` says which), ``base`` (ids in
all blocks before it), its keys in order, and an index: a minimal perfect hash
(hash and displace) gives each document its own slot in 0..n-1, and the slot
stores a 32-bit fingerprint and the document's offset and length in ids. A
look-up hashes the key, reads one displacement, one fingerprint and one span;
a key that the block lacks passes with probability 2**-32.

Every span is read through that index: ``read_documents`` lists the keys of a
block and looks each up, and ``find`` gives the spans of any keys of the whole
dataset, reading only the blocks whose key range holds one.

Parquet is the container because executors reach the shared store through
Spark alone; the payload inside is raw ids.

Encoding: a text is cut at spaces, where the byte-level pre-tokenizer always
cuts; distinct words of a batch of texts are found by Arrow's dictionary
encoding, those that the worker has not met are encoded by the library, and the
ids of the batch are gathered from the worker's table.

Edge cases: null text is the empty text (the end id only); rows with a null
key come first and keep a null key; documents of one key follow each other in an
order fixed by their text, each with a slot of its own (key and occurrence), also
across blocks and partitions; an empty table gives no block; texts of any length are
encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.llm.common import mix, parts, scratch, table

#: At a space after a non-space the byte-level pre-tokenizer always cuts, and
#: what follows does not depend on what came before.
_CUT = re.compile(r"(?<=\S)(?= )")
#: Line breaks that are not between two visible characters.
_BREAKS = re.compile(r"\n\s|\s\n|\A\n|\n\Z")

#: How the byte-level vocabulary writes a space.
SPACE_SIGN = "\u0120"
#: Bytes of text encoded, words gathered and words learned at once.
BYTES, WORDS, LEARN = 32 << 20, 400_000, 1000
STOPS = ".,"

BLOCKS = (
    "partition int, block int, base long, n_docs long, n_ids long, width int, n_null long, first_key long, last_key long, "
    "salt int, seeds binary, fingerprints binary, offsets binary, lengths binary, order_keys binary, payload binary"
)


# ------------------------------------------------------------- tokenizing
class TokenTable:
    """Ids of texts by the tokenizers library; each distinct space-led word is
    encoded once per worker and kept: as a row, a span of ids in one array.
    Over ``size`` rows, only those that the next batch needs are kept."""

    def __init__(self, path: str, size: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.vocabulary = self.lib.get_vocab_size(with_added_tokens=True)
        added = self.lib.get_added_tokens_decoder().values()
        if self.lib.normalizer is not None or any(t.lstrip or t.rstrip or " " in t.content for t in added):
            raise ValueError("words of this tokenizer are not independent")
        self.size = size
        self.lead = np.zeros(max(self.vocabulary, 1), bool)
        self.lead[[i for t, i in self.lib.get_vocab(with_added_tokens=True).items() if t.startswith(SPACE_SIGN)]] = True
        self._empty()

    def _empty(self) -> None:
        #: Rows of words led by a space, and of words at the start of a text or line; -1 of words that don't end where the next space starts.
        self.rows: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, "<u4"), 0
        self.start, self.length, self.n_rows = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self._add(self.ids[:0], np.zeros(1, np.int64))  # row 0 has no ids

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        """Rows for ids back to back."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_rows + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        at = range(self.n_rows, self.n_rows + len(lengths))
        self.start[at.start : at.stop], self.length[at.start : at.stop] = self.n_ids + np.cumsum(lengths) - lengths, lengths
        self.n_ids, self.n_rows = self.n_ids + len(ids), at.stop
        return at

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of rows back to back."""
        n = self.length[rows]
        place = np.repeat(self.start[rows] - (np.cumsum(n) - n), n)
        place += np.arange(len(place))
        return self.ids[place]

    def _join(self, rows: list[list[int]]) -> range:
        """For each list, a row of the ids of its rows."""
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.array([x for r in rows for x in r], np.int64)
        if not len(flat):
            return range(0)
        return self._add(self._gather(flat), np.add.reduceat(self.length[flat], np.cumsum(sizes) - sizes))

    def _keep(self, words: list[str]) -> None:
        """Forget all but the rows of ``words``."""
        kept = {w: r for w in words if (r := self.rows.get(w)) is not None}
        good = [w for w, r in kept.items() if r > 0]
        rows = np.array([kept[w] for w in good], np.int64)
        ids, lengths = self._gather(rows), self.length[rows]
        self._empty()
        self.rows.update(zip(good, self._add(ids, lengths)))

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts back to back, and how many each has."""
        each = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for e in each for i in e], "<u4"), np.array([len(e) for e in each], np.int64)

    def _led(self, words: list[str]) -> range:
        """Rows of words (none ends in white space), each led by a space, encoded
        side by side: each starts at the only id in it that starts with a
        space. Where that can't be told, one by one."""
        all_ids, all_lengths = [self.ids[:0]], [self.length[:0]]
        for s in range(0, len(words), LEARN):
            some = words[s : s + LEARN]
            ids = np.array(self.lib.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.lead[ids])
            lengths = np.diff(starts, append=len(ids))
            if len(starts) != len(some):
                ids, lengths = self.whole([" " + w for w in some])
            all_ids.append(ids)
            all_lengths.append(lengths)
        return self._add(np.concatenate(all_ids), np.concatenate(all_lengths))

    def learn_heads(self, new: list[str]) -> None:
        new = [w for w in new if w not in self.heads]
        if new:
            self.heads.update(zip(new, self._add(*self.whole(new))))

    def learn(self, new: list[str]) -> None:
        """A stop or comma after a letter and a line break between visible
        characters are ids of their own, so bare words and lines are learned."""
        rows, stopped, broken = self.rows, [], []
        bare = dict.fromkeys(filter(str.isalpha, new))
        for w in new:
            if w in bare:
                continue
            if not w or w[-1].isspace():
                rows[w] = -1
                continue
            if "\n" in w and not _BREAKS.search(w):
                broken.append((w, w.split("\n")))
                w = broken[-1][1][0]
                if w in rows:
                    continue
            if w[-1] in STOPS and w[-2:-1].isalpha():
                stopped.append(w)
                w = w[:-1]
                if w in rows:
                    continue
            bare[w] = None
        rows.update(zip(bare, self._led(list(bare))))
        stopped = list(dict.fromkeys(w for w in stopped if w not in rows))
        self.learn_heads([*STOPS, "\n", *dict.fromkeys(x for _, (_, *lines) in broken for x in lines)])
        heads, newline = self.heads, self.heads["\n"]
        rows.update(zip(stopped, self._join([[rows[w[:-1]], heads[w[-1]]] for w in stopped])))
        rows.update(zip([w for w, _ in broken], self._join([[rows[first], *[r for x in lines for r in (newline, heads[x])]] for _, (first, *lines) in broken])))

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, each followed by ``end`` if given,
        and how many each has."""
        lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets, words = offsets - offsets[0], lists.flatten()
        coded = words.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        first = offsets[:-1]
        led = np.ones(len(codes), bool)
        led[first] = False
        used = np.zeros(len(names), bool)
        used[codes[led]] = True
        own = [names[i] for i in np.flatnonzero(used)]
        starts = [names[i] for i in np.unique(codes[first])]
        if self.n_rows + len(own) > self.size:
            self._keep(own)
        got = list(map(self.rows.get, own))
        if None in got:
            self.learn([w for w, g in zip(own, got) if g is None])
            got = list(map(self.rows.__getitem__, own))
        self.learn_heads(starts)
        by_name = np.zeros(len(names), np.int64)
        by_name[used] = got
        row = by_name[codes]
        by_name[np.unique(codes[first])] = [self.heads[w] for w in starts]
        row[first] = by_name[codes[first]]

        # texts with a word that does not end where the next space starts: cut elsewhere
        open_ = np.array([not w or w[-1].isspace() for w in starts], bool)
        by_name[np.unique(codes[first])] = open_
        odd = (by_name[codes[first]] == 1) & (np.diff(offsets) > 1)
        odd[np.searchsorted(offsets, np.flatnonzero(row < 0), side="right") - 1] = True
        for i in np.flatnonzero(odd):
            row[offsets[i] : offsets[i + 1]] = 0
            ids, lengths = self.whole(_CUT.split(texts[int(i)].as_py()))
            row[offsets[i]] = self._add(ids, lengths.sum(keepdims=True))[0]
        if end is not None:
            row = np.insert(row, offsets[1:], self._add(np.array([end], "<u4"), np.ones(1, np.int64))[0])
            offsets = offsets + np.arange(len(offsets))

        length = self.length[row]
        sizes = np.add.reduceat(length, offsets[:-1]) if len(texts) else np.zeros(0, np.int64)
        return np.concatenate([self._gather(row[s : s + WORDS]) for s in range(0, len(row), WORDS)] or [self.ids[:0]]), sizes


_tables: dict[tuple[str, int], TokenTable] = {}


def _table(path: str, size: int) -> TokenTable:
    if (path, size) not in _tables:
        _tables[path, size] = TokenTable(path, size)
    return _tables[path, size]


def slices(column: pa.Array, size: int = BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes of text, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, stop
        at = stop


# --------------------------------------------------- minimal perfect hash
def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.int64).view(np.uint64) ^ mix(np.array([seed + 1], np.uint64))[0])


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 2**31) >> np.uint64(32)).astype(np.uint32)


def identities(keys: np.ndarray, is_null: np.ndarray, occurrence: np.ndarray, salt: int) -> np.ndarray:
    """What the index hashes: a number for each document of a block, from its
    key and its place among the block's documents of that key."""
    with np.errstate(over="ignore"):
        other = (occurrence.astype(np.uint64) * np.uint64(2) + is_null.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        return mix(mix(keys.astype(np.int64).view(np.uint64)) + other).view(np.int64)


#: Displacements from here on name a slot instead of a seed.
DIRECT = 2**31


def build_mph(keys: np.ndarray, load: int = 4) -> np.ndarray:
    """Displacement of each bucket of about ``load`` distinct keys: with it,
    slot(key) is a one-to-one map onto 0..n-1. Larger buckets go first; a
    bucket of one key takes a free slot by its number."""
    n = len(keys)
    n_buckets = max(1, -(-n // load))
    bucket = (_hash(keys, 0) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(counts)
    taken = np.zeros(n, bool)
    seeds = np.zeros(n_buckets, np.uint32)
    for b in np.argsort(-counts, kind="stable"):
        if counts[b] < 2:
            break
        own = keys[order[ends[b] - counts[b] : ends[b]]]
        seed, tries = 1, 8
        while True:
            slots = _slots(own[None, :], np.arange(seed, seed + tries, dtype=np.uint64)[:, None], n)
            ranked = np.sort(slots, axis=1)
            good = ~taken[slots].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                break
            seed, tries = seed + tries, min(256, 4 * tries)
        at = int(np.argmax(good))
        taken[slots[at]] = True
        seeds[b] = seed + at
    single = np.flatnonzero(counts == 1)
    seeds[single] = DIRECT + np.flatnonzero(~taken)[: len(single)]
    return seeds


def _slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.astype(np.int64).view(np.uint64) ^ mix(seeds + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def slots_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Slots of keys in an index of n distinct keys."""
    own = seeds[(_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)].astype(np.uint64)
    return np.where(own >= DIRECT, own.astype(np.int64) - DIRECT, _slots(keys, own, n))


# ---------------------------------------------------------------- writing
def occurrences(keys: np.ndarray, is_null: np.ndarray) -> np.ndarray:
    """Place of each document among those of its key, which follow each other."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (is_null[1:] != is_null[:-1])
    at = np.flatnonzero(new)
    return np.arange(len(keys)) - np.repeat(at, np.diff([*at, len(keys)]))


def _block(keys: np.ndarray, is_null: np.ndarray, sizes: np.ndarray, ids: np.ndarray, wide: bool) -> dict:
    n, salt, times = len(keys), 0, occurrences(keys, is_null)
    while len(np.unique(own := identities(keys, is_null, times, salt))) < n:
        salt += 1
    seeds = build_mph(own)
    slot = slots_of(own, seeds, n)
    prints, at, size = np.zeros(n, "<u4"), np.zeros(n, "<i8"), np.zeros(n, "<i8")
    prints[slot], at[slot], size[slot] = fingerprint(own), np.cumsum(sizes) - sizes, sizes
    named = keys[~is_null]
    return {
        "n_docs": n, "n_ids": len(ids), "width": 4 if wide else 2, "n_null": int(is_null.sum()),
        "first_key": int(named[0]) if len(named) else None, "last_key": int(named[-1]) if len(named) else None,
        "salt": salt, "seeds": seeds.astype("<u4").tobytes(), "fingerprints": prints.tobytes(), "offsets": at.tobytes(), "lengths": size.tobytes(),
        "order_keys": named.astype("<i8").tobytes(), "payload": (ids if wide else ids.astype("<u2")).tobytes(),
    }


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_shards(
    df: DataFrame, out: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    end_id: int = 0, block_ids: int = 2_000_000, table_size: int = 800_000, partition_rows: int = 200_000,
) -> None:
    """Encode ``text`` and write blocks in ascending ``key`` order to ``out``.

    One range partitioning by key and text, into as many partitions as the
    session shuffles to or as keep ``partition_rows`` rows in each; a task
    encodes its range and cuts blocks of about ``block_ids`` ids. ``base``
    counts within the partition; ``partition`` (the order of ranges) is written
    too, and ``read_shards`` adds what earlier partitions hold.
    """
    path = tokenizer or default_tokenizer()
    spark = df.sparkSession
    kind = spark.createDataFrame([], BLOCKS).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(path, table_size)
        wide = rows.vocabulary > 65536 or end_id > 65535
        held: list[tuple[np.ndarray, ...]] = []  # keys, is_null, sizes, ids
        n_held, base, number, part = 0, 0, 0, None

        def block(n: int) -> pa.RecordBatch:
            """Of the first ``n`` documents held."""
            nonlocal held, n_held, base, number
            keys, null, sizes, ids = (np.concatenate(x) for x in zip(*held))
            cut = int(sizes[:n].sum())
            made = {"partition": part, "block": number, "base": base} | _block(keys[:n], null[:n], sizes[:n], ids[:cut], wide)
            held, n_held, base, number = [(keys[n:], null[n:], sizes[n:], ids[cut:])], n_held - cut, base + cut, number + 1
            return pa.RecordBatch.from_pylist([made], schema=arrow)

        for b in batches:
            for s, e in slices(b.column("_text")):
                some = b.slice(s, e - s)
                part = some.column("_part")[0].as_py()
                null = some.column("_key").is_null().to_numpy(zero_copy_only=False)
                ids, sizes = rows.encode(some.column("_text"), end_id)
                held.append((pc.fill_null(some.column("_key"), 0).to_numpy(zero_copy_only=False), null, sizes, ids))
                n_held += len(ids)
                while n_held >= block_ids:
                    ends = np.cumsum(np.concatenate([h[2] for h in held]))
                    yield block(int(np.searchsorted(ends, block_ids)) + 1)
        while n_held:
            ends = np.cumsum(np.concatenate([h[2] for h in held]))
            yield block(min(len(ends), int(np.searchsorted(ends, block_ids)) + 1))

    src = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    n = max(parts(spark), -(-df.count() // partition_rows))
    tie = F.xxhash64(F.coalesce("_text", F.lit("")))
    dealt = src.repartitionByRange(n, "_key", tie).sortWithinPartitions("_key", tie, "_text").withColumn("_part", F.spark_partition_id())
    dealt.mapInArrow(run, kind).write.option("compression", "zstd").parquet(out)


# ---------------------------------------------------------------- reading
def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``base`` over the whole dataset."""
    blocks = spark.read.parquet(path)
    names = blocks.columns
    return blocks.join(starts(blocks.select("partition", "n_ids")), "partition").withColumn("base", F.col("base") + F.col("start")).select(*names)


def starts(sizes: DataFrame, at_once: int = 1000) -> DataFrame:
    """(partition, start): ids of all write partitions before each, from rows
    (partition, n_ids). Running sums within ``at_once`` partitions, plus what
    the ones before hold; joined by partition, so the plan has no row of them."""
    sums = sizes.groupBy("partition").agg(F.sum("n_ids").alias("n")).withColumn("run", F.floor(F.col("partition") / at_once))
    earlier = W.unboundedPreceding, -1
    runs = sums.groupBy("run").agg(F.sum("n").alias("m"))
    runs = runs.select("run", F.coalesce(F.sum("m").over(W.orderBy("run").rowsBetween(*earlier)), F.lit(0)).alias("before"))  # one row to at_once partitions
    own = F.coalesce(F.sum("n").over(W.partitionBy("run").orderBy("partition").rowsBetween(*earlier)), F.lit(0))
    return sums.withColumn("own", own).join(runs, "run").select("partition", (F.col("own") + F.col("before")).alias("start"))


def look_up(block, keys: np.ndarray, is_null: np.ndarray | None = None, occurrence: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offset and length in ids of each key (and occurrence) in a block; -1
    where the stored fingerprint says that the block lacks it. Constant time
    for each key."""
    keys = np.asarray(keys, np.int64)
    zero = np.zeros(len(keys), np.int64)
    own = identities(keys, zero if is_null is None else is_null, zero if occurrence is None else occurrence, block.salt)
    prints, at, size = np.frombuffer(block.fingerprints, "<u4"), np.frombuffer(block.offsets, "<i8"), np.frombuffer(block.lengths, "<i8")
    slot = slots_of(own, np.frombuffer(block.seeds, "<u4"), len(prints))
    hit = prints[slot] == fingerprint(own)
    return np.where(hit, at[slot], -1), np.where(hit, size[slot], -1)


def ids_of(block) -> np.ndarray:
    return np.frombuffer(block.payload, "<u2" if block.width == 2 else "<u4").astype("<u4")


INDEX = ["base", "n_docs", "width", "n_null", "salt", "seeds", "fingerprints", "offsets", "lengths", "payload"]


def read_documents(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document of the blocks: key, start, n_tokens, ids_crc32, each
    found by its key in the block's index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                is_null = np.arange(r.n_docs) < r.n_null
                keys = np.concatenate([np.zeros(r.n_null, np.int64), np.frombuffer(r.order_keys, "<i8")])
                at, size = look_up(r, keys, is_null, occurrences(keys, is_null))
                if (at < 0).any():
                    raise RuntimeError("a key of the block is not in its index")
                raw = memoryview(ids_of(r).tobytes())
                yield pd.DataFrame({
                    key: pd.arrays.IntegerArray(keys.astype(np.int64), is_null),
                    "start": at + r.base, "n_tokens": size,
                    "ids_crc32": np.array([zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(at.tolist(), size.tolist())], np.int64),
                })

    return blocks.select(*INDEX, "order_keys").mapInPandas(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def find(blocks: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access: key, start, n_tokens and ids of every document that has
    one of ``keys`` (a column named ``key``); absent keys give no row.

    A key goes to the write partitions and then to the blocks whose range holds
    it, by joins with ranges only; each block that is named reads its spans
    through its index, occurrence by occurrence."""
    wanted = keys.select(F.col(key).cast("long").alias("key")).distinct()

    def holds(least: str, most: str, nulls: str) -> Column:
        return F.when(F.col("key").isNull(), F.col(nulls) > 0).otherwise(F.col("key").between(F.col(least), F.col(most)))

    ranges = blocks.select("partition", "block", F.col("first_key").alias("lo"), F.col("last_key").alias("hi"), F.col("n_null").alias("nulls"))
    by_part = ranges.groupBy("partition").agg(F.min("lo").alias("p_lo"), F.max("hi").alias("p_hi"), F.sum("nulls").alias("p_nulls"))
    placed = wanted.join(F.broadcast(by_part), holds("p_lo", "p_hi", "p_nulls")).select("key", "partition")  # one row for each write partition
    named = placed.join(ranges, "partition").where(holds("lo", "hi", "nulls"))
    named = named.groupBy("partition", "block").agg(F.collect_list(F.struct("key")).alias("keys"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                asked = [k["key"] for k in r.keys]
                is_null = np.array([k is None for k in asked])
                own = np.array([k or 0 for k in asked], np.int64)
                which, time, ids, rows = np.arange(len(own)), 0, ids_of(r), []
                while len(which):
                    at, size = look_up(r, own[which], is_null[which], np.full(len(which), time))
                    rows += [(asked[i], s + r.base, n, ids[s : s + n].astype(np.int64)) for i, s, n in zip(which.tolist(), at.tolist(), size.tolist()) if s >= 0]
                    which, time = which[at >= 0], time + 1
                out = pd.DataFrame(rows, columns=[key, "start", "n_tokens", "ids"])
                yield out.assign(**{key: pd.array(out[key].tolist(), "Int64")})

    return named.join(blocks, ["partition", "block"]).select("keys", *INDEX).mapInPandas(run, f"`{key}` long, start long, n_tokens long, ids array<long>")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards, reads them back, and returns what they hold."""
    out = scratch(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), out)
    return read_documents(read_shards(spark, out))
