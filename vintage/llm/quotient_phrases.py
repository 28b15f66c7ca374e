"""Operator 13: phrases mined with counting quotient filters.

Words that are common enough get numbers: a block's distinct words go by 128-bit
hashes to shards, which sum their counts and answer each block. A phrase of n words is their
numbers packed into n * B bits, B bits a number. A Feistel network permutes these
bits invertibly; the top bits of the result are the quotient and all the rest is the
remainder, so a filter loses nothing: it keeps for each quotient how many
remainders it has, the remainders in order (a few bytes, as the quotient's bits need
not be stored), and a counter for each. Each block (see ``blocks``) counts its phrases
into a filter, cut by leading bits into shards; the filters of a shard are merged
in order, counters added, and the phrases common enough are unpacked again.

Phrases are counted by length. One of n words is counted only where both its
parts of n - 1 words are common, which any common one's are; what is common is held
against a bitmap of bounded size, so that a false hit costs a counter and
changes nothing. A word or phrase is one entry a block and shard however common it is.

A phrase's score is that of its lowest-scoring cut in two,
floor(1000 * a * n / (l * r)) in decimals of 38 digits. A phrase inside a longer
one that is as common is dropped: it is enough to look one word further, as what
lies between the two is then as common too.

Edge cases: null text has no words; a null language is ``und``; texts of any
length are read whole; repeated rows count each; null and repeated ids do not
matter; ties go by phrase; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vintage.llm.blocks import BLOCK, Numbers, pack, unpack, written
from vintage.llm.common import hot_keys, materialize, mix, spread_join, table
from vintage.llm.spaced_seeds import Bits, bit_places, bitmap

#: Fixed: what ends a piece, what parts words, and the longest phrase.
ENDS, BLANKS, LONGEST = b".,;:!?\n\x0b\x0c\r", b" \t", 5
#: Entries (a block's distinct phrase) that a shard merges at about.
SHARD = 1 << 21
_CLEAN = bytes.maketrans(ENDS + BLANKS, b"\n" * len(ENDS) + b" " * len(BLANKS))


# ---------------------------------------------------------------- filters
def _rounds(lanes: list[np.ndarray], bits: int, order: Iterator[int]) -> list[np.ndarray]:
    n, mask = len(lanes), np.uint64((1 << bits) - 1)
    lanes = list(lanes)
    for r in order:
        seen = np.full(len(lanes[0]), np.uint64(r + 1))
        with np.errstate(over="ignore"):
            for j in range(1, n):
                seen = mix(seen * np.uint64(0x9E3779B97F4A7C15) + lanes[(r + j) % n])
        lanes[r % n] = lanes[r % n] ^ (seen & mask)
    return lanes


def permuted(lanes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """An invertible mix of the numbers (lanes of ``bits`` bits) of each phrase:
    each is changed twice by a function of all the others."""
    return _rounds(lanes, bits, range(2 * len(lanes)))


def restored(lanes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    return _rounds(lanes, bits, reversed(range(2 * len(lanes))))


def packed(lanes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Two lanes to a column of 64 bits at most."""
    return [(lanes[i] << np.uint64(bits)) | lanes[i + 1] if i + 1 < len(lanes) else lanes[i] for i in range(0, len(lanes), 2)]


def unpacked(columns: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    mask, out = np.uint64((1 << bits) - 1), []
    for i, c in zip(range(0, n, 2), columns):
        out += [c >> np.uint64(bits), c & mask] if i + 1 < n else [c]
    return out


def added(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys in order, with the sums of their counts."""
    if not len(counts):
        return columns, counts
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    first = np.ones(len(counts), bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(first)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at)


class Filter:
    """A counting quotient filter over sorted keys: columns of ``width`` bits in
    the first, whose ``skip`` leading bits (the shard) are known."""

    FIELDS = ["quotients", "runs", "remainders", "rest_1", "rest_2", "counts"]

    @staticmethod
    def made(columns: list[np.ndarray], counts: np.ndarray, width: int, skip: int) -> tuple:
        left = width - skip
        q = min(left, max(0, len(counts).bit_length() - 1))
        low = columns[0] & np.uint64((1 << left) - 1)
        runs = np.bincount((low >> np.uint64(left - q)).astype(np.int64), minlength=1 << q)
        rest = [pack(c) for c in columns[1:]] + [b""] * (3 - len(columns))
        return (q, pack(runs), pack(low & np.uint64((1 << (left - q)) - 1)), *rest, pack(counts))

    @staticmethod
    def read(row: tuple, shard: int, width: int, skip: int) -> tuple[list[np.ndarray], np.ndarray]:
        q, runs, remainders, rest_1, rest_2, counts = row
        left = width - skip
        quotients = np.repeat(np.arange(1 << q, dtype=np.uint64), unpack(runs).astype(np.int64))
        first = (np.uint64(shard << left)) | (quotients << np.uint64(left - q)) | unpack(remainders)
        return [first, *[unpack(r) for r in (rest_1, rest_2) if r]], unpack(counts)


# ------------------------------------------------------------------ blocks
def pieces(text: str | None) -> list[bytes]:
    """Words, and a line end for each end of a piece (and of the text)."""
    return [w for w in ((text or "").encode().lower().translate(_CLEAN).replace(b"\n", b" \n ") + b" \n").split(b" ") if w]


def word_blocks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """block, lang, words (zipped, by line), counts, stream (0: end of a piece), n (words), n_distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def closed() -> pd.DataFrame:
            rows = []
            for k, (g, (numbers, streams)) in enumerate(held.items()):
                stream = np.concatenate(streams)
                counts = np.bincount(stream, minlength=len(numbers))[1:]
                words = zstandard.ZstdCompressor(level=1).compress(b"\n".join([*numbers][1:]))
                rows.append((f"{part}-{made}-{k}", g, words, pack(counts), pack(stream), int(counts.sum()), len(counts)))
            return pd.DataFrame(rows, columns=["block", "lang", "words", "counts", "stream", "n", "n_distinct"])

        for b in batches:
            for g, t in zip(b["_lang"], b["_text"]):
                if g not in held:
                    held[g] = (Numbers({b"\n": 0}), [])
                numbers, streams = held[g]
                streams.append(numbers.stream(pieces(t)))
                size += len(streams[-1])
                if size >= BLOCK:
                    yield closed()
                    made, held, size = made + 1, {}, 0
        if held:
            yield closed()

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("_lang"), F.col(text).alias("_text"))
    return rows.mapInPandas(run, "block string, lang string, words binary, counts binary, stream binary, n long, n_distinct long")


def _keys(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit hashes of a language's words as two halves, and their order."""
    head = lang.encode() + b"\n"
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(head + w) for w in words), ">u8").astype(np.uint64).reshape(-1, 2)
    high, low = both[:, 0], both[:, 1]
    return high, low, np.lexsort((low, high))


def _words(zipped: bytes, n: int) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(zipped).split(b"\n") if n else []


def asked(blocks: DataFrame, shards: int) -> DataFrame:
    """shard, block, and the keys and counts of a block's distinct words."""
    bits = shards.bit_length() - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                counts = unpack(r.counts)
                high, low, order = _keys(r.lang, _words(r.words, len(counts)))
                high, low, counts = high[order], low[order], counts[order]
                edges = np.searchsorted(high, np.arange(1, shards, dtype=np.uint64) << np.uint64(64 - bits)).tolist() if shards > 1 else []
                cut = [0, *edges, len(counts)]
                rows = [(k, r.block, pack(high[i:j], rising=True), pack(low[i:j]), pack(counts[i:j])) for k, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
                yield pd.DataFrame(rows, columns=["shard", "block", "high", "low", "counts"])

    return blocks.select("block", "lang", "words", "counts").mapInPandas(run, "shard int, block string, high binary, low binary, counts binary")


def answered(requests: DataFrame, shards: int, least: int) -> DataFrame:
    """block, shard, the number of each word asked for (0: not common), which of
    them this block is to spell (each common word is spelt by one block), and the counts of these."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        high, low, counts = (list(map(unpack, part[c])) for c in ("high", "low", "counts"))
        stops = np.cumsum([len(c) for c in counts])
        high, low, counts = np.concatenate(high), np.concatenate(low), np.concatenate(counts).astype(np.int64)
        order = np.lexsort((low, high))
        first = np.ones(len(order), bool)
        first[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        at = np.flatnonzero(first)
        sums = np.add.reduceat(counts[order], at)
        often = sums >= least
        ids = np.where(often, (np.cumsum(often) - 1) * shards + int(part["shard"].iloc[0]) + 1, 0)
        mine, spell, a = np.empty(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        mine[order] = ids[np.cumsum(first) - 1]
        spell[order[at[often]]] = 1
        a[order[at]] = sums
        rows = zip(*[np.split(x, stops[:-1]) for x in (mine, spell, a)])
        return pd.DataFrame([(b, k, pack(i), pack(s), pack(c[s > 0])) for b, k, (i, s, c) in zip(part["block"], part["shard"], rows)], columns=["block", "shard", "ids", "spell", "a"])

    return requests.groupBy("shard").applyInPandas(run, "block string, shard int, ids binary, spell binary, a binary")


def coded(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """ids (the streams with the numbers of common words; 0 else), lang, and
    the id, a and word of what the block spells."""

    def run(block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        r, got = block.iloc[0], got.sort_values("shard")
        stream = unpack(r["stream"]).astype(np.int64)
        ids, own, spelt = np.zeros(int(stream.max(initial=0)) + 1, np.int64), np.zeros(0, np.int64), []
        if len(got):
            words = _words(r["words"], len(ids) - 1)
            order = _keys(r["lang"], words)[2]
            told = np.concatenate([unpack(x) for x in got["ids"]]).astype(np.int64)
            ids[order + 1] = told
            mine = np.flatnonzero(np.concatenate([unpack(x) for x in got["spell"]]))
            own, spelt = told[mine], [words[k].decode() for k in order[mine]]
        out = ids[stream]
        # of a run of zeros one is enough
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
        a = np.concatenate([unpack(x) for x in got["a"]]).astype(np.int64) if len(got) else own
        return pd.DataFrame({"ids": [pack(out[keep])], "lang": [r["lang"]], "id": [own.tolist()], "a": [a.tolist()], "word": [spelt]})

    schema = "ids binary, lang string, id array<long>, a array<long>, word array<string>"
    return blocks.select("block", "lang", "words", "stream").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


# ----------------------------------------------------------------- phrases
def _hashes(lanes: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(lanes[0]), np.uint64(len(lanes)))
    with np.errstate(over="ignore"):
        for x in lanes:
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + x)
    return out


def filters(streams: DataFrame, n: int, bits: int, skip: int, common) -> DataFrame:
    """shard and the filter of each block's phrases of n words."""
    width = 2 * bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = Bits(common.value) if common is not None else None
        for b in batches:
            for data in b["ids"]:
                ids = unpack(data)
                at = np.flatnonzero(ids)
                size = len(ids) - n + 1
                at = at[at < size]
                for j in range(1, n):
                    at = at[ids[at + j] != 0]
                if there is not None and len(at):
                    for s in (0, 1):
                        one, two = bit_places(_hashes([ids[at + s + j] for j in range(n - 1)]), there.size)
                        at = at[there.has(one) & there.has(two)]
                if not len(at):
                    continue
                columns = packed(permuted([ids[at + j] for j in range(n)], bits), bits)
                columns, counts = added(columns, np.ones(len(at), np.int64))
                cut = np.searchsorted(columns[0], np.arange(1, 1 << skip, dtype=np.uint64) << np.uint64(width - skip))
                cut = [0, *cut.tolist(), len(counts)]
                rows = [(s, *Filter.made([c[i:j] for c in columns], counts[i:j], width, skip)) for s, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
                yield pd.DataFrame(rows, columns=["shard", *Filter.FIELDS])

    return streams.mapInPandas(run, "shard int, quotients int, runs binary, remainders binary, rest_1 binary, rest_2 binary, counts binary")


def common_phrases(made: DataFrame, n: int, bits: int, skip: int, least: int) -> DataFrame:
    """ids, a, h of the phrases that the merged filters count ``least`` times or more."""
    width = 2 * bits

    def run(part: pd.DataFrame) -> pd.DataFrame:
        read = [Filter.read(r[1:], r[0], width, skip) for r in part[["shard", *Filter.FIELDS]].itertuples(index=False, name=None)]
        columns = [np.concatenate(c) for c in zip(*[c for c, _ in read])]
        columns, counts = added(columns, np.concatenate([c for _, c in read]))
        often = counts >= least
        lanes = restored(unpacked([c[often] for c in columns], n, bits), bits)
        ids = np.stack(lanes, axis=1).astype(np.int64)
        return pd.DataFrame({"ids": pd.Series(list(ids), dtype=object), "a": counts[often].astype(np.int64), "h": _hashes(lanes).view(np.int64)})

    return made.groupBy("shard").applyInPandas(run, "ids array<long>, a long, h long")


def _key(ids) -> F.Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def phrase_scores(words: DataFrame, phrases: DataFrame, totals: DataFrame, percent: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that are not dropped."""
    phrases = phrases.select(_key("ids").alias("key"), "ids", F.size("ids").alias("size"), "a")
    counts = words.select(F.col("id").cast("string").alias("part"), F.col("a").alias("f")).unionByName(phrases.select(F.col("key").alias("part"), F.col("a").alias("f")))
    ids, k = F.col("ids"), F.col("k")

    # what the phrase is inside of, one word longer
    longer = phrases.where("size > 2").select(F.explode(F.array(_key(F.slice(ids, F.lit(1), F.col("size") - 1)), _key(F.slice(ids, F.lit(2), F.col("size") - 1)))).alias("key"), "a")
    longer = longer.groupBy("key").agg(F.max("a").alias("most"))
    kept = phrases.join(longer, "key", "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")
    kept = materialize(kept, "kept")

    cuts = kept.select("key", "a", "size", "ids", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = materialize(cuts.select("key", "a", F.get("ids", F.lit(0)).alias("id"), "k", _key(F.slice(ids, F.lit(1), k)).alias("first"), _key(F.slice(ids, k + 1, F.col("size") - k)).alias("rest")), "cuts")
    n_cuts = cuts.count()
    for side, name in (("first", "l"), ("rest", "r")):
        hot = hot_keys(cuts.groupBy(side).agg(F.count(F.lit(1)).alias("_c")), [side], n_cuts)
        cuts = spread_join(cuts, counts.select(F.col("part").alias(side), F.col("f").alias(name)), [side], hot, ["key", "k"])
    cuts = materialize(cuts, "cuts")

    # words of the phrases, and the language that the first one's number stands for
    spelt = kept.select("key", F.posexplode("ids").alias("at", "id"))
    hot = hot_keys(spelt.groupBy("id").agg(F.count(F.lit(1)).alias("_c")), ["id"], spelt.count())
    spelt = spread_join(spelt, words.select("id", "lang", "word"), ["id"], hot, ["key"])
    spelt = spelt.groupBy("key").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))  # LONGEST words at most
    spelt = spelt.select("key", "lang", F.array_join(F.transform("words", lambda x: x.word), " ").alias("phrase")).join(totals, "lang")

    d = lambda c: F.col(c).cast("decimal(18,0)")
    rows = cuts.join(spelt, "key").select("key", "lang", "phrase", "n", "a", "k", "l", "r", (d("a") * d("n") * F.lit(1000).cast("decimal(4,0)")).alias("over"), (d("l") * d("r")).alias("under"))
    rows = rows.withColumn("score", F.expr("over div under"))
    return rows.groupBy("key", "lang", "phrase", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def mine(docs: DataFrame, least: int = 100, longest: int = LONGEST, percent: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of 2 to ``longest`` words
    (LONGEST at most) that occurs ``least`` times and is not dropped."""
    spark = docs.sparkSession
    blocks = written(word_blocks(docs, text, lang), "blocks")
    totals = written(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    shards = _shards(blocks.agg(F.sum("n_distinct")).first()[0] or 0)
    streams = written(coded(blocks, answered(asked(blocks, shards), shards, least)), "streams")
    words = streams.select("lang", F.explode(F.arrays_zip("id", "a", "word")).alias("w")).select(F.col("w.id").alias("id"), "lang", F.col("w.word").alias("word"), F.col("w.a").alias("a"))
    words = written(words, "words")
    size = words.agg(F.max("id").alias("id"), F.sum("a").alias("a")).first()
    bits, entries = max(1, int(size.id or 0).bit_length()), size.a or 0
    if bits > 32:
        raise ValueError("more common words than 32 bits can number")
    phrases, common = None, None
    for n in range(2, longest + 1):
        skip = min(2 * bits, _shards(entries).bit_length() - 1)
        level = written(common_phrases(filters(streams, n, bits, skip, common), n, bits, skip, least), f"phrases-{n}")
        phrases = level if phrases is None else phrases.unionByName(level)
        entries = level.agg(F.sum("a")).first()[0] or 0
        if not entries:
            break
        if n < longest:
            common = spark.sparkContext.broadcast(bitmap(level.select("h")))
    return phrase_scores(words, phrases.drop("h"), totals, percent)


def _shards(entries: int) -> int:
    """A power of two of shards of about SHARD entries."""
    return 1 << max(0, -(-entries // SHARD) - 1).bit_length()


def ranked(phrases: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language by score, count and phrase. A
    language's phrases are dealt over tasks that keep as many each."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return near.drop("part").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def op13_quotient_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(mine(table(spark, sf_dir, "documents")), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""WITH p AS (SELECT coalesce(lang,'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
tot AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w)-k+2), lambda i: array_to_string(w[i:i+k-1],' '))) AS phrase FROM w CROSS JOIN (SELECT unnest([1,2,3,4,5]) AS k) WHERE len(w)>=k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY 1,2,3 HAVING count(*)>=100),
parts AS (SELECT lang, k, phrase, a, string_split(phrase,' ') AS w FROM f WHERE k>1),
longer AS (SELECT DISTINCT p.lang, s.phrase FROM parts p JOIN f s ON s.lang=p.lang AND s.k=p.k-1 AND s.a=p.a AND s.phrase IN (array_to_string(p.w[1:p.k-1],' '), array_to_string(p.w[2:p.k],' '))),
cut AS (SELECT lang, k, phrase, a, i, array_to_string(w[1:i],' ') AS x, array_to_string(w[i+1:k],' ') AS y FROM (SELECT *, unnest(range(1, k)) AS i FROM parts)),
sc AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, t.n, (1000*c.a*t.n)//(l.a*r.a) AS score, i FROM cut c JOIN f l ON l.lang=c.lang AND l.phrase=c.x JOIN f r ON r.lang=c.lang AND r.phrase=c.y JOIN tot t ON t.lang=c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS b FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE b=1 AND NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang=best.lang AND x.phrase=best.phrase))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM rk WHERE rank<=2000"""
