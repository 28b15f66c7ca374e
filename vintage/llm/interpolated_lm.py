"""Operator 11: language-model scores by deleted interpolation.

P(w | v) = l2(b) c(v w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), with the
weights l chosen by the bucket b of the context's frequency c(v) (one for each
power of two, and one for contexts never seen).

The weights are learned by expectation-maximisation on held-out counts: the
training documents are dealt in two halves by a hash of their text (equal texts
together), and every token of one half is explained by the counts of the other,
so each document is held out once and none is lost. EM needs from a token only
its bucket and its two estimates; these are tallied over all tokens with
estimates rounded to an eighth of a power of two, a table of a size that does
not depend on the corpus, and EM runs on that table. The scores use exact counts
of both halves.

Counts on Spark: documents become blocks (see ``blocks``), each with its distinct
words and bigrams. These go out once, by range of hash, to shards that sum the
counts of all blocks and answer each block in the order it asked; a block and its
answers then meet by the block's name. So what is moved grows with the corpus, a
word or bigram is one entry a block however common it is, and shards are
cut so that each holds about ``SHARD`` entries. Words are told apart by 64-bit xxh3
hashes, bigrams by a mix of two of them.

Edge cases: null text is the empty text, which is one end token; a null id is not
held out, so it is learned from; rows of equal ids are each learned and scored;
a text of any length is read whole (one longer than a block is a block of its own);
without training documents every known count is 0 and only l0 and the
smoothing of the base are left; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.blocks import BLOCK, Numbers, distinct, pack, unpack, written
from vintage.llm.common import id_bucket, mix, table, words_of

#: Entries (a block's distinct word or bigram) that a shard sums at about.
SHARD = 1 << 21
#: Steps of rounded estimates to a power of two, and how many powers there are.
STEPS, POWERS = 8, 125
BUCKETS = 64
END = b""


# ----------------------------------------------------------------- blocks
def text_blocks(docs: DataFrame, held_out: Column, learned: Column, key: str, text: str) -> DataFrame:
    """block, ids, held, half (0 or 1, 2 if not learned from), sizes, stream,
    hashes (of the distinct words) and the tokens of each half."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0

        def block(numbers: Numbers, rows: list, streams: list) -> pd.DataFrame:
            ids, held, half, sizes = zip(*rows)
            total = [int(sum(s for s, h in zip(sizes, half) if h == k)) for k in (0, 1)]
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            one = (f"{part}-{made}", list(ids), pack(np.array(held)), pack(np.array(half)), pack(np.array(sizes)), pack(np.concatenate(streams)), pack(hashes), *total)
            return pd.DataFrame([one], columns=["block", "ids", "held", "half", "sizes", "stream", "hashes", "n_0", "n_1"])

        numbers, rows, streams, n = Numbers(), [], [], 0
        for b in batches:
            for i, held, learn, t in zip(b["_id"], b["_held"], b["_learn"], b["_text"]):
                data = (t or "").encode()
                words = words_of(data.lower())
                words.append(END)
                half = xxhash.xxh3_64_intdigest(data, 11) % 2 if learn else 2
                rows.append((i, held, half, len(words)))
                streams.append(numbers.stream(words))
                n += len(words)
                if n >= BLOCK:
                    yield block(numbers, rows, streams)
                    numbers, rows, streams, n, made = Numbers(), [], [], 0, made + 1
        if rows:
            yield block(numbers, rows, streams)

    rows = docs.select(F.col(key).cast("string").alias("_id"), held_out.alias("_held"), learned.alias("_learn"), F.col(text).alias("_text"))
    return rows.mapInPandas(run, "block string, ids array<string>, held binary, half binary, sizes binary, stream binary, hashes binary, n_0 long, n_1 long")


class Tokens:
    """A block's tokens with their contexts, and its distinct bigrams."""

    def __init__(self, stream: bytes, sizes: bytes) -> None:
        self.stream = unpack(stream).astype(np.int64)
        self.sizes = unpack(sizes).astype(np.int64)
        self.stops = np.cumsum(self.sizes)
        self.context = np.roll(self.stream, 1)  # of a first word the end of the text before it, which is the end token

    def bigrams(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes, and the place of each token's bigram."""
        with np.errstate(over="ignore"):
            return distinct(mix(hashes[self.context] * np.uint64(0xD6E8FEB86659FD93) + hashes[self.stream]))


def asked(blocks: DataFrame, shards: int) -> DataFrame:
    """shard, block, size (1 or 2 words), keys, and their counts in each half."""
    bits = shards.bit_length() - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                hashes, t = unpack(r.hashes), Tokens(r.stream, r.sizes)
                half = np.repeat(unpack(r.half), t.sizes)
                order = np.argsort(hashes)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                for size, (keys, place) in ((1, (hashes[order], rank[t.stream])), (2, t.bigrams(hashes))):
                    counts = [np.bincount(place[half == k], minlength=len(keys)) for k in (0, 1)]
                    edges = np.searchsorted(keys, np.arange(1, shards, dtype=np.uint64) << np.uint64(64 - bits)) if shards > 1 else []
                    cut = [0, *edges, len(keys)]
                    rows = [(s, r.block, size, pack(keys[i:j], rising=True), *[pack(c[i:j]) for c in counts]) for s, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
                    yield pd.DataFrame(rows, columns=["shard", "block", "size", "keys", "count_0", "count_1"])

    return blocks.select("block", "sizes", "half", "stream", "hashes").mapInPandas(run, "shard int, block string, size int, keys binary, count_0 binary, count_1 binary")


def answered(requests: DataFrame) -> DataFrame:
    """block, size, shard, and for the keys asked the counts of all blocks in
    each half; one row of each shard has how many words the training texts hold."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, rows in part.groupby("size"):
            keys = [unpack(k) for k in rows["keys"]]
            found, place = distinct(np.concatenate(keys))
            sums = [np.bincount(place, np.concatenate([unpack(c) for c in rows[name]]), len(found)).astype(np.int64) for name in ("count_0", "count_1")]
            stops = np.cumsum([len(k) for k in keys])
            rows = pd.DataFrame({
                "block": rows["block"].to_numpy(), "size": size, "shard": rows["shard"].to_numpy(), "known": 0,
                **{f"count_{k}": [pack(c) for c in np.split(s[place], stops[:-1])] for k, s in enumerate(sums)},
            })
            if size == 1:
                rows.loc[0, "known"] = int(np.sum(sums[0] + sums[1] > 0))
            out.append(rows)
        return pd.concat(out)

    return requests.groupBy("shard").applyInPandas(run, "block string, size int, shard int, known long, count_0 binary, count_1 binary")


def counted(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with the counts of their words and of each token's bigram."""

    def run(block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        r = block.iloc[0]
        hashes, t = unpack(r["hashes"]), Tokens(r["stream"], r["sizes"])
        order = np.argsort(hashes)
        place = t.bigrams(hashes)[1]
        out = {c: [r[c]] for c in ("ids", "held", "half", "sizes", "stream")}
        for k in (0, 1):
            of = [np.concatenate([unpack(c) for c in got[got["size"] == size].sort_values("shard")[f"count_{k}"]]) for size in (1, 2)]
            words = np.empty(len(hashes), np.uint64)
            words[order] = of[0]
            out |= {f"word_{k}": [pack(words)], f"bigram_{k}": [pack(of[1][place])]}
        return pd.DataFrame(out)

    schema = "ids array<string>, held binary, half binary, sizes binary, stream binary, word_0 binary, bigram_0 binary, word_1 binary, bigram_1 binary"
    own = blocks.select("block", "ids", "held", "half", "sizes", "stream", "hashes")
    return own.groupBy("block").cogroup(answers.drop("known").groupBy("block")).applyInPandas(run, schema)


# ---------------------------------------------------------------- weights
def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 and the whole part of log2."""
    return np.where(context > 0, np.frexp(context.astype(float))[1], 0)


def _step(estimate: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 and the rounded steps below 1."""
    with np.errstate(divide="ignore"):
        return np.where(estimate > 0, 1 + np.clip(np.rint(-STEPS * np.log2(estimate)), 0, STEPS * POWERS), 0).astype(np.int64)


def _divide(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    b = np.broadcast_to(np.asarray(b, float), np.shape(a))
    return np.divide(a, b, out=np.zeros(np.shape(a)), where=b > 0)


def held_out_tally(blocks: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """code, n: tokens of either half by bucket and estimates from the other."""
    width = STEPS * POWERS + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                t = Tokens(r.stream, r.sizes)
                half = np.repeat(unpack(r.half), t.sizes)
                for k, (words, pairs) in enumerate(((r.word_1, r.bigram_1), (r.word_0, r.bigram_0))):
                    own = half == k
                    words, pairs = unpack(words).astype(np.int64), unpack(pairs)[own]
                    context = words[t.context[own]]
                    code = (bucket(context) * width + _step(_divide(pairs, context))) * width + _step(_divide(words[t.stream[own]], totals[1 - k]))
                    codes, n = np.unique(code, return_counts=True)
                    yield pd.DataFrame({"code": codes, "n": n})

    return blocks.select("half", "sizes", "stream", "word_0", "bigram_0", "word_1", "bigram_1").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def learned_weights(codes: np.ndarray, n: np.ndarray, known: int, rounds: int = 200, least: float = 1e-7) -> np.ndarray:
    """(BUCKETS, 3): weights of bigram, word and uniform estimate by EM. A
    bucket without held-out tokens has the weights of the nearest below it."""
    width = STEPS * POWERS + 2
    at, steps = codes // (width * width), np.stack([codes // width % width, codes % width])
    p = np.ones((3, len(codes)))
    p[:2] = np.where(steps > 0, np.exp2(-(steps - 1) / STEPS), 0.0)
    p[2] = 1 / (known + 1)
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = (0, 0.5, 0.5)
    total = np.bincount(at, n, BUCKETS)
    for _ in range(rounds):
        share = out[at].T * p
        share /= share.sum(axis=0)
        new = np.stack([np.bincount(at, n * s, BUCKETS) for s in share], axis=1)
        new = np.where(total[:, None] > 0, new / np.maximum(total, 1)[:, None], out)
        done, out = np.abs(new - out).max() < 1e-9, new
        if done:
            break
    for b in range(2, BUCKETS):
        if not total[b]:
            out[b] = out[b - 1]
    out[:, 2] = np.maximum(out[:, 2], least)
    return out / out.sum(axis=1, keepdims=True)


# ------------------------------------------------------------------ scores
def scored(blocks: DataFrame, weights: np.ndarray, total: int, known: int) -> DataFrame:
    """id, held_out, n_tokens, n_known, base_score, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                t = Tokens(r.stream, r.sizes)
                words = (unpack(r.word_0) + unpack(r.word_1)).astype(np.int64)
                pairs = (unpack(r.bigram_0) + unpack(r.bigram_1)).astype(np.int64)
                count, context = words[t.stream], words[t.context]
                w = weights[bucket(context)]
                p = w[:, 0] * _divide(pairs, context) + w[:, 1] * _divide(count, total) + w[:, 2] / (known + 1)
                base = np.log10((count + 0.5) / (total + 0.5 * (known + 1)))
                start = t.stops - t.sizes
                yield pd.DataFrame({
                    "id": list(r.ids), "held_out": unpack(r.held).astype(bool), "n_tokens": t.sizes, "n_known": np.add.reduceat((count > 0).astype(np.int64), start),
                    "base_score": np.add.reduceat(base, start), "score": np.add.reduceat(np.log10(p), start),
                })

    return blocks.mapInPandas(run, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, held_out: Column, learned: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row; counts come from the rows where ``learned`` is true."""
    blocks = written(text_blocks(docs, held_out, learned, key, text), "blocks")
    sums = blocks.agg(F.sum("n_0").alias("n_0"), F.sum("n_1").alias("n_1"), F.count(F.lit(1)).alias("n")).first()
    n_0, n_1 = sums.n_0 or 0, sums.n_1 or 0
    shards = 1 << max(0, (2 * sums.n * BLOCK // SHARD - 1).bit_length())
    answers = written(answered(asked(blocks, shards)), "answers")
    known = answers.agg(F.sum("known")).first()[0] or 0
    full = written(counted(blocks, answers), "counted")
    tally = held_out_tally(full, (n_0, n_1)).collect()  # BUCKETS * (STEPS * POWERS + 2) ** 2 rows at most
    weights = learned_weights(np.array([r.code for r in tally], np.int64), np.array([r.n for r in tally], float), known)
    out = scored(full, weights, n_0 + n_1, known)
    return out.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key), "held_out", "n_tokens", "n_known", F.lit(n_0 + n_1).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op11_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(id_bucket("doc_id", 5) == 1, F.lit(False))
    return score_texts(table(spark, sf_dir, "documents"), held, ~held)
