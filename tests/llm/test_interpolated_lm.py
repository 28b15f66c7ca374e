"""Operator 11 against counting in plain Python, and its weights against the optimum's conditions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vintage.llm import interpolated_lm as L
from vintage.llm.blocks import distinct, pack, unpack
from vintage.llm.common import id_bucket


@pytest.mark.parametrize("rising", [False, True])
def test_pack_round_trip(rising):
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([0, 0]), np.array([2**64 - 1], np.uint64), rng.integers(0, 2**63, 1000), rng.integers(0, 200, 1000)):
        values = np.sort(values.astype(np.uint64)) if rising else values.astype(np.uint64)
        assert (unpack(pack(values, rising)) == values).all()


def test_distinct_is_unique():
    codes = np.random.default_rng(2).integers(0, 50, 400)
    found, place = distinct(codes)
    assert (found == np.unique(codes)).all() and (found[place] == codes).all()


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def step(f):
    return 0 if f <= 0 else 1 + min(max(int(np.rint(-8 * np.log2(f))), 0), 1000)


def plain(rows):
    """doc_id -> (held_out, n_tokens, n_known, N, base, score) by counting in one pass of each half."""
    ones, twos = [Counter(), Counter()], [Counter(), Counter()]
    half = {}
    for k, (i, text) in enumerate(rows):
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        half[k] = None if held else xxhash.xxh3_64_intdigest((text or "").encode(), 11) % 2
        if not held:
            t = tokens(text)
            ones[half[k]].update(t)
            twos[half[k]].update(zip([b"", *t], t))
    n = [sum(c.values()) for c in ones]
    known = len({w for c in ones for w in c})
    tally, width = Counter(), 8 * 125 + 2
    for k, (_, text) in enumerate(rows):
        if half[k] is not None:
            other, t = 1 - half[k], tokens(text)
            for v, w in zip([b"", *t], t):
                c = ones[other][v]
                f2, f1 = twos[other][v, w] / c if c else 0, ones[other][w] / n[other] if n[other] else 0
                tally[(c.bit_length() * width + step(f2)) * width + step(f1)] += 1
    lam = L.learned_weights(np.array([*tally], np.int64), np.array([*tally.values()], float), known)
    total, out = sum(n), []
    for i, text in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for v, w in zip([b"", *t], t):
            c, cv, cvw = (ones[0][w] + ones[1][w], ones[0][v] + ones[1][v], twos[0][v, w] + twos[1][v, w])
            base += math.log10((c + 0.5) / (total + 0.5 * (known + 1)))
            a, b, u = lam[cv.bit_length()]
            score += math.log10(a * (cvw / cv if cv else 0) + b * (c / total if total else 0) + u / (known + 1))
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        out.append((i, held, len(t), sum(ones[0][w] + ones[1][w] > 0 for w in t), total, base, score))
    return out


def run(docs):
    held = F.coalesce(id_bucket("doc_id", 5) == 1, F.lit(False))
    return [tuple(r) for r in L.score_texts(docs, held, ~held).collect()]


def same(found, expected):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    found, expected = sorted(found, key=key), sorted(expected, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-9)


def test_scores_equal_plain_counts(documents, prose, odd):
    texts = [prose(60) for _ in range(30)] + ["The the THE of Of"] * 3 + odd
    ids = [*range(len(texts) - 2), None, 7]
    docs = documents(texts, ids).selectExpr("*", "1 AS half", "'x' AS block", "2 AS score")
    same(run(docs), plain(list(zip(ids, texts))))


def test_small_blocks_and_shards_change_nothing(documents, prose):
    """Copies, a word in a third of the text, and many partitions, so many blocks."""
    texts = [prose(40, seed=k % 9) + " hot" * 20 for k in range(60)]
    docs = documents(texts).repartition(7)
    same(run(docs), plain(list(enumerate(texts))))


def test_shards_by_leading_bits(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 1 << 16)  # read by the driver alone: 16 shards to a block
    texts = [prose(50) for _ in range(20)]
    same(run(documents(texts)), plain(list(enumerate(texts))))


def test_nothing_to_learn_from(documents):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    same(run(documents(["a b", "", "a"], ids)), plain(list(zip(ids, ["a b", "", "a"]))))
    assert run(documents([])) == []


def test_weights_are_the_held_out_optimum():
    """At the maximum, tokens weighted by estimate / mixture sum to their number for each weight above 0, and to no more for others."""
    rng, width = np.random.default_rng(4), 8 * 125 + 2
    codes = np.unique((3 * width + rng.integers(0, 80, 300)) * width + rng.integers(1, 120, 300))
    n = rng.integers(1, 50, len(codes)).astype(float)
    lam = L.learned_weights(codes, n, 1000, rounds=20_000)
    steps = np.stack([codes // width % width, codes % width])
    p = np.vstack([np.where(steps > 0, np.exp2(-(steps - 1) / 8), 0), np.full(len(codes), 1 / 1001)])
    grade = (n * p / (lam[3] @ p)).sum(axis=1) / n.sum()
    assert (grade < 1 + 1e-3).all() and np.allclose(grade[lam[3] > 1e-3], 1, atol=1e-3)
    assert np.allclose(lam.sum(axis=1), 1) and (lam[:, 2] > 0).all()


def test_interpolation_beats_the_base_on_held_out_text(documents, prose):
    """Texts in which a word mostly follows one other; unlike words dealt freely, the pairs tell."""
    rng, words = random.Random(6), prose(40, seed=1).split()

    def chain():
        out = [0]
        for _ in range(120):
            out.append((out[-1] * 7 + 3) % 40 if rng.random() < 0.8 else rng.randrange(40))
        return " ".join(words[k] for k in out)

    rows = run(documents([chain() for _ in range(80)]))
    held = [r for r in rows if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)
