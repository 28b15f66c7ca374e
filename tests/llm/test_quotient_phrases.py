"""Operator 13 against counting in plain Python, and its filters against their input."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vintage.llm import quotient_phrases as Q


@pytest.mark.parametrize("n", [2, 3, 4, 5])
@pytest.mark.parametrize("bits", [1, 7, 17, 32])
def test_permutation_is_inverted(n, bits):
    rng = np.random.default_rng(n * bits)
    lanes = [rng.integers(0, 1 << bits, 500, dtype=np.uint64) for _ in range(n)]
    mixed = Q.permuted(lanes, bits)
    assert all((x < np.uint64(1 << bits)).all() for x in mixed)
    back = Q.unpacked(Q.packed(mixed, bits), n, bits)
    assert all((x == y).all() for x, y in zip(Q.restored(back, bits), lanes))


@pytest.mark.parametrize("n", [2, 3, 5])
@pytest.mark.parametrize("skip", [0, 3])
def test_filter_is_lossless_and_merges(n, skip):
    """Two filters of shard 5 (of 8) or of all, read and merged, are the sums of what went in."""
    rng, bits = np.random.default_rng(n), 9
    sums, read = Counter(), []
    for _ in range(2):
        lanes = [rng.integers(0, 1 << bits, 800, dtype=np.uint64) for _ in range(n)]
        if skip:
            lanes[0] = (lanes[0] & np.uint64((1 << (bits - skip)) - 1)) | np.uint64(5 << (bits - skip))
        columns, counts = Q.added(Q.packed(lanes, bits), np.ones(800, np.int64))
        sums.update(dict(zip(zip(*map(np.ndarray.tolist, columns)), counts.tolist())))
        read.append(Q.Filter.read(Q.Filter.made(columns, counts, 2 * bits, skip), 5 if skip else 0, 2 * bits, skip))
    columns, counts = Q.added([np.concatenate(c) for c in zip(*[c for c, _ in read])], np.concatenate([c for _, c in read]))
    assert dict(zip(zip(*map(np.ndarray.tolist, columns)), counts.tolist())) == dict(sums)


def plain(rows, least, percent=100):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = {(q[0], *q[i:j]) for q, b in often.items() for i in range(1, len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) - 1 and 100 * b >= percent * f[(q[0], *q[i:j])]}
    out = []
    for (lang, *w), a in often.items():
        if (lang, *w) not in dropped:
            score, k = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "éa", "日本", "x", "new", "york", "\x00", "\x1f", "a-b"]
    made = ["new york of the x"] * 9 + [None, "", " \t", "the", "New  York\tof. the\nx!? a-b"]
    for _ in range(n):
        made.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in range(rng.randrange(1, 40))))
    return made


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_phrases_equal_plain_counts(documents):
    made = texts(1) + ["hot " * 900 + "pot"]
    langs = [[None, "en", "fr"][i % 3] for i in range(len(made))]
    docs = documents(made, langs=langs).selectExpr("*", "1 AS n", "'x' AS block", "2 AS a").repartition(5)
    for least, percent in ((4, 100), (3, 80)):
        assert found(Q.mine(docs, least=least, percent=percent)) == sorted(plain(list(zip(langs, made)), least, percent))


def test_many_shards_change_nothing(documents, monkeypatch):
    monkeypatch.setattr(Q, "SHARD", 64)  # read by the driver alone
    made = texts(2)
    assert found(Q.mine(documents(made), least=3)) == sorted(plain([("en", t) for t in made], 3))


def test_ranks_and_ties(spark):
    rows = [("en", f"p {i}", 5 + i % 2, 1, 1, 1, 10 - i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = [(r.rank, r.phrase) for r in Q.ranked(df, 50).orderBy("rank").collect()]
    best = sorted(rows, key=lambda r: (-r[6], -r[2], r[1].encode()))[:50]
    assert got == [(k + 1, r[1]) for k, r in enumerate(best)]


def test_scores_beyond_64_bits_are_exact(spark):
    """Products of 10**30: the quotient is exact where doubles and longs are not."""
    big = [(10**14 + 7, 10**13 + 3, 10**13 + 9), (10**15 - 1, 999_999_999_989, 999_999_999_961)]
    for n, left, right in big:
        words = spark.createDataFrame([(1, "en", "x", left), (2, "en", "y", right)], "id long, lang string, word string, a long")
        a = min(left, right) - 12345
        phrases = spark.createDataFrame([([1, 2], a)], "ids array<long>, a long")
        totals = spark.createDataFrame([("en", n)], "lang string, n long")
        (row,) = Q.phrase_scores(words, phrases, totals, 100).collect()
        assert row.score == 1000 * a * n // (left * right)


def test_no_phrases(documents):
    assert found(Q.mine(documents([]))) == []
    assert found(Q.mine(documents([None, "", "a b c"]))) == []
