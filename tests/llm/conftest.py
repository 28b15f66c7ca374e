import random

import pytest

WORDS = "the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there".split()


@pytest.fixture
def prose():
    rng = random.Random(11)

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join(r.choice(WORDS) + r.choice(["", "", "er", "ing", "ly", "ed"]) for _ in range(n))

    return make


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents rows from texts; ids as given or counted."""

    def make(texts, ids=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def odd():
    """Texts that every operator must take: none, empty, blank, one letter, a very long one, repeats."""
    return [None, "", " \n\t ", "a", "word " * 20_000, "é" * 5000, "same text here", "same text here", "\x00 \x1f 日本語 😀"]
