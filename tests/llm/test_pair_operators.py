"""Operators across texts, against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vintage.llm import circulant_minhash, entries, graph, spaced_seeds, suffix_dedup
from vintage.llm.common import materialize, prefix_hashes, word_hashes
from vintage.llm.graph import components


def edited(text, rng, share):
    words = text.split()
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = f"z{rng.randint(0, 10**6)}"
    return " ".join(words)


@pytest.fixture
def corpus(prose, odd):
    rng = random.Random(4)
    base = [prose(120, seed=i) for i in range(12)]
    out = [*odd, *base, *base[:3], *[edited(base[0], rng, rng.choice([0.01, 0.03, 0.05, 0.08])) for _ in range(60)]]
    out += [edited(base[1], rng, 0.02).upper() for _ in range(5)] + [base[2] + " " + base[3], "a b c", "A B C", "a b c d"]
    return out


# ------------------------------------------------------- circulant MinHash
def brute_components(texts, ids, size):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i in range(len(texts)):
        least[find(i)].append(ids[i])
    return {ids[i]: (len(sets[i]), min(least[find(i)])) for i in range(len(texts))}


@pytest.mark.parametrize("few", [8, 2])
def test_near_duplicates(documents, corpus, monkeypatch, few):
    monkeypatch.setattr(circulant_minhash, "FEW", few)
    monkeypatch.setattr(circulant_minhash, "BLOCK", 16)
    ids = [(37 * i) % 1009 for i in range(len(corpus))]
    want = brute_components(corpus, ids, 4)
    got = {r.doc_id: r for r in circulant_minhash.near_duplicates(documents(corpus, ids), size=4).collect()}
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (*want[i], want[i][1] == i)


def test_near_duplicates_odd_ids(documents, prose):
    a, b = prose(50, seed=1), prose(50, seed=2)
    rows = circulant_minhash.near_duplicates(documents([a, a, b, b, a], [5, None, 5, 9, 7])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 5), (5, 5), (5, 5), (7, 5), (9, 5)]
    assert circulant_minhash.near_duplicates(documents([])).count() == 0


def test_blocks_meet_all_sets_that_can_be_linked(spark, monkeypatch):
    """Sizes from one shingle to thousands, in one bucket: every two sets of near
    sizes meet in a task, no task holds much more than two blocks' shingles, and
    the links are those of all pairs."""
    monkeypatch.setattr(circulant_minhash, "BLOCK", 30)
    monkeypatch.setattr(circulant_minhash, "BLOCK_SHINGLES", 4000)
    rng = np.random.default_rng(5)
    sets = []
    for i in range(160):
        old = sets[rng.integers(len(sets))] if sets and i % 2 else rng.integers(0, 1 << 40, int(1.06 ** rng.integers(0, 120)) + 1)
        sets.append(np.unique(np.concatenate([old[rng.random(len(old)) < 0.95], rng.integers(0, 1 << 40, 1)])))
    placed = spark.createDataFrame([(9, i, i // 2, len(s)) for i, s in enumerate(sets)], "bucket long, node long, part long, n long")
    tasks = collections.defaultdict(dict)
    for r in circulant_minhash.dealt_blocks(placed, 80).collect():
        tasks[r.size_class, r.i, r.j][r.node] = r.n
    assert max(sum(t.values()) for t in tasks.values()) < 4 * 4000
    met = {pair for t in tasks.values() for pair in itertools.combinations(sorted(t), 2)}
    want = set()
    for u, v in itertools.combinations(range(len(sets)), 2):
        a, b = len(sets[u]), len(sets[v])
        if u // 2 != v // 2 and 100 * min(a, b) >= 80 * max(a, b):
            assert (u, v) in met
            both = len(np.intersect1d(sets[u], sets[v]))
            if 100 * both >= 80 * (a + b - both):
                want.add((u, v))
    held = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, shingles array<long>")
    got = {(r.u, r.v) for r in circulant_minhash.compare_blocks(placed, held, 80).collect()}
    assert got == want and len(want) > 20


def test_words_made_to_collide_in_the_polynomial():
    """The two sequences of Thue and Morse agree under any polynomial modulo 2**64."""
    bits = np.array([bin(i).count("1") % 2 for i in range(2048)])
    one, two = (np.where(b, ord("b"), ord("a")).astype(np.uint8) for b in (bits, 1 - bits))
    ends = [prefix_hashes(w)[-1] for w in (one, two)]
    assert ends[0] == ends[1]
    hashes = word_hashes(np.concatenate([one, [32], two, [32], one]).astype(np.uint8))[0]
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_signature_is_circulant():
    p = circulant_minhash.Permutations(8)
    s = np.array([5 << 44, 9 << 44, 77 << 44], np.uint64)
    second = p.shifted[:, -1]
    place = p.deal[[5, 9, 77]]
    want = [min(second[(i - k) % circulant_minhash.UNIVERSE] for i in place) for k in range(8)]
    assert p.signature(s, at_once=2)[::-1].tolist() == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_components_write_as_many_tables_whatever_the_path(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    order = np.random.default_rng(5).permutation(3000).tolist()
    links = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long").repartition(7)
    assert {r.component for r in components(links).collect()} == {0}
    assert len(written) <= 5


@pytest.mark.parametrize("chunk", [1 << 18, 40])
def test_components_of_a_random_graph(spark, monkeypatch, chunk):
    """Over several chunks; with small ones, what is left of them goes through the rounds."""
    monkeypatch.setattr(graph, "CHUNK", chunk)
    pairs = np.random.default_rng(6).integers(-500, 500, (700, 2)).tolist()
    want = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in want:
        for u, v in pairs:
            if u != v:
                want[u] = want[v] = min(want[u], want[v])
    got = components(spark.createDataFrame(pairs, "u long, v long").repartition(9)).collect()
    assert len(got) == len(want) and {r.id: r.component for r in got} == want


# ---------------------------------------------------------- suffix removal
def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), len(r) - len(rest), len(suffix_dedup.runs(gone)), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("most, segment", [(2000, 1 << 19), (2, 1500), (0, 1 << 19)])
def test_suffix_removal(documents, corpus, prose, monkeypatch, most, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)  # of this process: the workers keep their own
    passage = prose(60, seed=77)
    texts = corpus + [prose(20, seed=i) + " " + passage + " " + prose(20, seed=50 + i) for i in range(12)] + ["ab" * 400, "q" * 350, "q" * 399, "q" * 3000, passage * 3]
    texts += [prose(i, seed=900 + i) + passage[i:] for i in range(9)] + [passage[: 400 + i] + "é" * i for i in range(5)]
    texts += [None, "", "é" * 300]
    out = suffix_dedup.deduplicated(documents(texts), most=most).withColumn("sha", F.sha2("kept", 256))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 400)


def test_segments_meet_every_string_once(prose):
    rows = [(1, 0, np.frombuffer(prose(900, seed=3).encode(), np.uint8)), (2, 0, np.frombuffer(b"x" * 399, np.uint8)), (3, 0, np.frombuffer(prose(90, seed=4).encode(), np.uint8))]
    whole = collections.Counter()
    for r, _, data in rows:
        whole.update((r, i) for i in range(len(data) - 399))
    for size in (500, 1500, 1 << 19):
        met = collections.Counter()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(suffix_dedup, "SEGMENT", size)
            for b in suffix_dedup.anchor_rows(iter(rows)):
                for x in b.to_pylist():
                    for p in x["places"]:
                        met.update((x["row"], i) for i in range(p - x["before"], p + x["after"] - 399))
        assert met == whole


def test_equal_hashes_of_different_strings_raise(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "span_hashes", lambda prefix, a, b: np.zeros(len(a), np.uint64))
    with pytest.raises(RuntimeError, match="two different strings"):
        suffix_dedup.repeated_offsets(np.zeros(2, np.int64), [b"a" * 450, b"b" * 450], np.array([20, 20]))


def test_suffix_sort():
    rng = random.Random(8)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    group = np.array([rng.randint(0, 3) for _ in strings])
    s = suffix_dedup.Suffixes(group, [np.frombuffer(x, np.uint8) for x in strings])
    order = [(group[i], strings[i]) for i in s.order]
    assert order == sorted(order)
    for (g, x), (h, y), m in zip(order, order[1:], s.shared.tolist()):
        assert m == (len(__import__("os").path.commonprefix([x, y])) if g == h else 0)


def test_suffix_removal_repeated_rows_and_empty(documents, prose):
    t = prose(200, seed=1)
    rows = suffix_dedup.deduplicated(documents([t, t, t + "x"], [1, 1, None])).collect()
    assert sorted(r.n_removed for r in rows) == sorted([len(t), len(t), len(t)])
    assert suffix_dedup.deduplicated(documents([])).count() == 0


# --------------------------------------------------------- decontamination
def test_contamination(spark, documents, prose, odd):
    items = [prose(n, seed=500 + n) for n in (15, 24, 40, 60)] + ["four rare zq words", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    swap = items[2].split()
    for i in (6, 17, 29):
        swap[i] = "changed"
    texts = [prose(50, seed=i) + " " + x + " " + prose(30, seed=90 + i) for i, x in enumerate([*items[:4], " ".join(swap), items[3].upper() + "!!", items[4]])]
    clean = [prose(100, seed=i) for i in range(200, 230)]
    docs = documents([*texts, *clean, *odd])
    got = sorted((r.doc_id, r.item_id) for r in spaced_seeds.contaminated(docs, bench).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 2), (5, 3), (6, 4)]
    assert spaced_seeds.contaminated(documents([]), bench).count() == 0
    assert spaced_seeds.contaminated(docs, bench.limit(0)).count() == 0


def test_overlap_tolerates_substitutions():
    a = np.arange(30)
    b = a.copy()
    b[[5, 14]] = -1
    assert spaced_seeds.overlap(np.concatenate([[99, 98], b]), a, 2) == 28
    assert spaced_seeds.overlap(b[:4], a, 10) == 0


def test_one_in_five_words_changed(spark, documents, prose):
    items = [prose(20, seed=700), prose(10, seed=701)]
    long, short = items[0].split(), items[1].split()
    long[2::5] = ["changed"] * 4
    short[5] = "changed"
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents([prose(30, seed=i) + " " + " ".join(x) + " " + prose(30, seed=90 + i) for i, x in enumerate([long, short])])
    got = {(r.doc_id, r.item_id): r.overlap for r in spaced_seeds.contaminated(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 1)} and got[0, 0] >= 16 and got[1, 1] >= 9


def test_overlap_is_the_best_stretch_and_short_masks_are_complete():
    rng = random.Random(9)
    for _ in range(200):
        a = np.arange(rng.randint(1, 24))
        b = np.where([rng.random() < 0.75 for _ in a], a, -1)
        same = (a == b).tolist()
        spans = [same[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1)]
        assert spaced_seeds.overlap(b, a, 0) == max([sum(x) for x in spans if sum(x) >= 4 * (len(x) - sum(x))], default=0)
    for n in range(1, spaced_seeds.SPAN):
        for gone in itertools.combinations(range(n), n - -(-8 * n // 10)):
            assert any(all(m[j] == "0" for j in gone) for m in spaced_seeds.short_masks(n))


# ---------------------------------------------------------------- pipeline
def test_pipeline(spark, tmp_path, documents, prose):
    clean = [prose(80, seed=i) for i in range(40)]
    item = prose(30, seed=999)
    texts = [*clean, clean[0], edited(clean[1], random.Random(1), 0.005), "too short", None, clean[2] + " " + item, prose(70, seed=70) + " token=abcdefghijklmnop"]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 42), 0) for i in range(46)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {40, 41, 42, 43, 44}.isdisjoint(out) and set(range(40)) <= set(out)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_registered_names():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in entries.QUERIES}
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["quality rules", "near duplicates"]


@pytest.mark.parametrize(("length", "changed", "least"), [(10, 0, 1.0), (11, 1, 1.0), (12, 2, 1.0), (13, 2, 1.0), (14, 2, 1.0), (15, 3, 0.997), (16, 3, 1.0), (18, 3, 1.0)])
def test_masks_find_substituted_passages(length, changed, least):
    """Of all placements of the changed words, the share that some window of some mask ignores."""
    hit = total = 0
    for out in itertools.combinations(range(length), changed):
        total += 1
        hit += any(all(m[j] == "0" or at + j not in out for j in range(len(m))) for m in spaced_seeds.MASKS for at in range(length - len(m) + 1))
    assert hit >= least * total


def test_substituted_passages_equal_brute_force(documents, spark):
    """Items cut out and changed at random: what is reported is what comparing every diagonal finds."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    items = [" ".join(word() for _ in range(n)) for n in (60, 30, 12, 11, 10, 5, 3)]
    texts = []
    for k in range(400):
        w = rng.choice(items).split()
        n = rng.randrange(min(8, len(w)), min(len(w), 26) + 1)
        at = rng.randrange(len(w) - n + 1)
        w = w[at : at + n]
        for j in rng.sample(range(n), rng.randrange(n // 5 + 1)):
            w[j] = word()
        texts.append(" ".join([word() for _ in range(rng.randrange(30))] + w + [word() for _ in range(rng.randrange(30))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap for r in spaced_seeds.contaminated(documents(texts), bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        doc = spaced_seeds.tokens(t)
        for j, item in enumerate(items):
            own = spaced_seeds.tokens(item)
            most = max(spaced_seeds.overlap(doc, own, s) for s in range(-len(own), len(doc)))
            if most >= min(10, -(-8 * len(own) // 10)):
                want[i, j] = most
    assert got.keys() <= want.keys() and all(got[k] == want[k] for k in got)
    assert len(want) > 150 and len(got) >= 0.99 * len(want)
