import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vintage.llm import sentencepieces as sp
from vintage.llm import token_shards as ts


def strings(alphabet, n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_chunk_table_is_exact(odd):
    t = sp.ChunkTable(sp.default_model(), 50)  # small, so that it is emptied again and again
    for x in [*odd, *strings(" ▁ab\nthe é😀\tZ'.,日 <s>", 800), "  a  b ", "▁", "a▁▁", "x" * 300 + " y"]:
        want = t.lib.encode(x or "", add_eos=True)
        n, ids, decoded = t.encode(x)
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), t.lib.decode(want))


def test_crossing_pieces_are_found():
    assert sp.crossing_pieces(["▁a", "▁▁", "b"]) == []
    assert sp.crossing_pieces(["a▁b", "▁a▁"]) == ["a▁b", "▁a▁"]


def test_digest_query(documents, odd):
    got = {r.doc_id: r for r in sp.digest(documents(odd)).collect()}
    t = sp.ChunkTable(sp.default_model(), 1000)
    for i, x in enumerate(odd):
        ids = t.lib.encode(x or "", add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.lib.decode(ids).encode()).hexdigest()


def test_encode_keeps_other_columns(documents):
    out = sp.encode(documents(["a b"]).withColumnRenamed("source", "ids"))
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "ids", "decoded"]
    assert out.first().decoded == "a b"


def test_token_table_is_exact(odd):
    t = ts.TokenTable(ts.default_tokenizer(), 60)
    texts = [*odd, *strings(" ab\nthe'sé😀\tZ.,日1 \x1c\x85\xa0", 800), "<|endoftext|> a<|endoftext|> b", " lead", "trail ", "a  b", "\n a", "a \nb. c\nd.\ne"]
    want = [t.lib.encode(x or "", add_special_tokens=False).ids for x in texts]
    for size in (1, 7, len(texts)):
        for s in range(0, len(texts), size):
            ids, sizes = t.encode(pa.array(texts[s : s + size], pa.string()), 9)
            assert sizes.tolist() == [len(w) + 1 for w in want[s : s + size]]
            assert ids.tolist() == [i for w in want[s : s + size] for i in [*w, 9]]
    ids, sizes = t.encode(pa.array(["x", None, *texts], pa.string())[2:])  # a slice, and no end id
    assert ids.tolist() == [i for w in want for i in w] and len(sizes) == len(texts)


def test_slices_cover_all_rows():
    for texts in ([], [None, None], ["a" * 50, "b", None, "c" * 9, "d" * 200, "e"]):
        at = list(ts.slices(pa.array(texts, pa.string()), 20))
        assert [i for s, e in at for i in range(s, e)] == list(range(len(texts)))


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(10**12), 10**12, n))
    seeds = ts.build_mph(keys)
    assert sorted(ts.slots_of(keys, seeds, len(keys)).tolist()) == list(range(len(keys)))


def test_shards_round_trip(spark, documents, odd, tmp_path):
    texts = [*odd, *strings("ab the é. ", 60)]
    ids = [7 * i % 101 for i in range(len(texts))]
    path = f"file://{tmp_path}/shards"
    ts.write_shards(documents(texts, ids), path, block_ids=500, partition_rows=9)
    blocks = ts.read_shards(spark, path)
    got = {r.doc_id: r for r in ts.read_documents(blocks).collect()}
    lib, start, want = ts.TokenTable(ts.default_tokenizer(), 1000).lib, 0, {}
    for i, x in sorted(zip(ids, texts)):
        want[i] = [*lib.encode(x or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens) == (start, len(want[i]))
        assert got[i].ids_crc32 == zlib.crc32(np.array(want[i], "<u4").tobytes())
        start += len(want[i])
    assert len(got) == len(texts)
    # keyed access: some keys, half of them absent
    asked = spark.createDataFrame([(k,) for k in [*range(-3, 101, 2), 10**9 + 7, None]], "doc_id long")
    found = {r.doc_id: r for r in ts.find(blocks, asked).collect()}
    assert {k: list(r.ids) for k, r in found.items()} == {k: w for k, w in want.items() if k % 2}
    assert all(r.start == got[k].start for k, r in found.items())


def test_index_finds_all_keys_and_no_others(spark, documents, tmp_path):
    path = f"file://{tmp_path}/many"
    ts.write_shards(documents(["a b"] * 3000, [3 * i for i in range(3000)]), path, block_ids=100_000)
    for block in ts.read_shards(spark, path).collect():
        keys = np.frombuffer(block.order_keys, "<i8")
        assert (ts.look_up(block, keys)[0] == 3 * np.arange(len(keys))).all()
        assert (ts.look_up(block, keys + 1)[0] == -1).all() and (ts.look_up(block, keys, occurrence=np.ones(len(keys), int))[0] == -1).all()


def test_shards_empty_and_repeated(spark, documents, tmp_path):
    ts.write_shards(documents(["a"]).limit(0), f"file://{tmp_path}/none")
    none = ts.read_shards(spark, f"file://{tmp_path}/none")
    assert ts.read_documents(none).count() == ts.find(none, documents(["a"])).count() == 0
    # keys that repeat, null and negative ones, over several blocks and partitions
    texts, ids = ["a b", "c", None, "a b", "d e f", "g", "h"] * 20, [5, 5, None, 5, None, -1, -7] * 20
    for path, size in (("twice", 2_000_000), ("small", 7)):
        ts.write_shards(documents(texts, ids).withColumnRenamed("source", "payload"), f"file://{tmp_path}/{path}", block_ids=size, partition_rows=30)
        blocks = ts.read_shards(spark, f"file://{tmp_path}/{path}")
        rows = sorted(ts.read_documents(blocks).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted(ids, key=lambda i: -99 if i is None else i)
        assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
        asked = spark.createDataFrame([(5,), (None,), (6,)], "doc_id long")
        found = ts.find(blocks, asked).collect()
        assert sorted((r.start, r.n_tokens) for r in found) == sorted((r.start, r.n_tokens) for r in rows if r.doc_id in (5, None))


def test_starts_of_many_write_partitions(spark):
    """10,000 write partitions, several blocks each: sums of all before, without a row of them in the plan."""
    rows = spark.range(30_000).select((F.col("id") % 10_000).cast("int").alias("partition"), (F.col("id") % 13).alias("n_ids"))
    out = ts.starts(rows)
    sizes = {}
    for r in rows.collect():
        sizes[r.partition] = sizes.get(r.partition, 0) + r.n_ids
    total, want = 0, {}
    for p in sorted(sizes):
        want[p], total = total, total + sizes[p]
    assert {r.partition: r.start for r in out.collect()} == want
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
