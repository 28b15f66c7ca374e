"""Null ids beyond 2**53, empty tables, clashing columns, very long texts, ties: every operator and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vintage.llm import byte_cnn, circulant_minhash, common, html_crf, quality_rules, rule_ensemble, secret_scan, sentencepieces, spaced_seeds, suffix_dedup, token_shards
from vintage.llm.common import hot_keys, spread_join

BIG = 2**62 + 1  # not a double


@pytest.fixture
def clashing(documents, prose):
    """Rows with null and very large ids, a null, an empty and a very long text, a tie, and columns named like the operators' own."""
    texts = [prose(80, seed=1), prose(80, seed=1), None, "", "word " * 60_000, prose(70, seed=2), prose(70, seed=2)]
    ids = [BIG, BIG + 1, None, 7, None, 9, 9]
    names = "spans base_spans kept llr n_words n n_bytes size row bands node ids decoded region start words h item score p _key _text _id text_hash".split()
    return documents(texts, ids).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def seen(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())


RUNS = {
    "secret_scan": lambda d: secret_scan.scan(d),
    "redact": lambda d: secret_scan.redact(d),
    "rule_ensemble": lambda d: rule_ensemble.statistics(d),
    "suffix_dedup": lambda d: suffix_dedup.deduplicated(d),
    "circulant_minhash": lambda d: circulant_minhash.near_duplicates(d),
    "byte_cnn": lambda d: byte_cnn.predict(d, byte_cnn.fit(d, F.lit(True), max_rows=4)),
    "sentencepieces": lambda d: sentencepieces.digest(d),
    "sentencepieces_encode": lambda d: sentencepieces.encode(d),
    "quality_rules": lambda d: quality_rules.judge(d, d.select("doc_id").where("doc_id is not null").limit(2), threshold=None),
}


@pytest.mark.parametrize("name", RUNS)
def test_all_rows_come_back_with_their_ids(clashing, name):
    assert seen(RUNS[name](clashing)) == seen(clashing)
    assert RUNS[name](clashing.limit(0)).count() == 0


def test_shards(clashing, tmp_path, spark):
    token_shards.write_shards(clashing, f"file://{tmp_path}/s")
    assert seen(token_shards.read_documents(token_shards.read_shards(spark, f"file://{tmp_path}/s"))) == seen(clashing)


def test_contamination(spark, clashing, prose):
    items = [(None, prose(80, seed=1), 1), (BIG, prose(70, seed=2), 2), (3, None, 3), (4, "", 4)]
    bench = spark.createDataFrame(items, "item_id long, text string, h int")
    got = spaced_seeds.contaminated(clashing, bench)
    assert sorted((r.doc_id, r.item_id or 0) for r in got.collect()) == [(9, BIG), (BIG, 0), (BIG + 1, 0)]
    assert spaced_seeds.contaminated(clashing.limit(0), bench).count() == spaced_seeds.contaminated(clashing, bench.limit(0)).count() == 0


def test_redact_keeps_columns(clashing):
    out = secret_scan.redact(clashing)
    assert out.columns == clashing.columns and out.where("n_words = 4 and spans = 0").count() == clashing.count()


def test_pages_with_large_ids(spark):
    pages = spark.createDataFrame([(BIG, "u", "<p>x", None), (None, "u", None, BIG)], "page_id long, url string, html string, extra long")
    got = html_crf.extract(pages, html_crf.train([], 3)).collect()
    assert [(r.page_id, r.extra) for r in got] == [(BIG, None), (None, BIG)]


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    left = spark.range(100).select((F.col("id") % 3).alias("k"), "id").union(spark.range(2).select(F.lit(9).alias("k"), "id"))
    right = spark.createDataFrame([(0, "a"), (1, "b"), (4, "c")], "k long, v string")
    hot = hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("_c")), ["k"], 102)
    assert {r.k for r in hot.collect()} == {0, 1, 2} and hot.agg(F.min("_fan")).first()[0] >= 3
    for how in ("inner", "left"):
        want = left.join(right, ["k"], how)
        got = spread_join(left, right, ["k"], hot, ["id"], how).select(want.columns)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_near_duplicates_with_hot_keys_and_shared_ids(documents, prose, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    base = prose(150, seed=5)
    texts = [base] * 12 + [base.replace(w, "zz", 1) for w in base.split()[:12]] + [prose(60, seed=6), base]
    ids = [*range(10, 34), 10, 50]  # id 10 has two texts
    rows = circulant_minhash.near_duplicates(documents(texts, ids)).collect()
    assert {r.component_id for r in rows} == {10} and len(rows) == 26
    assert sorted(r.doc_id for r in rows if r.kept) == [10, 10]  # either text of id 10, each in its own class


def test_pipeline_edges(spark, clashing, prose, tmp_path):
    spark.createDataFrame([(BIG, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none of these words are there " * 3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == clashing.columns
        docs = common.materialize(docs, "edges")
    # the copies of BIG fall to one, the tie of id 9 to one; null, empty and repeated words fail the rules
    assert sorted(r.doc_id for r in docs.collect()) == [9, BIG] and docs.where("n_words = 4").count() == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 2
    clashing.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
