"""Stored chains, the monthly sink, relations by doubling, ranks, hubs and layouts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage.functions import metrics as M
from vintage.operators import apply, chain_store, components, skew, structure
from vintage.plans.harmonise import harmonise
from vintage.sources import fixture
from vintage.sources.storage import shared_path
from vintage.streaming import monthly

STEP = "period string, direction string, measure string, from_code string, to_code string, weight double"
TRADE = "REPORTER string, PARTNER string, TRADE_TYPE string, PRODUCT_NC string, FLOW string, PERIOD int, VALUE_EUR double, QUANTITY_KG double"


def code(n):
    return str(n).zfill(8)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture
def steps(spark):
    made = [("20002001", "a_to_b", "VALUE_EUR", code(1), code(11), 0.4), ("20002001", "a_to_b", "VALUE_EUR", code(1), code(12), 0.6), ("20012002", "a_to_b", "VALUE_EUR", code(11), code(21), 1.0), ("20022003", "b_to_a", "VALUE_EUR", code(31), code(21), 1.0)]
    return spark.createDataFrame(made, STEP)


@pytest.fixture
def universe(spark):
    return spark.createDataFrame([(2000, code(1)), (2000, code(2)), (2001, code(11)), (2001, code(12)), (2002, code(21)), (2003, code(31))], "year int, code string")


def test_only_changed_chains_are_built_again(spark, steps, universe):
    path = shared_path(spark)
    args = (2000, 2003, 2002, ["VALUE_EUR"])
    first, built, _ = chain_store.refresh(path, steps, universe, *args)
    assert built == [2000, 2001, 2002, 2003]
    whole = rows(first, *chain_store.CHAIN)
    again, built, made = chain_store.refresh(path, steps.repartition(3).orderBy(F.desc("to_code")), universe, *args)  # the order of rows is no change
    assert built == [] and made is None and rows(again, *chain_store.CHAIN) == whole
    other = steps.withColumn("weight", F.when((F.col("to_code") == code(11)), 0.3).when(F.col("to_code") == code(12), 0.7).otherwise(F.col("weight")))
    new, built, _ = chain_store.refresh(path, other, universe, *args)
    assert built == [2000]
    assert {r.to_code: r.weight for r in new.where("origin_year = 2000 and from_code = '00000001'").collect()} == pytest.approx({code(21): 0.3, code(12): 0.7})
    assert [r for r in rows(new, *chain_store.CHAIN) if r[0] != 2000] == [r for r in whole if r[0] != 2000]
    more = universe.union(spark.createDataFrame([(2003, code(99))], universe.schema))
    assert chain_store.refresh(path, other, more, *args)[1] == [2003]


def test_harmonise_keeps_chains_in_a_store(spark):
    edges = spark.createDataFrame([("20002001", "2000", "2001", code(1), code(11)), ("20002001", "2000", "2001", code(1), code(12))], "period string, vintage_a_year string, vintage_b_year string, vintage_a_code string, vintage_b_code string")
    facts = [("R1", "P", "I", code(1), "1", 2000, 60.0, 6.0), ("R1", "P", "I", code(11), "1", 2001, 45.0, 4.0), ("R1", "P", "I", code(12), "1", 2001, 15.0, 2.0), ("R2", "P", "I", code(1), "1", 2000, 5.0, 1.0), ("R2", "P", "I", code(11), "1", 2001, 5.0, 1.0)]
    path = shared_path(spark)
    trade = spark.createDataFrame(facts, TRADE)
    one = harmonise(trade, edges, 2001, 2000, 2001, store=path)
    assert rows(one["built"], "origin_year") == [(2000,), (2001,)]
    two = harmonise(trade, edges, 2001, 2000, 2001, store=path)
    assert rows(two["built"], "origin_year") == [] and rows(two["recoded"], *one["recoded"].columns) == rows(one["recoded"], *one["recoded"].columns)
    changed = spark.createDataFrame([(*f[:6], f[6] * (3 if f[3] == code(12) else 1), f[7]) for f in facts], TRADE)
    assert rows(harmonise(changed, edges, 2001, 2000, 2001, store=path)["built"], "origin_year") == [(2000,)]


def test_replays_and_corrections_replace(spark):
    """Two files, the second batch run twice, then a correction of one month: what is read is the batch result."""
    w = spark.createDataFrame([(2000, m, code(1), code(t), x) for m in apply.MEASURES for t, x in ((11, 0.25), (12, 0.75))], "origin_year int, measure string, from_code string, to_code string, weight double")
    schema = TRADE + ", REVISION int"
    one = [("R1", "P", "I", code(1), "1", 200001, 8.0, 4.0, 0), ("R1", "P", "I", code(2), "1", 200002, 3.0, 3.0, 0)]
    two = [("R1", "P", "I", code(1), "1", 200001, 4.0, 4.0, 0), ("R2", "P", "I", code(1), "1", 200002, 100.0, 1.0, 0)]
    fixed = [("R2", "P", "I", code(1), "1", 200002, 40.0, 1.0, 1)]
    source, path = shared_path(spark), shared_path(spark)
    for k, part in enumerate((one, two, fixed)):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        monthly.sink_months(spark.readStream.schema(schema).parquet(source), w, path, f"{path}/log").awaitTermination()
        if k == 1:
            monthly.write_batch(spark.createDataFrame(two, schema), 1, w, path)
    now = spark.createDataFrame([one[0], two[0], fixed[0]], schema).drop("REVISION")
    want = apply.apply_wide(apply.with_year(now), w).drop("origin_year")
    assert rows(monthly.read_months(spark, path), *want.columns) == rows(want, *want.columns)
    assert rows(monthly.finished_months(spark, path), "PERIOD", "REVISION", "n_rows_in", "value_in") == [(200001, 0, 2, 12.0), (200002, 1, 1, 40.0)]
    planned = spark.createDataFrame([(200001, 0), (200002, 1), (200002, 2), (200003, 0)], "PERIOD int, REVISION int")
    assert rows(monthly.pending_months(planned, spark, path), "PERIOD", "REVISION") == [(200002, 2), (200003, 0)]
    assert monthly.pending_months(planned, spark, shared_path(spark)).count() == 4


def test_doubling_equals_the_walk(spark):
    """Random links over nine years; codes that come and go are carried on by both."""
    rng = np.random.default_rng(2)
    links = sorted({(y, int(rng.integers(12)), int(rng.integers(12))) for y in range(1990, 1998) for _ in range(8)})
    edges = spark.createDataFrame([(f"{y}{y + 1}", str(y), str(y + 1), code(a), code(b)) for y, a, b in links], "period string, vintage_a_year string, vintage_b_year string, vintage_a_code string, vintage_b_code string")
    universe = spark.createDataFrame([(y, code(c)) for y in range(1990, 1999) for c in range(12) if rng.random() < 0.7], "year int, code string")
    for sign, first, last in ((1, 1990, 1998), (-1, 1998, 1990)):
        years = list(range(first + sign, last + sign, sign))
        table = structure.relation_table(edges, universe, 1990, 1998, sign)
        pairs = [(first, y) for y in years] + [(first + sign, last)]
        got = structure.relations_between(table, universe, pairs)
        walk = structure.chained_relations(edges, universe, first, years)
        assert rows(got.where(F.col("anchor") == first), "compare_year", "from_code", "to_code") == rows(walk, "compare_year", "from_code", "to_code")
        late = structure.chained_relations(edges, universe, first + sign, years[1:]).where(F.col("compare_year") == last)
        assert rows(got.where(F.col("anchor") == first + sign), "from_code", "to_code") == rows(late, "from_code", "to_code")


def test_ranks_and_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(k, float(rng.integers(0, 40)), float(rng.normal())) for k in ("a", "b") for _ in range(500)] + [("c", 1.0, 2.0), ("d", None, 1.0)]
    df = spark.createDataFrame(data, "k string, x double, y double").repartition(5)
    q = {r.k: r for r in M.quantiles(df, "x", ("k",), (10, 50, 95)).collect()}
    s = {r.k: r.spearman for r in M.spearman(df, "x", "y", ("k",)).collect()}

    def ranks(v):
        return np.array([np.sum(v < x) + (np.sum(v == x) + 1) / 2 for x in v])

    for k in ("a", "b"):
        x, y = (np.array([r[i] for r in data if r[0] == k]) for i in (1, 2))
        assert [q[k].p10, q[k].p50, q[k].p95] == pytest.approx(np.percentile(x, [10, 50, 95]))
        assert s[k] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert s["c"] is None and q["c"].p95 == 1.0 and "d" not in q


def test_crowded_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 50)
    many = spark.range(1000).select((F.col("id") % 7 == 0).cast("int").alias("k"), "id")
    one = spark.createDataFrame([(0, "x"), (1, "y")], "k int, name string")
    crowded = skew.crowded_keys(many, ["k"], 1000)
    assert rows(crowded, "k", "_fan") == [(0, 18), (1, 3)]
    assert rows(skew.dealt_join(many, one, ["k"], crowded, ["id"]), "k", "id", "name") == rows(many.join(one, ["k"]), "k", "id", "name")


def test_a_star_and_a_chain(spark):
    """10**5 nodes each: a hub's links are dealt out, and rounds grow with the logarithm of the path."""
    n = 100_000
    name = lambda c: F.lpad(c.cast("string"), 7, "0")
    star = spark.range(1, n).select(F.lit("star").alias("g"), F.lit("0000000").alias("u"), name(F.col("id")).alias("v"))
    path = spark.range(n - 1).select(F.lit("path").alias("g"), name(F.col("id")).alias("u"), name(F.col("id") + 1).alias("v"))
    out = components.components(star.union(path), ["g"])
    assert sorted(map(tuple, out.groupBy("g", "component").count().collect())) == [("path", "0000000", n), ("star", "0000000", n)]


def test_stored_layout_needs_no_exchange_below_the_join(spark):
    facts = apply.with_year(spark.createDataFrame([("R1", "P", "I", code(k % 5), "1", 2000, 1.0 + k, 2.0) for k in range(60)], TRADE))
    w = spark.createDataFrame([(2000, m, code(1), code(t), x) for m in apply.MEASURES for t, x in ((11, 0.25), (12, 0.75))], "origin_year int, measure string, from_code string, to_code string, weight double")
    stored = apply.store_for_recoding(facts, w, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = apply.recode_stored(*stored)
        plan = out._jdf.queryExecution().executedPlan().toString()
        found = rows(out, *out.columns)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan.split("SortMergeJoin", 1)[1].split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and not re.search(r"Exchange", below)
    want = apply.apply_wide(facts, w)
    assert found == rows(want, *out.columns)


def jobs_of(spark, run):
    """What ``run`` gives, and how many Spark jobs it took."""
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return run(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_small_components_take_few_jobs(spark):
    """No rounds of joins over all links where a component's links lie near each other."""
    n = F.col("id")
    name = lambda c: F.format_string("%08d", c)
    links = spark.range(30_000).select(F.lit("p").alias("g"), name(n).alias("u"), name(F.when(n % 5 == 4, n).otherwise(n + 1)).alias("v"))
    out, jobs = jobs_of(spark, lambda: components.components(links, ["g"]))
    assert jobs <= 12
    assert out.where(F.col("component") != name(F.floor(F.col("node").cast("long") / 5) * 5)).isEmpty()
    assert out.count() == 30_000


def test_components_across_chunks(spark, monkeypatch):
    """Far neighbours meet in several chunks; labels are linked in one chunk, and in rounds if there are too many. Keys keep apart."""
    rng = random.Random(5)
    pairs = [(rng.choice("xy"), rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    rows = [(g, f"{a:03d}", f"{b:03d}") for g, a, b in pairs] + [(None, "1", "2"), ("x", None, "2")]
    root = {}

    def find(p):
        while root.setdefault(p, p) != p:
            p = root[p]
        return p

    for g, a, b in rows[: len(pairs)]:
        low, high = sorted([find((g, a)), find((g, b))])
        root[high] = low
    want = {p: find(p)[1] for p in list(root)}
    edges = spark.createDataFrame(rows, "g string, u string, v string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for chunk in (40, 200, 1 << 18):
            monkeypatch.setattr(components, "CHUNK", chunk)
            got = {(r.g, r.node): r.component for r in components.components(edges, ["g"]).collect()}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_query_derives_its_inputs_once(spark):
    from vintage.sources import fixture

    made = []
    with fixture.once():
        for _ in range(2):
            fixture.held(spark, "x", "groups", lambda: made.append(1))
        fixture.held(spark, "y", "groups", lambda: made.append(1))
    assert len(made) == 2
    fixture.held(spark, "x", "groups", lambda: made.append(1))  # nothing is kept outside of a query
    assert len(made) == 3


def test_facts_read_codes_that_were_written_once(spark):
    """crossed with the years in each use, all parts went through one task."""
    from vintage.sources import fixture

    with fixture.once():
        trade, edges = fixture.trade(spark, "/root/testdata/sf0.001"), fixture.edges(spark, "/root/testdata/sf0.001")
        slots = fixture.slots(spark, "/root/testdata/sf0.001")
        plan = trade._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "p_partkey" not in plan
        assert fixture.slots(spark, "/root/testdata/sf0.001") is slots
        years = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(F.year("l_shipdate")).distinct().count()
        assert slots.count() == years * spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
        assert edges.count() == edges.distinct().count() > 0


def test_pairs_of_groups_are_counted_without_copies_of_shares(spark):
    """totals, rows and pairs by side, a pair with two codes or with a null partner included."""
    from vintage.operators import concordance, estimation

    span = ("20002001", "2000", "2001")
    edges = spark.createDataFrame([(*span, code(1), code(11)), (*span, code(1), code(12))], "period string, vintage_a_year string, vintage_b_year string, vintage_a_code string, vintage_b_code string")
    groups = concordance.build_groups(edges)
    facts = [("R1", "P", "I", code(1), "1", 2000, 60.0, 6.0), ("R1", "P", "I", code(11), "1", 2001, 45.0, 4.0), ("R1", "P", "I", code(12), "1", 2001, 15.0, 2.0), ("R2", "P", "I", code(11), "1", 2001, 5.0, 1.0), ("R2", "P", "E", code(11), "1", 2001, 5.0, 1.0)]
    shares = estimation.side_shares(spark.createDataFrame(facts, TRADE), groups)
    shares = shares.unionByName(shares.where("code = '00000012'").withColumn("PARTNER", F.lit(None).cast("string")))
    totals = estimation.group_totals(shares, groups)
    assert rows(totals, "total_a", "total_b", "n_rows_a", "n_rows_b", "n_pairs_a", "n_pairs_b") == [(60.0, 85.0, 1, 4, 1, 3)]
    assert "Expand" not in totals._jdf.queryExecution().optimizedPlan().toString()


def test_sums_by_code_are_those_of_the_facts(spark):
    """Straight from the lines, or from the facts once they are written."""
    folder, key = "/root/testdata/sf0.001", ["PRODUCT_NC", "FLOW", "PERIOD"]

    def sums(df):
        df = df.groupBy(*key).agg(F.round(F.sum("VALUE_EUR"), 2), F.round(F.sum("QUANTITY_KG"), 2))
        return sorted(tuple(r) for r in df.collect())

    with fixture.once():
        direct = fixture.trade_by_code(spark, folder)
        assert direct.count() == direct.select(*key).distinct().count()
        whole = fixture.stored_trade(spark, folder)
        assert sums(direct) == sums(whole) == sums(fixture.trade_by_code(spark, folder))
