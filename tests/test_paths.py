"""Gates inside the paths that use them, sources and sinks, the composition, the stream."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vintage.functions import codes as C
from vintage.operators import apply, chain, concordance, estimation, figures, panels, persistence, robustness, structure, weights
from vintage.plans.harmonise import harmonise, missing_codes_of, missing_weights
from vintage.sources import trade as S
from vintage.streaming.monthly import recode_stream

W = "origin_year int, measure string, from_code string, to_code string, weight double"
T = "REPORTER string, PARTNER string, TRADE_TYPE string, PRODUCT_NC string, FLOW string, PERIOD int, VALUE_EUR double, QUANTITY_KG double"
EDGES = "period string, vintage_a_year string, vintage_b_year string, vintage_a_code string, vintage_b_code string"


def code(n):
    return f"{n:08d}"


@pytest.fixture
def facts(spark):
    rows = [("R1", "P1", "E", code(c), "1", y, v, v / 10) for c, y, v in ((1, 2000, 60.0), (2, 2000, 40.0), (9, 2000, 5.0), (11, 2001, 70.0), (12, 2001, 30.0), (9, 2001, 6.0))]
    rows += [("R2", "P1", "E", code(c), "1", y, v, v / 10) for c, y, v in ((1, 2000, 30.0), (2, 2000, 20.0), (11, 2001, 25.0), (12, 2001, 25.0))]
    return spark.createDataFrame(rows, T)


@pytest.fixture
def links(spark):
    return spark.createDataFrame([("20002001", "2000", "2001", code(1), code(11)), ("20002001", "2000", "2001", code(1), code(12)), ("20002001", "2000", "2001", code(2), code(12))], EDGES)


@pytest.mark.parametrize("bad", [[("a", -1e-3), ("b", 1.0)], [("a", 0.0), ("b", 0.0)], [("a", None), ("b", 1.0)], [("a", float("nan")), ("b", 1.0)]])
def test_bad_weights_are_refused_where_they_are_used(spark, facts, bad):
    w = spark.createDataFrame([(2000, m, code(1), to, x) for m in ("VALUE_EUR", "QUANTITY_KG") for to, x in bad], W)
    rows = apply.with_year(facts)
    for use in (lambda: weights.finalise(w, ["origin_year", "measure"]), lambda: apply.apply_wide(rows, w), lambda: apply.apply_strategy(rows, w)):
        with pytest.raises(PySparkException, match="of code 00000001"):
            use().collect()
    assert weights.violations(w, ["origin_year", "measure"]).count() > 0
    assert apply.apply_wide(rows, w.where("weight > 0.5").withColumn("weight", F.lit(1.0))).count() > 0


def test_codes_without_weights_are_refused_unless_identity_is_assumed(spark, facts):
    w = spark.createDataFrame([(2000, m, code(1), code(11), 1.0) for m in ("VALUE_EUR", "QUANTITY_KG")], W)
    rows = apply.with_year(facts.where("PERIOD = 2000"))
    with pytest.raises(ValueError, match="codes without weights"):
        apply.apply_wide(rows, w, assume_identity=False)
    out = apply.apply_wide(rows, w)
    assert {r.PRODUCT_NC for r in out.collect()} == {code(11), code(2), code(9)}
    assert {r.from_code for r in missing_codes_of(facts.where("PERIOD = 2000"), w).collect()} == {code(2), code(9)}


def test_weights_of_one_measure_only(spark, facts):
    """A code with value weights only keeps itself under quantity weights."""
    w = spark.createDataFrame([(2000, "VALUE_EUR", code(1), code(11), 0.25), (2000, "VALUE_EUR", code(1), code(12), 0.75)], W)
    rows = apply.with_year(facts.where("PERIOD = 2000 and REPORTER = 'R1'"))
    got = {r.PRODUCT_NC: (r.VALUE_EUR_w_value, r.VALUE_EUR_w_quantity) for r in apply.apply_wide(rows, w).collect()}
    assert got == {code(11): (15.0, 0.0), code(12): (45.0, 0.0), code(1): (0.0, 60.0), code(2): (40.0, 40.0), code(9): (5.0, 5.0)}


def test_unsolved_fits_are_refused(spark, facts, links, monkeypatch):
    # the patch reaches this process only; the fit runs in workers, so the status is planted in the table
    fitted = spark.createDataFrame([("20002001", "a_to_b", "VALUE_EUR", "20002001_g000001", code(1), code(11), 1.0, "max_iter")], "period string, direction string, measure string, group_id string, from_code string, to_code string, weight double, status string")
    monkeypatch.setattr(estimation, "fitted_weights", lambda moments, groups: fitted)
    groups = concordance.build_groups(links)
    out = estimation.estimate(facts, groups, ["VALUE_EUR"])
    with pytest.raises(PySparkException, match="unsolved fit of code 00000001"):
        out["weights"].collect()
    assert estimation.unsolved(out["diagnostics"]).count() == 1
    assert estimation.estimate(facts, groups, ["VALUE_EUR"], fail_on_status=False)["weights"].count() > 0


def test_chains_are_refused_when_codes_lack(spark, facts, links):
    universe = concordance.code_universe(facts)
    steps = spark.createDataFrame([("20002001", "a_to_b", "VALUE_EUR", code(2), code(12), 1.0)], "period string, direction string, measure string, from_code string, to_code string, weight double")
    revised = concordance.revised_codes(concordance.build_groups(links))
    made = chain.chain_range(steps, universe, 2000, 2001, 2001, ["VALUE_EUR"], revised, final=False)
    with pytest.raises(ValueError, match="revised codes without weights"):
        chain.assert_complete(made, universe)
    loose = chain.chain_range(steps, universe, 2000, 2001, 2001, ["VALUE_EUR"], final=False)
    chain.assert_complete(loose, universe)
    more = universe.union(spark.createDataFrame([(2000, "x")], "year int, code string"))
    with pytest.raises(ValueError, match="codes without a chain"):
        chain.assert_complete(loose, more)
    loose.weights = loose.weights.withColumn("weight", F.col("weight") * 0.9)
    with pytest.raises(ValueError, match="do not sum to one"):
        chain.assert_complete(loose, universe)


def test_composition(spark, facts, links):
    out = harmonise(facts, links, 2001, 2000, 2001)
    assert out["conservation"].agg(F.max(F.abs("difference"))).first()[0] < 1e-9
    assert {r.PRODUCT_NC for r in out["recoded"].where("PERIOD = 2000").collect()} <= {code(11), code(12), code(9)}
    assert apply.conservation_summary(out["conservation"]).agg(F.max("max_abs")).first()[0] < 1e-9
    assert apply.keep_last(out["apply_summary"].withColumn("run", F.lit(1)).union(out["apply_summary"].withColumn("run", F.lit(2))), ["PERIOD"], "run").select("run").distinct().collect()[0].run == 2
    # stored chains are used again; chains of one measure only are refused
    again = harmonise(facts, links, 2001, 2000, 2001, chains=out["chains"])
    assert again["recoded"].exceptAll(out["recoded"]).count() == 0 and "steps" not in again
    with pytest.raises(ValueError, match="origins and measures"):
        harmonise(facts, links, 2001, 2000, 2001, chains=out["chains"].where("measure = 'VALUE_EUR'"))
    assert missing_weights(out["chains"], [1999, 2000], ["VALUE_EUR"]).collect()[0].origin_year == 1999
    assert "recoded" not in harmonise(facts, links, 2001, 2000, 2001, do_apply=False)
    # strict: every revised code has a step here; without the steps of one it is refused
    assert harmonise(facts, links, 2001, 2000, 2001, strict=True)["conservation"].count() > 0
    with pytest.raises(ValueError, match="revised codes"):
        harmonise(facts, links, 2001, 2000, 2001, strict=True, steps=out["steps"].where(F.col("from_code") != code(1)))
    with pytest.raises(ValueError, match="do not follow"):
        harmonise(facts, links.withColumn("vintage_b_year", F.lit("2003")), 2001, 2000, 2001)


def test_sources_round_trip(spark, facts, links, tmp_path):
    path = f"file://{tmp_path}"
    facts.withColumn("year", F.col("PERIOD")).write.partitionBy("year").parquet(f"{path}/annual")
    year = S.scan_year(spark, f"{path}/annual", [2001])
    assert year.count() == 5 and "QUANTITY_KG" not in year.columns
    plan = year._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "year" in plan.split("PartitionFilters")[1][:60]
    facts.withColumns({"year": F.col("PERIOD"), "month": F.lit(3)}).write.partitionBy("year", "month").parquet(f"{path}/monthly")
    assert S.scan_month(spark, f"{path}/monthly", 200003).count() == 5 and S.scan_month(spark, f"{path}/monthly", 200004).count() == 0
    # steps: ambiguous ones win over deterministic ones of the same code
    kind = "period string, direction string, measure string, from_code string, to_code string, weight double, kind string"
    spark.createDataFrame([("p", "d", "m", "1", "11", 0.4, "ambiguous"), ("p", "d", "m", "1", "12", 0.6, "ambiguous"), ("p", "d", "m", "1", "13", 1.0, "deterministic"), ("p", "d", "m", "2", "12", 1.0, "deterministic")], kind).write.parquet(f"{path}/steps")
    assert sorted((r.from_code, r.to_code) for r in S.read_steps(spark, f"{path}/steps").collect()) == [("1", "11"), ("1", "12"), ("2", "12")]
    assert S.read_steps(spark, f"{path}/steps", ambiguous_only=True).count() == 2
    (tmp_path / "allow.csv").write_text("code,name\n 1 2,x\n,y\n00000012,z\n")
    assert [r.code for r in S.read_allow_list(spark, f"{path}/allow.csv", "code").collect()] == [code(12)]
    out = facts.withColumns({"target_year": F.lit(2001), "origin_year": F.col("PERIOD")})
    S.write_recoded(out, f"{path}/recoded")
    S.write_recoded(out.where("origin_year = 2000").limit(1), f"{path}/recoded")  # replaces that partition alone
    assert {r.origin_year: r["count"] for r in spark.read.parquet(f"{path}/recoded").groupBy("origin_year").count().collect()} == {2000: 1, 2001: 5}
    for run in ("a", "b"):
        S.append_diagnostics(links, f"{path}/diagnostics", run)
    assert spark.read.parquet(f"{path}/diagnostics").where("run = 'b'").count() == 3
    years = facts.select(F.col("PERIOD").alias("year"))
    assert [r.period for r in S.available(spark.createDataFrame([("20002001",), ("20012002",)], "period string"), years).collect()] == ["20002001"]
    assert S.pending(years.distinct(), spark.createDataFrame([(2000,)], "year int"), ["year"]).collect()[0].year == 2001
    raw = spark.createDataFrame([("20002001", "1", "11"), ("20002001.0", "1", "11"), ("2000", "1", "11"), ("20002001", "1.5", "11"), ("20002001", "123456789", "1"), ("20002001", None, "1")], "Period string, `Origin code` string, `Destination code` string")
    good, rejected = S.ingest_concordance(raw)
    assert good.count() == 1 and sorted(r.reason for r in rejected.collect()) == ["bad period", "missing", "not an integer", "too long"]


def test_stream_sums_to_the_batch(spark, facts, tmp_path):
    w = spark.createDataFrame([(2000, m, code(1), to, x) for m, p in (("VALUE_EUR", 0.25), ("QUANTITY_KG", 0.5)) for to, x in ((code(11), p), (code(12), 1 - p))], W)
    monthly = facts.withColumn("PERIOD", F.col("PERIOD") * 100 + 1)
    monthly.write.parquet(f"file://{tmp_path}/in")
    stream = recode_stream(spark.readStream.schema(monthly.schema).parquet(f"file://{tmp_path}/in"), w)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").start(f"file://{tmp_path}/out", outputMode="append")
    q.processAllAvailable()
    q.stop()
    cols = [f"{m}_w_{n}" for m in ("VALUE_EUR", "QUANTITY_KG") for n in ("value", "quantity")]
    key = ["REPORTER", "PRODUCT_NC", "PERIOD"]
    total = lambda df: {tuple(r[k] for k in key): tuple(round(r[c], 9) for c in cols) for r in df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in cols]).collect()}
    assert total(spark.read.parquet(f"file://{tmp_path}/out")) == total(apply.apply_wide(apply.with_year(monthly), w))


def test_small_expressions(spark):
    row = spark.range(1).select(C.is_year(F.lit("1999")).alias("a"), C.is_year(F.lit("99")).alias("b"), C.pair_key(F.lit("x"), F.lit("y")).alias("c"), persistence.basis_side(F.lit(2000), F.lit(2000)).alias("d"), persistence.basis_side(F.lit(2001), F.lit(2000)).alias("e")).first()
    assert tuple(row) == (True, False, "x|y", "a", "b")
    ok = weights.within_bounds(spark.createDataFrame([(0.0,), (1.0,)], "weight double")).first()
    assert (ok.least, ok.greatest, ok.ok) == (0.0, 1.0, True)
    many = spark.createDataFrame([(1_000_000,), (7,)], "n long").select(concordance.group_number(F.col("n")).alias("g")).collect()
    assert [r.g for r in many] == ["1000000", "000007"]
    edges = spark.createDataFrame([("19992000", "1999", "2000", "x", "A"), ("20002001", "2000", "2001", "B", "y")], EDGES)
    universe = spark.createDataFrame([(2000, "A"), (2000, "Z")], "year int, code string")
    assert sorted(r.code for r in structure.anchor_codes(universe, 2000, edges).collect()) == ["A", "B"]
    runs = spark.createDataFrame([("p", "d", "m", "g", "1", t, b, x) for t, b, x in (("11", 0, 0.5), ("12", 0, 0.5), ("11", 1, 1.0))], "period string, direction string, measure string, group_id string, from_code string, to_code string, bin int, weight double")
    kept = robustness.reported(runs, ("bin",))
    assert kept.count() == 2 and robustness.uncovered_links(robustness.link_summary(runs, 2)).count() == 1
    assert panels.chain_length(spark.createDataFrame([(y, "g", c, v, v / 10) for y in (2000, 2001, 2002) for c, v in (("a", 4.0 + y % 5), ("b", 6.0 - y % 5))], "year int, group_id string, code string, value double, share double"), 2001).count() == 2
    assert figures.anchored(spark.createDataFrame([("c", 2001, 0.5)], "c string, year int, share double"), 2000, "year", "share", ["c"]).count() == 2
