"""Persistence fits from cells against those of the completed panel, and what the query writes."""

import random

import pytest
from pyspark.sql import functions as F

from vintage.operators import persistence
from vintage.plans import core, stores

ROWS = "PERIOD int, PRODUCT_NC string, REPORTER string, PARTNER string, value double"


def test_fits_equal_those_of_the_completed_panel(spark):
    """Also where a pair's country or a value is unknown, a year's total is zero or a year is missing."""
    rng = random.Random(4)
    data = [(y, f"{c:08d}", f"C{rng.randrange(3)}", f"S{rng.randrange(3)}", float(rng.randrange(1, 90))) for y in (2000, 2001, 2002, 2004, 2005) for c in range(1, 13) for _ in range(4)]
    data += [(2001, "00000002", None, "S1", 5.0), (2001, "00000003", "C1", "S2", None), (2002, "00000020", "C1", "S1", -3.0), (2001, "00000020", "C1", "S1", 3.0), (2001, "00000021", "C9", "S1", 0.0)]
    facts = spark.createDataFrame(data, ROWS)
    codes = facts.groupBy("PERIOD", "PRODUCT_NC").agg(F.sum("value").alias("value")).withColumns({"year": F.col("PERIOD"), "code": F.col("PRODUCT_NC")})
    places = [("all", f"{c:08d}", f"g{c % 3}") for c in (*range(1, 13), 20, 21, 99)] + [("own", f"{c:08d}", f"{c}") for c in range(1, 22)]
    groups = spark.createDataFrame(places, "row string, code string, group_id string")
    got = {(r.row, r.year): r for r in persistence.panel_fits(facts, codes, groups, list(range(2000, 2006)), ("row",)).collect()}
    totals = facts.groupBy(F.col("PERIOD").alias("year"), "REPORTER", "PARTNER", F.col("PRODUCT_NC").alias("code")).agg(F.sum("value").alias("value"))
    want = {}
    for name in ("all", "own"):
        own = groups.where(F.col("row") == name).drop("row")
        want |= {(name, r.year): r for r in persistence.persistence(persistence.completed_panel(persistence.scaled_flows(totals, own), own)).collect()}
    assert got.keys() == want.keys() == {(n, y) for n in ("all", "own") for y in (2001, 2002, 2005)}
    for key, row in want.items():
        assert got[key].n == row.n and [got[key][c] for c in ("coef", "se", "r2_45")] == pytest.approx([row[c] for c in ("coef", "se", "r2_45")], abs=1e-12)


def test_lines_that_fit_exactly(spark):
    facts = spark.createDataFrame([(y, "1", "C", f"S{i}", float(v)) for y in (2000, 2001) for i, v in enumerate((1, 2, 4))] + [(2000, "2", "C", "S9", 1.0)], ROWS)
    codes = facts.groupBy("PERIOD", "PRODUCT_NC").agg(F.sum("value").alias("value")).withColumns({"year": F.col("PERIOD"), "code": F.col("PRODUCT_NC")})
    fits = lambda *g: persistence.panel_fits(facts, codes, spark.createDataFrame(g, "row string, code string, group_id string"), [2000, 2001], ("row",)).first()
    same = fits(("r", "1", "g"))
    assert (same.coef, same.se, same.n, same.r2_45) == (1.0, 0.0, 3, 1.0)
    assert persistence.panel_fits(facts, codes, spark.createDataFrame([("r", "2", "g")], "row string, code string, group_id string"), [2000, 2001], ("row",)).count() == 0


def test_basis_persistence_writes_no_completed_panel(spark, monkeypatch):
    """No table that the query writes has more rows than the lines it reads."""
    written, plain = [], stores.checkpointed

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    for module in (stores, persistence):
        monkeypatch.setattr(module, "checkpointed", counted)
    folder = "/root/testdata/sf0.001"
    core.QUERIES["basis_persistence"](spark, folder)
    assert max(written) <= spark.read.parquet(f"{folder}/lineitem.parquet").count()
