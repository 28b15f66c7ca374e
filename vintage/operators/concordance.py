"""Correspondence tables: groups, ambiguity, and code sets.

``edges`` has period, vintage_a_year, vintage_b_year, vintage_a_code and
vintage_b_code; all periods are handled in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.functions.codes import normalise_code
from vintage.operators.components import components
from vintage.sources.storage import checkpointed

EDGE = ["period", "vintage_a_year", "vintage_b_year", "vintage_a_code", "vintage_b_code"]
SPAN = EDGE[:3]


@dataclass(frozen=True)
class Groups:
    edges: DataFrame
    a_nodes: DataFrame
    b_nodes: DataFrame
    summary: DataFrame


def distinct_edges(edges: DataFrame) -> DataFrame:
    """G1"""
    return edges.select(*EDGE).dropDuplicates(EDGE)


def with_degrees(edges: DataFrame) -> DataFrame:
    """Distinct edges with the links of either code."""
    e = distinct_edges(edges)
    return e.withColumns({
        "deg_a": F.count(F.lit(1)).over(W.partitionBy("period", "vintage_a_code")),
        "deg_b": F.count(F.lit(1)).over(W.partitionBy("period", "vintage_b_code")),
    })


def node_degrees(edges: DataFrame) -> DataFrame:
    """period, side, code, n_links, deterministic. G4"""
    e = distinct_edges(edges)
    sides = [
        e.groupBy("period", F.lit(s).alias("side"), F.col(f"vintage_{s}_code").alias("code")).agg(F.countDistinct(f"vintage_{o}_code").alias("n_links"))
        for s, o in (("a", "b"), ("b", "a"))
    ]
    return sides[0].unionByName(sides[1]).withColumn("deterministic", F.col("n_links") == 1)


def build_groups(edges: DataFrame) -> Groups:
    """Components of each period with stable ids, node and group tables. G2-G5"""
    e = distinct_edges(edges)
    graph = e.select("period", F.concat(F.lit("A"), "vintage_a_code").alias("u"), F.concat(F.lit("B"), "vintage_b_code").alias("v"))
    label = components(graph, ["period"]).where("node like 'A%'").select("period", F.substring("node", 2, 100).alias("vintage_a_code"), "component")
    tagged = e.join(label, ["period", "vintage_a_code"])
    ids = tagged.groupBy("period", "component").agg(F.min("vintage_a_code").alias("lo_a"), F.min("vintage_b_code").alias("lo_b"))
    ids = ranked(ids, ["period"], "lo_a", ["lo_b"])
    ids = ids.select("period", "component", F.concat("period", F.lit("_g"), group_number(F.col("rank"))).alias("group_id"))
    tagged = checkpointed(tagged.join(ids, ["period", "component"]).select(*EDGE, "group_id"))
    nodes, summary = {}, None  # the links are distinct, so counts of rows are counts of codes
    for s, name in (("a", "a_to_b_ambiguous"), ("b", "b_to_a_ambiguous")):
        nodes[s] = tagged.groupBy(*SPAN, F.col(f"vintage_{s}_code").alias("code"), "group_id").agg(F.count(F.lit(1)).alias("n_links"))
        nodes[s] = nodes[s].withColumn("deterministic", F.col("n_links") == 1)
        side = nodes[s].groupBy(*SPAN, "group_id").agg(F.count(F.lit(1)).alias(f"n_vintage_{s}"), F.sum("n_links").alias("n_edges"), (F.max("n_links") > 1).alias(name))
        summary = side if summary is None else summary.join(side.drop("n_edges"), [*SPAN, "group_id"])
    summary = summary.select(*SPAN, "group_id", "n_vintage_a", "n_vintage_b", "n_edges", "a_to_b_ambiguous", "b_to_a_ambiguous")
    return Groups(tagged, nodes["a"], nodes["b"], checkpointed(summary))


def ranked(rows: DataFrame, key: list[str], first: str, then: list[str]) -> DataFrame:
    """Adds rank: the row number within key by ``first`` (text) and ``then``.
    Ranks are taken within the values that share five characters, plus what
    earlier ones hold, so no task sees all rows of a key."""
    rows = rows.withColumn("_b", F.left(first, F.lit(5)))
    before = F.sum("_m").over(W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    sizes = rows.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_m")).select(*key, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(*key, "_b").orderBy(first, *then))
    return rows.withColumn("_r", local).join(sizes, [*key, "_b"]).withColumn("rank", F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")


def group_number(rank: Column) -> Column:
    """Six digits at least."""
    return F.lpad(rank.cast("string"), F.greatest(F.lit(6), F.length(rank.cast("string"))), F.lit("0"))


def oriented(edges: DataFrame) -> DataFrame:
    """Edges in both directions: period, direction, from/to year, from_code, to_code, group_id."""
    out = None
    for direction, s, o in (("a_to_b", "a", "b"), ("b_to_a", "b", "a")):
        part = edges.select(
            "period", F.lit(direction).alias("direction"), F.col(f"vintage_{s}_year").alias("from_vintage_year"), F.col(f"vintage_{o}_year").alias("to_vintage_year"),
            F.col(f"vintage_{s}_code").alias("from_code"), F.col(f"vintage_{o}_code").alias("to_code"), "group_id",
        )
        out = part if out is None else out.unionByName(part)
    return out


def ambiguous_groups(groups: Groups) -> DataFrame:
    """period, direction, group_id. G6"""
    s = groups.summary
    return s.where("a_to_b_ambiguous").select("period", F.lit("a_to_b").alias("direction"), "group_id").union(
        s.where("b_to_a_ambiguous").select("period", F.lit("b_to_a").alias("direction"), "group_id")
    )


def ambiguous_edges(groups: Groups) -> DataFrame:
    """Oriented edges of ambiguous groups. G7"""
    return oriented(groups.edges).join(ambiguous_groups(groups), ["period", "direction", "group_id"], "left_semi")


def deterministic_maps(groups: Groups) -> DataFrame:
    """Weight 1 for each code with one link, also inside ambiguous groups. G8"""
    o = oriented(groups.edges)
    one = o.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("period", "direction", "from_code"))).where("_n = 1").drop("_n")
    return one.dropDuplicates(["period", "direction", "from_code", "to_code"]).withColumn("weight", F.lit(1.0))


def revised_codes(groups: Groups) -> DataFrame:
    """period, direction, code: several targets, or in an ambiguous group. G9"""
    o = oriented(groups.edges)
    several = o.groupBy("period", "direction", "from_code").agg(F.countDistinct("to_code").alias("n")).where("n > 1")
    return several.select("period", "direction", F.col("from_code").alias("code")).union(
        ambiguous_edges(groups).select("period", "direction", F.col("from_code").alias("code"))
    ).distinct()


def ambiguous_either(groups: Groups, rule: str = "union") -> DataFrame:
    """Group ids by a_to_b, b_to_a or either. G10"""
    cond = {"a_to_b": F.col("a_to_b_ambiguous"), "b_to_a": F.col("b_to_a_ambiguous"), "union": F.col("a_to_b_ambiguous") | F.col("b_to_a_ambiguous")}
    return groups.summary.where(cond[rule]).select("period", "group_id")


def strict_one_to_one(edges: DataFrame) -> DataFrame:
    """Links with one link on either side. G11"""
    return with_degrees(edges).where("deg_a = 1 and deg_b = 1").select(*EDGE)


def nonbijective_codes(edges: DataFrame) -> DataFrame:
    """period, side, code on a link with several links on either side. G12"""
    bad = with_degrees(edges).where("deg_a > 1 or deg_b > 1")
    return _both_sides(bad)


def unstable_codes(edges: DataFrame) -> DataFrame:
    """period, side, code whose targets are not just itself. G13"""
    e = distinct_edges(edges)
    out = None
    for s, o in (("a", "b"), ("b", "a")):
        part = e.groupBy("period", F.col(f"vintage_{s}_code").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min(f"vintage_{o}_code").alias("lo"))
        part = part.where("n > 1 or lo <> code").select("period", F.lit(s).alias("side"), "code")
        out = part if out is None else out.union(part)
    return out


def _both_sides(e: DataFrame) -> DataFrame:
    return e.select("period", F.lit("a").alias("side"), F.col("vintage_a_code").alias("code")).union(
        e.select("period", F.lit("b").alias("side"), F.col("vintage_b_code").alias("code"))
    ).distinct()


def revised_sides(edges: DataFrame) -> DataFrame:
    """Distinct codes of either side. G14"""
    return _both_sides(distinct_edges(edges))


def feasible_targets(edges_oriented: DataFrame) -> DataFrame:
    """period, direction, from_code, k (distinct targets). G15"""
    return edges_oriented.groupBy("period", "direction", "from_code").agg(F.countDistinct("to_code").alias("k"))


def code_universe(trade: DataFrame) -> DataFrame:
    """year, code of all codes seen. G16"""
    year = F.substring(F.col("PERIOD").cast("string"), 1, 4).cast("int")
    return trade.select(year.alias("year"), normalise_code(F.col("PRODUCT_NC")).alias("code")).distinct()


def code_lifetimes(edges: DataFrame) -> DataFrame:
    """code, introduced (least b year), sunset (greatest a year). G17"""
    e = distinct_edges(edges)
    born = e.groupBy(F.col("vintage_b_code").alias("code")).agg(F.min("vintage_b_year").alias("introduced"))
    gone = e.groupBy(F.col("vintage_a_code").alias("code")).agg(F.max("vintage_a_year").alias("sunset"))
    return born.join(gone, "code", "full")


def nonadjacent(edges: DataFrame) -> DataFrame:
    """Edges whose years are not y, y + 1: empty if all is well. G21"""
    return edges.where(F.col("vintage_b_year").cast("int") - F.col("vintage_a_year").cast("int") != 1)


def code_groups(groups: Groups) -> DataFrame:
    """period, side, year, code, group_id. G22"""
    e = groups.edges
    return e.select("period", F.lit("a").alias("side"), F.col("vintage_a_year").alias("year"), F.col("vintage_a_code").alias("code"), "group_id").union(
        e.select("period", F.lit("b").alias("side"), F.col("vintage_b_year").alias("year"), F.col("vintage_b_code").alias("code"), "group_id")
    ).distinct()
