"""Structural distributions and revision exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.functions.codes import relationship, unknown_weight
from vintage.operators.components import components
from vintage.operators.concordance import Groups
from vintage.operators.weights import assert_empty
from vintage.sources.storage import checkpointed

CLASSES = ("1:1", "m:1", "1:n", "m:n")


def focal_codes(groups: Groups) -> DataFrame:
    """period, side, code, class, unknown: class by the group's sizes. D1

    With b_to_a the unknown classes stay m:1 and m:n for the focal b side."""
    s = groups.summary.select("period", "group_id", "n_vintage_a", "n_vintage_b")
    out = None
    for side, other, direction in (("a", "b", "a_to_b"), ("b", "a", "b_to_a")):
        codes = groups.edges.select("period", "group_id", F.col(f"vintage_{side}_code").alias("code")).distinct()
        kind = relationship(F.col(f"n_vintage_{side}"), F.col(f"n_vintage_{other}"))
        part = codes.join(s, ["period", "group_id"]).select("period", F.lit(side).alias("side"), "code", kind.alias("class"))
        part = part.withColumn("unknown", unknown_weight(F.col("class"), F.lit(direction)))
        out = part if out is None else out.unionByName(part)
    return out


def implied_identities(groups: Groups, universe: DataFrame) -> DataFrame:
    """period, side, code, class 1:1 of codes seen in both years of a period
    and revised on neither side. D2"""
    periods = groups.summary.select("period", F.col("vintage_a_year").cast("int").alias("ya"), F.col("vintage_b_year").cast("int").alias("yb")).distinct()
    a = universe.select(F.col("year").alias("ya"), "code")
    b = universe.select(F.col("year").alias("yb"), "code")
    both = F.broadcast(periods).join(a, "ya").join(b, ["yb", "code"]).select("period", "code")
    revised = groups.edges.select("period", F.col("vintage_a_code").alias("code")).union(groups.edges.select("period", "vintage_b_code")).distinct()
    same = both.join(revised, ["period", "code"], "left_anti")
    return same.select("period", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"), "code", F.lit("1:1").alias("class"), F.lit(False).alias("unknown"))


def link_distribution(focal: DataFrame) -> DataFrame:
    """period, side, class, n, share. D3"""
    n = focal.groupBy("period", "side", "class").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("period", "side")))


def step_relation(edges: DataFrame, universe: DataFrame, source: int, target: int) -> DataFrame:
    """from_code, to_code of a step, with identity for unrevised codes of the
    source year. D4"""
    s, o = ("a", "b") if target > source else ("b", "a")
    period = f"{min(source, target)}{max(source, target)}"
    links = edges.where(F.col("period") == period).select(F.col(f"vintage_{s}_code").alias("from_code"), F.col(f"vintage_{o}_code").alias("to_code")).distinct()
    rest = universe.where(F.col("year") == source).select(F.col("code").alias("from_code")).join(links, "from_code", "left_anti")
    return links.union(rest.select("from_code", F.col("from_code").alias("to_code"))).distinct()


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Boolean product; middles that ``right`` lacks are carried. D5"""
    r = right.select(F.col("from_code").alias("mid"), F.col("to_code").alias("last"))
    out = left.withColumnRenamed("to_code", "mid").join(r, "mid", "left")
    return out.select("from_code", F.coalesce("last", "mid").alias("to_code")).distinct()


def anchor_codes(universe: DataFrame, anchor: int, edges: DataFrame | None = None) -> DataFrame:
    """Codes at the anchor: all seen, or those of links on either side of it. D6"""
    if edges is None:
        return universe.where(F.col("year") == anchor).select("code").distinct()
    a = edges.where(F.col("vintage_a_year") == str(anchor)).select(F.col("vintage_a_code").alias("code"))
    return a.union(edges.where(F.col("vintage_b_year") == str(anchor)).select("vintage_b_code")).distinct()


def relation_classes(relation: DataFrame, key: list[str]) -> DataFrame:
    """key..., from_code, class by the sizes of its component. D7, D9"""
    graph = relation.select(*key, F.concat(F.lit("A"), "from_code").alias("u"), F.concat(F.lit("B"), "to_code").alias("v"))
    label = components(graph, key)
    is_from = F.col("node").startswith("A")
    size = label.groupBy(*key, "component").agg(F.count(F.when(is_from, 1)).alias("nf"), F.count(F.when(~is_from, 1)).alias("no"))
    return label.where(is_from).join(size, [*key, "component"]).select(*key, F.substring("node", 2, 100).alias("from_code"), relationship(F.col("nf"), F.col("no")).alias("class"))


def class_counts(classes: DataFrame, key: list[str]) -> DataFrame:
    """key..., class, n, share with all four classes. D7"""
    spark = classes.sparkSession
    every = classes.select(*key).distinct().crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in CLASSES], "class string")))
    n = classes.groupBy(*key, "class").agg(F.count(F.lit(1)).alias("n"))
    out = every.join(n, [*key, "class"], "left").na.fill(0, ["n"])
    return out.withColumn("share", F.try_divide("n", F.sum("n").over(W.partitionBy(*key))))


def chained_relations(edges: DataFrame, universe: DataFrame, anchor: int, years: list[int]) -> DataFrame:
    """compare_year, from_code (at the anchor), to_code. D8

    A loop over years, each one join; relations are written as they grow."""
    codes = anchor_codes(universe, anchor)
    now, out, at = codes.select(F.col("code").alias("from_code"), F.col("code").alias("to_code")), None, anchor
    for y in years:
        now = checkpointed(product(now, step_relation(edges, universe, at, y)))
        part = now.withColumn("compare_year", F.lit(y))
        out, at = part if out is None else out.unionByName(part), y
    return out


def relation_table(edges: DataFrame, universe: DataFrame, first: int, last: int, sign: int = 1) -> DataFrame:
    """level, year, from_code, to_code: the relation over 2**level steps from
    each year, forwards (sign 1) or back (-1). Each step is completed by identity on every
    code ever seen, so that carrying a code on is a link like any other and the
    product is associative. A level is one join, for all years at once. D5"""
    s, o = ("a", "b") if sign > 0 else ("b", "a")
    e = edges.select(F.col(f"vintage_{s}_year").cast("int").alias("year"), F.col(f"vintage_{s}_code").alias("from_code"), F.col(f"vintage_{o}_code").alias("to_code")).distinct()
    e = checkpointed(e.where(F.col("year").between(first, last) & (F.col("year") + sign).between(first, last)))
    codes = universe.select("code").union(edges.select("vintage_a_code")).union(edges.select("vintage_b_code")).distinct()
    years = range(first, last) if sign > 0 else range(first + 1, last + 1)
    every = codes.select(F.explode(F.array(*[F.lit(y) for y in years])).alias("year"), F.col("code").alias("from_code"))
    rest = every.join(e, ["year", "from_code"], "left_anti").withColumn("to_code", F.col("from_code"))
    now = checkpointed(e.unionByName(rest))
    out, level = now.withColumn("level", F.lit(0)), 0
    while 2 << level <= last - first:
        right = now.select((F.col("year") - sign * (1 << level)).alias("year"), F.col("from_code").alias("mid"), F.col("to_code").alias("last"))
        now = checkpointed(now.withColumnRenamed("to_code", "mid").join(right, ["year", "mid"]).select("year", "from_code", F.col("last").alias("to_code")).distinct())
        level += 1
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out


def relations_between(table: DataFrame, universe: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """anchor, compare_year, from_code, to_code of all (anchor, compare year)
    pairs of one direction, from the codes seen at each anchor: a join for each
    binary digit of the longest span, whatever the number of pairs. D8"""
    spark = table.sparkSession
    longest = max(abs(t - a) for a, t in pairs)
    rows = spark.createDataFrame(pairs, "anchor int, compare_year int")
    start = universe.where(F.col("year").isin(sorted({a for a, _ in pairs}))).select(F.col("year").alias("anchor"), F.col("code").alias("from_code")).distinct()
    now = start.join(F.broadcast(rows), "anchor").withColumns({"at": F.col("anchor"), "to_code": F.col("from_code")})
    for level in range(longest.bit_length()):
        step = table.where(F.col("level") == level).select(F.col("year").alias("at"), F.col("from_code").alias("to_code"), F.col("to_code").alias("next"))
        moves = F.abs(F.col("compare_year") - F.col("anchor")).bitwiseAND(F.lit(1 << level)) != 0
        far = now.where(moves).join(step, ["at", "to_code"])
        sign = F.when(F.col("compare_year") > F.col("anchor"), 1).otherwise(-1)
        far = far.withColumns({"to_code": F.col("next"), "at": (F.col("at") + sign * (1 << level)).cast("int")}).drop("next").distinct()
        now = checkpointed(now.where(~moves).unionByName(far))
    return now.select("anchor", "compare_year", "from_code", "to_code")


def all_link_distributions(edges: DataFrame, universe: DataFrame, first: int, last: int) -> DataFrame:
    """anchor, compare_year, class, n, share for every two years of first..last. D8"""
    out = None
    for sign in (1, -1):
        pairs = [(a, t) for a in range(first, last + 1) for t in range(first, last + 1) if (t - a) * sign > 0]
        part = relations_between(relation_table(edges, universe, first, last, sign), universe, pairs)
        out = part if out is None else out.unionByName(part)
    key = ["anchor", "compare_year"]
    return class_counts(relation_classes(out, key), key)


def chained_link_distribution(edges: DataFrame, universe: DataFrame, anchor: int, years: list[int]) -> DataFrame:
    """compare_year, class, n, share of the anchor's codes, which must be the
    same number in every year. D8"""
    out = checkpointed(class_counts(relation_classes(chained_relations(edges, universe, anchor, years), ["compare_year"]), ["compare_year"]))
    n = anchor_codes(universe, anchor).count()
    assert_empty(out.groupBy("compare_year").agg(F.sum("n").alias("total")).where(F.col("total") != n), f"years with other than {n} anchor codes")
    return out


def revision_exposure(edges: DataFrame, universe: DataFrame, anchor: int, years: list[int]) -> DataFrame:
    """compare_year, code (at the anchor), ever_non_one, ever_unknown,
    n_unknown, two_or_more, strict_one, final_class. D10

    A step's status of an anchor code is that of any code it has reached; the
    cumulative flags are running windows over the years.
    """
    direction = "a_to_b" if years[-1] > anchor else "b_to_a"
    reached = chained_relations(edges, universe, anchor, years)
    start = anchor_codes(universe, anchor).select(F.lit(anchor).alias("compare_year"), F.col("code").alias("from_code"), F.col("code").alias("to_code"))
    before = start.unionByName(reached.select("compare_year", "from_code", "to_code"))
    sign = 1 if years[-1] > anchor else -1
    steps = None
    for x, y in zip([anchor, *years], years):
        part = step_relation(edges, universe, x, y).withColumn("compare_year", F.lit(y))
        steps = part if steps is None else steps.unionByName(part)
    kinds = relation_classes(steps, ["compare_year"]).withColumnRenamed("from_code", "to_code")
    touched = before.withColumn("compare_year", F.col("compare_year") + sign).join(kinds, ["compare_year", "to_code"])
    unknown = F.col("class").isin("1:n", "m:n") if direction == "a_to_b" else F.col("class").isin("m:1", "m:n")
    per = touched.groupBy("compare_year", "from_code").agg(
        F.max((F.col("class") != "1:1").cast("int")).alias("non_one"), F.max(unknown.cast("int")).alias("unknown")
    )
    order = F.col("compare_year") if sign > 0 else -F.col("compare_year")
    w = W.partitionBy("from_code").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    final = relation_classes(reached, ["compare_year"]).withColumnRenamed("class", "final_class")
    return per.select(
        "compare_year", "from_code", (F.max("non_one").over(w) > 0).alias("ever_non_one"), (F.max("unknown").over(w) > 0).alias("ever_unknown"),
        F.sum("unknown").over(w).alias("n_unknown"),
    ).withColumns({"two_or_more": F.col("n_unknown") >= 2, "strict_one": ~F.col("ever_non_one")}).join(final, ["compare_year", "from_code"])


def exposure_summary(exposure: DataFrame, allow: DataFrame) -> DataFrame:
    """compare_year, population (all, allowed), metric, n, total, share. D11"""
    flags = ["ever_non_one", "ever_unknown", "two_or_more", "strict_one"]
    rows = exposure.withColumn("population", F.lit("all")).unionByName(
        exposure.join(allow.select(F.col("code").alias("from_code")), "from_code", "left_semi").withColumn("population", F.lit("allowed"))
    )
    long = rows.select("compare_year", "population", *[F.col(f).cast("int").alias(f) for f in flags]).unpivot(["compare_year", "population"], flags, "metric", "flag")
    out = long.groupBy("compare_year", "population", "metric").agg(F.sum("flag").alias("n"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("share", F.try_divide("n", "total"))


def benchmark_slice(summary: DataFrame, years: list[int]) -> DataFrame:
    """D12"""
    return summary.where(F.col("compare_year").isin(years))
