"""Bilateral persistence of flows across a revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.functions import metrics as M
from vintage.functions.codes import coefficient_cell, flow_is, normalise_code, not_in
from vintage.operators.concordance import nonbijective_codes, with_degrees
from vintage.sources.storage import checkpointed

#: Keys of a unit at each level of aggregation; the denominator adds nothing
#: but the group where the unit is a pair. B5
LEVELS = {"bilateral": ["REPORTER", "PARTNER"], "importer": ["REPORTER"], "aggregate": []}
DENOMINATOR = {"bilateral": [], "importer": ["REPORTER"], "aggregate": []}


def _year() -> Column:
    return F.substring(F.col("PERIOD").cast("string"), 1, 4).cast("int")


def bilateral_rows(trade: DataFrame, measure: str = "VALUE_EUR", flow: str = "1", no_reporters: tuple[str, ...] = (), no_partners: tuple[str, ...] = ()) -> DataFrame:
    """PERIOD, PRODUCT_NC, REPORTER, PARTNER, value: the rows of ``bilateral_totals``, not summed. B1"""
    rows = trade.where(flow_is(flow) & not_in(F.col("REPORTER"), no_reporters) & not_in(F.col("PARTNER"), no_partners))
    return rows.select("PERIOD", "PRODUCT_NC", "REPORTER", "PARTNER", F.col(measure).alias("value"))


def bilateral_totals(trade: DataFrame, measure: str = "VALUE_EUR", flow: str = "1", no_reporters: tuple[str, ...] = (), no_partners: tuple[str, ...] = ()) -> DataFrame:
    """year, REPORTER, PARTNER, code, value. B1"""
    rows = bilateral_rows(trade, measure, flow, no_reporters, no_partners)
    return rows.groupBy(_year().alias("year"), "REPORTER", "PARTNER", normalise_code(F.col("PRODUCT_NC")).alias("code")).agg(F.sum("value").alias("value"))


def fact_codes(trade: DataFrame, measure: str = "VALUE_EUR", flow: str = "1") -> DataFrame:
    """PERIOD, PRODUCT_NC, year, code, value: the codes of the facts and their totals. B1"""
    sums = trade.where(flow_is(flow)).groupBy("PERIOD", "PRODUCT_NC").agg(F.sum(measure).alias("value"))
    return sums.withColumns({"year": _year(), "code": normalise_code(F.col("PRODUCT_NC"))})


def carry_links(edges: DataFrame) -> DataFrame:
    """period, side, code, next: revised codes of either side, with the code of a
    strict 1:1 link if theirs is one. G11"""
    e, out = with_degrees(edges), None
    strict = (F.col("deg_a") == 1) & (F.col("deg_b") == 1)
    for s, o in (("a", "b"), ("b", "a")):
        part = e.groupBy(F.col(f"vintage_{s}_code").alias("code"), "period").agg(F.max(F.when(strict, F.col(f"vintage_{o}_code"))).alias("next"))
        part = part.select("period", F.lit(s).alias("side"), "code", "next")
        out = part if out is None else out.unionByName(part)
    return out


def _carry_step(rows: DataFrame, links: DataFrame, source: int, target: int) -> DataFrame:
    """Codes of a step through strict 1:1 links or, if not revised, as they are."""
    side, period = "a" if target > source else "b", f"{min(source, target)}{max(source, target)}"
    step = links.where((F.col("period") == period) & (F.col("side") == side)).select("code", "next", F.lit(True).alias("revised"))
    out = rows.join(step, "code", "left")
    out = out.withColumn("code", F.coalesce("next", F.when(F.col("revised").isNull(), F.col("code")))).where("code is not null")
    return out.drop("next", "revised")


def carry_codes(codes: DataFrame, edges: DataFrame, source: int, target: int, links: DataFrame | None = None) -> DataFrame:
    """Rows with a code, carried year by year to another vintage. B2"""
    links, sign = links or carry_links(edges), 1 if target > source else -1
    for y in range(source, target, sign):
        codes = _carry_step(codes, links, y, y + sign)
    return codes.distinct()


def code_map(codes: DataFrame, edges: DataFrame, basis: int, first: int, last: int, links: DataFrame | None = None) -> DataFrame:
    """year, code, basis_code of the codes (year, code) that reach the basis
    vintage through strict links. All years walk together towards the basis:
    one join of codes for each step, written as it goes. B3"""
    links = links or checkpointed(carry_links(edges))
    own = codes.select("year", F.col("code").alias("origin"), "code").distinct()
    out = own.where(F.col("year") == basis)
    for sign, years in ((1, range(first, basis)), (-1, range(last, basis, -1))):
        now = None
        for y in years:
            here = own.where(F.col("year") == y)
            now = checkpointed(_carry_step(here if now is None else now.unionByName(here), links, y, y + sign))
        out = out if now is None else out.unionByName(now)
    return out.select("year", F.col("origin").alias("code"), F.col("code").alias("basis_code"))


def carry_rows(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Fact rows (year, code, value and units) in the basis vintage of the code
    map ``codes``, summed again: one join and one aggregate. B3"""
    both = rows.join(codes, ["year", "code"]).drop("code").withColumnRenamed("basis_code", "code")
    return both.groupBy(*[c for c in both.columns if c != "value"]).agg(F.sum("value").alias("value"))


def scaled_flows(rows: DataFrame, group_map: DataFrame, level: str = "bilateral", by: tuple[str, ...] = ()) -> DataFrame:
    """by..., year, unit..., group_id, code, flow: value over the denominator's
    total; groups with trade only. ``by`` are further keys of both tables. B4, B5"""
    unit, of = LEVELS[level], [*by, "year", *DENOMINATOR[level], "group_id"]
    found = rows.join(group_map, [*by, "code"]).groupBy(*by, "year", *unit, "group_id", "code").agg(F.sum("value").alias("value"))
    total = found.groupBy(*of).agg(F.sum("value").alias("_t")).where("_t > 0")  # not a window: a giant group's pairs stay where they are
    return found.join(total, of).withColumn("flow", F.col("value") / F.col("_t")).select(*by, "year", *unit, "group_id", "code", "flow")


def completed_panel(flows: DataFrame, group_map: DataFrame, level: str = "bilateral", by: tuple[str, ...] = ()) -> DataFrame:
    """by..., year, unit..., group_id, code, lag, flow: units seen in a group in either
    of two neighbouring years, times the group's codes, 0 where absent. B6, B7"""
    unit = [*by, *LEVELS[level]]
    years = flows.select(*by, "year").distinct()
    pairs = years.select(*by, (F.col("year") + 1).alias("year")).join(years, [*by, "year"])
    seen = flows.select("year", *unit, "group_id").distinct()
    either = seen.union(seen.withColumn("year", F.col("year") + 1)).distinct().join(pairs, [*by, "year"], "left_semi")
    cells = either.join(group_map.select(*by, "group_id", "code").distinct(), [*by, "group_id"])
    key = ["year", *unit, "group_id", "code"]
    now = flows.select(*key, "flow")
    before = flows.select((F.col("year") + 1).alias("year"), *unit, "group_id", "code", F.col("flow").alias("lag"))
    return cells.join(now, key, "left").join(before, key, "left").na.fill(0.0, ["flow", "lag"])


def contaminated_groups(group_map: DataFrame, codes: dict[int, DataFrame], edges: DataFrame, at: int, links: DataFrame | None = None) -> DataFrame:
    """group_id, code of the group map hit by codes of other years
    (year -> code), carried to its vintage ``at``. B8, B9"""
    out = None
    for y, bad in codes.items():
        hit = group_map.join(carry_codes(bad, edges, y, at, links), "code", "left_semi").select("group_id", "code")
        out = hit if out is None else out.union(hit)
    return out.distinct()


def contamination(maps: DataFrame, edges: DataFrame, break_a: int, years: list[int]) -> DataFrame:
    """year, side, group_id, code: codes of the groups (side, code, group_id)
    that non-bijective links of other steps reach. Steps that end by ``break_a`` are
    carried on to the a side, those after the break back to the b side; a step's own far
    side cannot be carried through it. B8"""
    out = None
    for y in years:
        if y + 1 <= break_a:
            side, source, at = "b", y + 1, break_a
        elif y >= break_a + 1:
            side, source, at = "a", y, break_a + 1
        else:
            continue
        bad = nonbijective_codes(edges.where(F.col("period") == f"{y}{y + 1}")).where(F.col("side") == side).select("code")
        own = maps.where(F.col("side") == ("a" if at == break_a else "b"))
        hit = own.join(carry_codes(bad, edges, source, at), "code", "left_semi").select(F.lit(y).alias("year"), "side", "group_id", "code")
        out = hit if out is None else out.union(hit)
    return out


def deterministic_basis(universe: DataFrame, group_map: DataFrame, year: int) -> DataFrame:
    """code, group_id of all codes of a year; those outside the groups are
    groups of their own. B10"""
    codes = universe.where(F.col("year") == year).select("code").distinct()
    return codes.join(group_map.select("code", "group_id"), "code", "left").withColumn(
        "group_id", F.coalesce("group_id", F.concat_ws("::", F.lit("singleton"), F.lit(str(year)), "code"))
    )


def basis_side(year: Column, break_a: Column) -> Column:
    """The side of the break whose vintage a pair of years is measured in, by its later year. B11"""
    return F.when(year <= break_a, "a").otherwise("b")


def side_codes(codes: DataFrame, edges: DataFrame, break_a: int, first: int, last: int, links: DataFrame | None = None) -> DataFrame:
    """side, year, code, basis_code: codes (year, code) in the vintage of their side of
    the break between ``break_a`` and the year after. The two years at the break are
    carried to both, so that the pair across it can be built on either side. B11"""
    links, out = links or checkpointed(carry_links(edges)), None
    for side, basis, lo, hi in (("a", break_a, first, break_a + 1), ("b", break_a + 1, break_a, last)):
        own = code_map(codes.where(F.col("year").between(lo, hi)), edges, basis, lo, hi, links).withColumn("side", F.lit(side))
        out = own if out is None else out.unionByName(own)
    return out


def side_maps(edges: DataFrame, groups: DataFrame, period: str) -> DataFrame:
    """side, code, group_id of the codes of chosen groups (group_id) at a break. B11"""
    at = edges.where(F.col("period") == period).join(groups.select("group_id"), "group_id", "left_semi")
    a = at.select(F.lit("a").alias("side"), F.col("vintage_a_code").alias("code"), "group_id")
    return a.union(at.select(F.lit("b"), "vintage_b_code", "group_id")).distinct()


def persistence(panel: DataFrame, by: tuple[str, ...] = ("year",)) -> DataFrame:
    """by..., coef, se, n, r2_45 of flow on its lag. B12"""
    coef = M.slope_hc1(panel, "lag", "flow", by)
    fit = panel.groupBy(*by).agg(M.r2_45(F.col("lag"), F.col("flow")).alias("r2_45"))
    return coef.join(fit, list(by))


def panel_fits(facts: DataFrame, codes: DataFrame, group_map: DataFrame, years: list[int], by: tuple[str, ...]) -> DataFrame:
    """``persistence`` of the bilateral ``completed_panel``, without writing out the panel.

    ``facts`` are rows (PERIOD, PRODUCT_NC, REPORTER, PARTNER, value), summed or not;
    ``codes`` has what became of their codes (PERIOD, PRODUCT_NC, year, code and value, the code's
    total, with those of ``by`` that matter); ``group_map`` has by..., code, group_id. The totals of groups
    come from those of codes, so one join makes rows shares and one aggregate makes them cells with
    a column a year. A cell that is zero in both years only adds to n: it is counted from the pairs of
    countries seen in its group, times the group's codes. B4-B7, B12"""
    unit, of = LEVELS["bilateral"], ["_group", "year"]
    names = checkpointed(group_map.select(*by).distinct().coalesce(1).withColumn("_by", F.monotonically_increasing_id()))
    places = group_map.select("code", "group_id", *by).distinct().join(F.broadcast(names), list(by))
    groups = checkpointed(places.groupBy("group_id", "_by").agg(F.count(F.lit(1)).alias("_m")).withColumn("_group", F.monotonically_increasing_id()))
    places = checkpointed(places.join(groups, ["group_id", "_by"]).drop("group_id").withColumn("_cell", F.monotonically_increasing_id()))
    entries = codes.join(places, ["code", *[c for c in by if c in codes.columns]])
    entries = checkpointed(entries.select("PRODUCT_NC", "PERIOD", "year", "value", "_by", "_group", "_m", "_cell"))
    total = checkpointed(entries.groupBy("_by", *of).agg(F.sum("value").alias("_t")).where("_t > 0"))
    entries = entries.drop("value").join(total.drop("_by"), of)
    nowhere = F.lit(False)  # a pair of countries with an unknown one is seen, but equals no other year's
    for u in unit:
        nowhere = nowhere | F.col(u).isNull()
    part = F.when(nowhere, 0.0).otherwise(F.nanvl(F.coalesce(F.col("value") / F.col("_t"), F.lit(0.0)), F.lit(0.0)))
    parts = facts.join(entries, ["PRODUCT_NC", "PERIOD"]).withColumn("_part", part)
    key = ["_by", "_group", "_m"]
    cells = checkpointed(parts.groupBy(*key, "_cell", *unit).agg(*[F.sum(F.when(F.col("year") == y, F.col("_part"))).alias(f"_{y}") for y in years]))
    seen = lambda y: F.col(f"_{y - 1}").isNotNull() | F.col(f"_{y}").isNotNull()
    pairs, zero = None, F.lit(0.0)
    for y in years[1:]:
        two = cells.where(seen(y)).select("_by", "_m", F.lit(y).alias("year"), F.coalesce(f"_{y - 1}", zero).alias("lag"), F.coalesce(f"_{y}", zero).alias("flow"))
        pairs = two if pairs is None else pairs.unionByName(two)
    several = cells.where("_m > 1").groupBy(*key, *unit).agg(*[F.max(seen(y)).alias(f"_{y}") for y in years[1:]])
    several = several.groupBy("_by").agg(*[F.sum(F.when(F.col(f"_{y}"), F.col("_m")).otherwise(0)).alias(str(y)) for y in years[1:]])
    several = several.unpivot(["_by"], [str(y) for y in years[1:]], "year", "_several").withColumn("year", F.col("year").cast("int"))
    there = checkpointed(total.select("_by", "year").distinct())
    there = there.select("_by", (F.col("year") + 1).alias("year")).join(there, ["_by", "year"]).join(names, "_by")
    sums = pairs.groupBy("_by", "year").agg(F.count(F.when(F.col("_m") == 1, 1)).alias("_single"), *M.line_sums(F.col("lag"), F.col("flow")))
    sums = there.join(F.broadcast(sums.join(several, ["_by", "year"], "left")), ["_by", "year"])
    cells_of = F.col("_single") + F.coalesce("_several", F.lit(0)) - F.col("_bad")
    return sums.select(*by, "year", *M.line_fit(cells_of))


def panel_diagnostics(panel: DataFrame, level: str = "bilateral", by: tuple[str, ...] = ("year",)) -> DataFrame:
    """Counts of groups, codes, units, cells and positive flows. B13"""
    unit = F.struct(*LEVELS[level]) if LEVELS[level] else F.lit(1)
    return panel.groupBy(*by).agg(
        F.countDistinct("group_id").alias("n_groups"), F.countDistinct("code").alias("n_codes"), F.countDistinct(unit).alias("n_units"),
        F.count(F.lit(1)).alias("n_cells"), F.count(F.when(F.col("flow") > 0, 1)).alias("n_positive"), F.count(F.when(F.col("lag") > 0, 1)).alias("n_positive_lag"),
    )


def result_table(results: DataFrame, row: str, years: list[int]) -> DataFrame:
    """Cells "coef (se)" by row and year. B14"""
    return results.withColumn("cell", coefficient_cell(F.col("coef"), F.col("se"))).groupBy(row).pivot("year", years).agg(F.first("cell"))


def carry_to_basis(rows: DataFrame, edges: DataFrame, basis: int, first: int, last: int) -> DataFrame:
    """Rows of the years first..last carried to one vintage."""
    rows = rows.where(F.col("year").between(first, last))
    return checkpointed(carry_rows(rows, code_map(rows.select("year", "code"), edges, basis, first, last)))
