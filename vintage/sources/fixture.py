"""Trade panel and correspondence derived from the given tables.

Every row of ``part`` is a product, in blocks of four, and carries a code for
each year; a block is re-coded at most twice, by one of five patterns. So groups,
chains and code lists grow with the tables. A code has 8 digits, enough for 25
million parts. The statements are the same text for Spark and for the DuckDB oracle;
Spark runs them in two parts, codes first, so that facts and links read codes as a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.sources.storage import checkpointed

#: Common table expressions: slot0, yrs, slot1, slot, and from these edges, trade.
_SLOTS = """
slot0 AS (SELECT CAST(p_partkey AS BIGINT) s, CAST(floor(p_partkey/4) AS BIGINT) b, CAST(p_partkey % 4 AS INT) r FROM part),
yrs AS (SELECT DISTINCT CAST(year(l_shipdate) AS INT) yr FROM lineitem),
slot1 AS (SELECT s, b, r, b%5 AS p, yr, CASE WHEN b%5=4 THEN 0 ELSE CAST(floor((yr-1995-(b%3)+2)/3) AS INT) END AS v FROM slot0 CROSS JOIN yrs),
slot AS (SELECT s, yr, p, v, lpad(CAST(100+16*b+4*v+ CASE
    WHEN p=1 AND v%2=1 THEN 0
    WHEN p=2 AND v%2=0 THEN CAST(floor(r/2) AS INT)
    WHEN p=2 THEN r%2
    WHEN p=3 AND v%2=0 THEN CASE WHEN r=0 THEN 0 ELSE r-1 END
    WHEN p=3 THEN CASE WHEN r=0 THEN 0 WHEN r=3 THEN 2 ELSE 1 END
    ELSE r END AS STRING),8,'0') AS code FROM slot1)"""
_FACTS = """
edges AS (SELECT DISTINCT concat(CAST(x.yr AS STRING),CAST(y.yr AS STRING)) AS period, CAST(x.yr AS STRING) AS vintage_a_year, CAST(y.yr AS STRING) AS vintage_b_year,
    x.code AS vintage_a_code, y.code AS vintage_b_code
  FROM slot x JOIN slot y ON x.s=y.s AND y.yr=x.yr+1 WHERE x.v<>y.v),
trade_rows AS (SELECT concat('C',lpad(CAST(c_nationkey AS STRING),2,'0')) AS REPORTER, concat('S',lpad(CAST(s_nationkey AS STRING),2,'0')) AS PARTNER,
    CASE WHEN c_nationkey%5=s_nationkey%5 THEN 'I' ELSE 'E' END AS TRADE_TYPE, code AS PRODUCT_NC, CASE WHEN l_returnflag='A' THEN '2' ELSE '1' END AS FLOW,
    CAST(year(l_shipdate) AS INT) AS yr, CAST(month(l_shipdate) AS INT) AS mon, l_extendedprice, l_quantity
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey
    JOIN slot ON slot.s=l_partkey AND slot.yr=year(l_shipdate)),
trade AS (SELECT REPORTER, PARTNER, TRADE_TYPE, PRODUCT_NC, FLOW, yr AS PERIOD, sum(l_extendedprice) AS VALUE_EUR, sum(l_quantity) AS QUANTITY_KG
  FROM trade_rows GROUP BY 1,2,3,4,5,6),
trade_monthly AS (SELECT REPORTER, PARTNER, TRADE_TYPE, PRODUCT_NC, FLOW, yr*100+mon AS PERIOD, sum(l_extendedprice) AS VALUE_EUR, sum(l_quantity) AS QUANTITY_KG
  FROM trade_rows GROUP BY 1,2,3,4,5,6)"""
CTES = f"{_SLOTS},{_FACTS}"
#: Of Spark alone: ``trade`` before its sums, and without its partners.
_BY_CODE = """,
trade_lines AS (SELECT REPORTER, PARTNER, PRODUCT_NC, FLOW, yr AS PERIOD, l_extendedprice AS VALUE_EUR, l_quantity AS QUANTITY_KG FROM trade_rows),
trade_by_code AS (SELECT PRODUCT_NC, FLOW, yr AS PERIOD, sum(l_extendedprice) AS VALUE_EUR, sum(l_quantity) AS QUANTITY_KG FROM trade_rows GROUP BY 1,2,3)"""

_TABLES = ("lineitem", "orders", "customer", "supplier")


@lru_cache(maxsize=2)
def _one_line(text: str) -> str:
    return " ".join(text.split())


def _run(spark: SparkSession, expressions: str, name: str, frames: dict[str, DataFrame]) -> DataFrame:
    text = f"WITH {_one_line(expressions)} SELECT * FROM {name}"
    for t in frames:
        for verb in ("FROM", "JOIN"):
            for end in (" ", ")"):
                text = text.replace(f"{verb} {t}{end}", f"{verb} {{{t}}}{end}")
        text = text.replace(f"{{{t}}} ON ", f"{{{t}}} {t} ON ")
    return spark.sql(text, **{t: f for t, f in frames.items() if f"{{{t}}}" in text})


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, yr, p, v, code: the code of every part and year, written once.

    The parts are dealt over the tasks and the few years sent to each: left to the
    planner, the parts go whole to one task that crosses them with the years. Written,
    a code is a column; else its expression is copied into whatever is made of codes."""
    def make() -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem")}
        frames["part"] = frames["part"].select("p_partkey").repartition("p_partkey")
        return checkpointed(_run(spark, _SLOTS, "slot", frames | {"yrs": F.broadcast(_run(spark, _SLOTS, "yrs", frames))}))

    return held(spark, sf_dir, "slots", make)


def _query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES} | {"slot": slots(spark, sf_dir)}
    # the buyer's nation is joined to the orders, not to their lines, of which there are several times as many
    frames["orders"] = frames["orders"].join(frames.pop("customer"), F.expr("o_custkey = c_custkey")).select("o_orderkey", "c_nationkey")
    return _run(spark, _FACTS.replace(" JOIN customer ON o_custkey=c_custkey", "") + _BY_CODE, name, frames)


#: What a query has derived so far, by table folder and name; none outside of ``once``.
_held: ContextVar[dict | None] = ContextVar("held", default=None)


@contextmanager
def once() -> Iterator[None]:
    """While a query is built, what ``held`` derives for it is derived once."""
    token = _held.set({})
    try:
        yield
    finally:
        _held.reset(token)


def held(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """What ``make`` gives, or gave before in the same query."""
    known = _held.get()
    if known is None:
        return make()
    if (spark, sf_dir, name) not in known:
        known[spark, sf_dir, name] = make()
    return known[spark, sf_dir, name]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a query written once, as it is small beside the facts."""
    if _held.get() is None:
        return _query(spark, sf_dir, "edges")
    return held(spark, sf_dir, "edges", lambda: checkpointed(_query(spark, sf_dir, "edges")))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _held.get() or {}
    return known.get((spark, sf_dir, "trade")) or _query(spark, sf_dir, "trade")


def stored_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts written once, for queries that read them several times."""
    return held(spark, sf_dir, "trade", lambda: checkpointed(_query(spark, sf_dir, "trade")))


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the facts are sums of, written once, for queries that sum them by other keys only."""
    return held(spark, sf_dir, "lines", lambda: checkpointed(_query(spark, sf_dir, "trade_lines")))


def trade_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRODUCT_NC, FLOW, PERIOD and the sums of the facts, for queries that need codes and totals
    but no partners: from the facts if they are written, else summed straight from the lines, written once."""
    known = _held.get() or {}
    whole, lines = (known.get((spark, sf_dir, name)) for name in ("trade", "lines"))
    if whole:
        return whole.select("PRODUCT_NC", "FLOW", "PERIOD", "VALUE_EUR", "QUANTITY_KG")
    if lines:
        sums = [F.sum(m).alias(m) for m in ("VALUE_EUR", "QUANTITY_KG")]
        return held(spark, sf_dir, "by code", lambda: checkpointed(lines.groupBy("PRODUCT_NC", "FLOW", "PERIOD").agg(*sums)))
    return held(spark, sf_dir, "by code", lambda: checkpointed(_query(spark, sf_dir, "trade_by_code")))


def trade_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "trade_monthly")
