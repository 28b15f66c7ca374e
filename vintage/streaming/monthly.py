"""Re-coding of monthly files as they arrive (A7): a stream joined with a static
weight table, and a sink that sums each batch once however often it is run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vintage.operators.apply import CODE, MEASURES, apply_wide, keep_last, with_year
from vintage.sources.storage import exists

#: A month's rows of a higher revision replace those of lower ones.
REVISION = "REVISION"


def recode_stream(trade: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows of a stream of monthly trade with the new code and wide measures,
    one for each link; the sink sums them by its ids, as re-coding is linear.

    ``weights``: origin_year, measure, from_code, to_code, weight.
    """
    w = weights.groupBy("origin_year", F.col("from_code").alias(CODE), "to_code").agg(
        F.sum(F.when(F.col("measure") == "VALUE_EUR", F.col("weight"))).alias("_v"), F.sum(F.when(F.col("measure") == "QUANTITY_KG", F.col("weight"))).alias("_q")
    )
    both = with_year(trade).join(w, ["origin_year", CODE], "left")
    same = F.col("to_code").isNull()
    out = {f"{m}_w_{n}": F.col(m) * F.when(same, 1.0).otherwise(F.coalesce(F.col(c), F.lit(0.0))) for n, c in (("value", "_v"), ("quantity", "_q")) for m in MEASURES}
    return both.withColumns({**out, CODE: F.coalesce("to_code", CODE)}).drop("to_code", "_v", "_q", *MEASURES)


def write_batch(rows: DataFrame, batch: int, weights: DataFrame, path: str) -> None:
    """One batch of monthly rows (with REVISION), re-coded, summed and written to
    its own partitions of the sink, (PERIOD, REVISION, batch): run again, it replaces
    what it wrote. Beside the sums, a row for each month and revision says what
    came in: the record of finished months."""
    rows = with_year(rows)
    sums = apply_wide(rows, weights).drop("origin_year").withColumn("batch", F.lit(batch).cast("long"))
    parts = {"mode": "overwrite", "partitionOverwriteMode": "dynamic"}
    sums.write.mode("overwrite").options(**parts).partitionBy("PERIOD", REVISION, "batch").parquet(f"{path}/sums")
    seen = rows.groupBy("PERIOD", REVISION).agg(F.count(F.lit(1)).alias("n_rows_in"), F.sum("VALUE_EUR").alias("value_in")).withColumn("batch", F.lit(batch).cast("long"))
    seen.coalesce(1).write.mode("overwrite").options(**parts).partitionBy("batch").parquet(f"{path}/seen")  # as many rows as a batch has months


def sink_months(stream: DataFrame, weights: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of monthly rows (with REVISION) into the sink at ``path``; takes
    what is there and ends. A batch may come again after a failure between the
    sink and the stream's own log: its id names its partitions, so nothing is added twice."""
    return stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, weights, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(rows: DataFrame) -> DataFrame:
    """Rows of the last revision of each month."""
    last = rows.groupBy("PERIOD").agg(F.max(REVISION).alias(REVISION))
    return rows.join(F.broadcast(last), ["PERIOD", REVISION])  # one row a month


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """The sums of every month, of its last revision, over all batches."""
    rows = _last(spark.read.parquet(f"{path}/sums"))
    wide = [c for c in rows.columns if c.startswith(MEASURES)]
    return rows.groupBy(*[c for c in rows.columns if c not in (*wide, REVISION, "batch")]).agg(*[F.sum(c).alias(c) for c in wide])


def finished_months(spark: SparkSession, path: str) -> DataFrame:
    """PERIOD, REVISION, batch (the last), n_rows_in, value_in of each month's
    last revision: the summaries of all batches merged. A9"""
    if not exists(spark, f"{path}/seen"):
        return spark.createDataFrame([], f"PERIOD int, {REVISION} int, batch long, n_rows_in long, value_in double")
    rows = _last(spark.read.parquet(f"{path}/seen"))
    by = rows.groupBy("PERIOD", REVISION, "batch").agg(F.sum("n_rows_in").alias("n_rows_in"), F.sum("value_in").alias("value_in"))
    total = by.groupBy("PERIOD").agg(F.sum("n_rows_in").alias("n_rows_in"), F.sum("value_in").alias("value_in"))
    return keep_last(by.drop("n_rows_in", "value_in"), ["PERIOD"], "batch").join(total, "PERIOD")


def pending_months(planned: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Planned months (PERIOD, REVISION) that the sink lacks or has in an older revision. S10"""
    done = finished_months(spark, path).select("PERIOD", F.col(REVISION).alias("_done"))
    return planned.join(done, "PERIOD", "left").where(F.col("_done").isNull() | (F.col("_done") < F.col(REVISION))).drop("_done")
