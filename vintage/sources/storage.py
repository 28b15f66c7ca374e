"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table under the shared folder that
    ``spark.checkpoint.dir`` names, and read back: computed once, and safe
    when executors are lost. The table goes when the driver ends. One that came
    from here is given back as it is."""
    if df.__dict__.get("_vintage_stored"):
        return df
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._vintage_stored = True
    return stored


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver ends. Only where
    all run on one machine (tests) may the setting be absent: then a folder of our
    own is used; a cluster without it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-vintage-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/vintage-{uuid.uuid4().hex[:16]}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """``df`` as a table in sorted buckets by ``keys``, in the shared folder: joins of
    tables with as many buckets of the same keys need no exchange."""
    spark, name = df.sparkSession, f"vintage_{uuid.uuid4().hex[:16]}"
    laid = df.repartition(buckets, *keys)  # a file for each bucket
    laid.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", shared_path(spark)).saveAsTable(name)
    return spark.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the cluster's own cleaning applies
            return
