"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Fixed: the word pattern of the contracts, and its complement.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir``
    names it. Only where all run on one machine (tests) may it be unset: then a
    folder is made and set; a cluster without the setting is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-vintage-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/vintage-{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and
    the rows survive the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the cluster's own cleaning applies
            return


_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def exact(df: DataFrame, columns: list[str]) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """``df`` with integers among ``columns`` as text, the schema of these
    columns, and what turns them back: pandas has no integers with nulls, and
    would round ids beyond 2**53 in a batch that holds a null."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns}
    whole = [c for c, k in kinds.items() if k in _INTEGERS]
    out = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in whole}) if whole else df
    schema = ", ".join(f"`{c}` {'string' if c in whole else k}" for c, k in kinds.items())
    return out, schema, lambda made: made.withColumns({c: F.col(f"`{c}`").cast(kinds[c]) for c in whole}) if whole else made


#: A key is hot if it has more rows than LEAST_HOT, and than the rows divided by HOT_KEYS.
LEAST_HOT, HOT_KEYS = 200, 10_000


def hot_keys(counts: DataFrame, keys: list[str], total: int) -> DataFrame | None:
    """keys..., _fan: in how many parts to deal the rows of each hot key.
    ``counts`` has keys... and _c (rows of the key), ``total`` their sum; at most
    HOT_KEYS keys can be hot, so the table may come to the driver and be broadcast."""
    most = max(LEAST_HOT, -(-total // HOT_KEYS))
    rows = counts.where(F.col("_c") > most).select(*keys, F.ceil(F.col("_c") / most).cast("int").alias("_fan")).collect()
    schema = StructType([*counts.select(*keys).schema, StructField("_fan", IntegerType())])
    return counts.sparkSession.createDataFrame([tuple(r) for r in rows], schema) if rows else None


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, salt: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each value of
    ``keys``. Rows of hot keys are dealt by a hash of the ``salt`` columns over
    ``_fan`` parts, to each of which the row of ``right`` is copied."""
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    dealt = left.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("_fan")).cast("int"), F.lit(0))).drop("_fan")
    copied = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))).drop("_fan")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(doc_id: str, divisor: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(divisor))


def words_of(text: bytes) -> list[bytes]:
    """The contract's words of UTF-8 bytes: bytes.split() cuts at exactly
    the six ASCII white-space bytes that the pattern names."""
    return text.split()


# ---------------------------------------------------------------- hashing
#: Multiplier of the prefix polynomial (odd, so invertible modulo 2**64).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the polynomial's weak low bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Growing tables of powers of the multiplier and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE), dtype=np.uint64)])
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, inverse), dtype=np.uint64)])
        return self.up, self.down


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of data[:i], modulo 2**64."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, down = POWERS.upto(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


#: Longest word that is hashed by the polynomial.
LONG = 64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of the bytes, A-Z lower-cased if asked.
    Words of more than LONG bytes go through xxh3: texts made to collide in the
    polynomial modulo 2**64, whatever its base, are longer than that."""
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    data = _LOWER[data] if lower else data
    out = span_hashes(prefix_hashes(data), start, end)
    for i in np.flatnonzero(end - start > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out, start, end


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; fewer words make one run of them all;
    no words make none."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(out)])
    return out
