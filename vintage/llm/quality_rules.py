"""Operator 9: quality rules, with a hashed n-gram likelihood-ratio verdict.

Words and word pairs are hashed into ``BUCKETS`` features. Their counts over
the whole corpus and over a trusted target give two smoothed multinomials; a
document's score is the mean over its features of log(target / raw), and it is
kept if no base rule fails and the score reaches a threshold: the same
decision for the same text, with no sampling of documents.

The threshold comes from the data, as few trusted rows leave sparse counts that
pull the score of every text outside them down: the trusted rows are dealt in
two halves by a hash of their text (equal texts together), each half is scored
with weights from the other, and the threshold is the ``QUANTILE`` of the
scores of those that pass the base rules.

The trusted target is every document labelled of good quality: its ids are joined in a
shuffle, as they grow with the corpus; the raw counts are over every
document. The weights are ``BUCKETS`` numbers whatever the corpus, so they are a literal in the plan.

Everything is DataFrame expressions; nothing runs in Python on the executors.

Edge cases: null text has no words and fails; a text of under 50 words fails;
with no trusted rows every score is 0; if a half has no words, the ratio
rejects nothing; texts of any length are read whole; repeated rows give
repeated rows; an empty table gives no rows; extra columns are kept by ``judge``
unless they clash with its own, which then win; ``passed`` gives the input's
columns back as they were.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.common import SPACE, materialize, table

BUCKETS = 16384
#: Of ``judge`` alone, for weights that are not held out; the queries take theirs from the data.
THRESHOLD = -0.045
#: Share of clean texts outside the trusted rows that the ratio may reject.
QUANTILE = 0.02
#: Fixed: the symbols and the white space that the contract names.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _bucket_of_pair(word: Column, after: Column) -> Column:
    return F.pmod(F.xxhash64(word, after), F.lit(BUCKETS)).cast("int")


def _pairs(w: Column) -> Column:
    """The bucket of each pair of neighbouring words."""
    n = F.size(w) - 1
    return F.when(n >= 1, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), _bucket_of_pair))


def _log_ratio(raw: list[int], target: list[int]) -> list[float]:
    smooth = 1.0
    if not sum(target):
        return [0.0] * BUCKETS
    shift = math.log(sum(raw) + smooth * BUCKETS) - math.log(sum(target) + smooth * BUCKETS)
    return [math.log(t + smooth) - math.log(r + smooth) + shift for t, r in zip(target, raw)]


def _trusted_texts(docs: DataFrame, trusted: DataFrame, key: str, text: str) -> DataFrame:
    """Text and __half (0 or 1) of every trusted document, written once; only ids and trusted texts outlast the join."""
    mark = trusted.select(F.col(key).alias("__id")).distinct()
    half = F.pmod(F.xxhash64(F.lit("half"), F.coalesce(F.col(text), F.lit(""))), F.lit(2)).cast("int")
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias(text))
    # never by broadcast, as the ids grow with the corpus: the work is of one kind, and in proportion, at every size
    return materialize(rows.join(mark.hint("merge"), F.col("__key") == F.col("__id")).select(text, half.alias("__half")), "trusted")


def _features(docs: DataFrame, text: str, *also: str) -> DataFrame:
    w = docs.select(*also, words(F.col(text)).alias("w"))
    features = F.concat(F.transform("w", _bucket), F.coalesce(_pairs(F.col("w")), F.array().cast("array<int>")))
    return w.select(*also, F.explode(features).alias("bucket"))


def _counts(docs: DataFrame, texts: DataFrame, text: str) -> tuple[list[int], list[int], list[int]]:
    """Features of each bucket in all documents and in either half of the trusted texts."""
    raw, zero, one = [0] * BUCKETS, [0] * BUCKETS, [0] * BUCKETS
    for r in _features(docs, text).groupBy("bucket").count().collect():  # BUCKETS rows at most
        raw[r.bucket] = r["count"]
    for r in _features(texts, text, "__half").groupBy("__half", "bucket").count().collect():  # twice as many
        (one if r["__half"] else zero)[r.bucket] = r["count"]
    return raw, zero, one


def weights(docs: DataFrame, trusted: DataFrame | None, key: str = "doc_id", text: str = "text") -> list[float]:
    """log(target / raw) of each bucket, from all documents; ``trusted`` has
    the ids of the target."""
    return fit(docs, trusted, key, text)[0]


def fit(docs: DataFrame, trusted: DataFrame | None, key: str = "doc_id", text: str = "text", quantile: float | None = None) -> tuple[list[float], float | None]:
    """The weights and, if a quantile is given, the threshold."""
    if trusted is None:
        return [0.0] * BUCKETS, None if quantile is None else -math.inf
    texts = _trusted_texts(docs, trusted, key, text)
    raw, zero, one = _counts(docs, texts, text)
    by_bucket = _log_ratio(raw, [a + b for a, b in zip(zero, one)])
    if quantile is None:
        return by_bucket, None
    if not sum(zero) or not sum(one):
        return by_bucket, -math.inf
    rows = base_columns(texts, text)
    # the other half's weights; the row number is there as in judge
    rows = rows.select("base_failed", score("__w", _log_ratio(raw, one) + _log_ratio(raw, zero), F.col("__half") * BUCKETS).alias("s"), F.monotonically_increasing_id().alias("__row"))
    # counted by score to four places first: however many rows there are, few numbers reach the quantile
    counted = rows.groupBy(F.round(F.when(~F.col("base_failed") & (F.col("__row") >= 0), F.col("s")), 4).alias("s")).count()
    found = counted.agg(F.percentile("s", F.lit(quantile), F.col("count"))).first()[0]
    return by_bucket, -math.inf if found is None else found


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Add _w (the words), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__w", words(F.col(text)))
    n = F.size("__w")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long"),
        "__lines": lines,
        "__windows": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.col("__w")[i], F.col("__w")[i + 1], F.col("__w")[i + 2]))),
    })
    df = df.withColumns({
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        # only texts in which a window repeats are sorted
        "__sorted": F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    })
    s, last = F.col("__sorted"), F.size("__sorted") - 1
    twice = F.filter(
        F.transform(s, lambda x, j: F.when(((j > 0) & (s[F.greatest(j - 1, F.lit(0))].h == x.h)) | ((j < last) & (s[F.least(j + 1, last)].h == x.h)), x.i)),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("__twice", F.when(s.isNotNull(), F.sort_array(twice)))
    covered = F.aggregate(
        "__twice", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
        lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a.at)).alias("n"), i.alias("at")), lambda a: a.n,
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__lines", "__windows", "__sorted", "__twice")


def score(w: str, by_bucket: list[float], first: Column | None = None) -> Column:
    """Mean weight of the words and word pairs of array column ``w``; 0 if none.
    ``first`` is where the row's own weights begin, if there are several tables.

    The table is one text literal that the planner turns into an array once: a
    literal for each number would be as many nodes in every copy of the plan."""
    table = F.split(F.lit(",".join(map(repr, by_bucket))), ",").cast("array<double>")
    at = (lambda b: b) if first is None else (lambda b: b + first)
    singles = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.get(table, at(_bucket(x))))
    pairs = F.aggregate(F.coalesce(_pairs(F.col(w)), F.array().cast("array<int>")), F.lit(0.0), lambda a, b: a + F.get(table, at(b)))
    n = F.size(w)
    return F.when(n > 0, (singles + pairs) / (2 * n - 1)).otherwise(F.lit(0.0))


def judge(docs: DataFrame, trusted: DataFrame | None, key: str = "doc_id", text: str = "text", threshold: float | None = THRESHOLD) -> DataFrame:
    """``docs`` with the base columns, llr (double) and kept (boolean); with
    no ``threshold`` it comes from the data.

    The row number is there for the planner alone: a filter is not pushed
    below it, where the columns' expressions would be written out again
    inside each other.
    """
    by_bucket, found = fit(docs, trusted, key, text, QUANTILE if threshold is None else None)
    threshold = found if threshold is None else threshold
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", "__w", "__row"]
    out = base_columns(docs.drop(*own), text).withColumn("llr", score("__w", by_bucket))
    out = out.withColumn("__row", F.monotonically_increasing_id())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & (F.col("__row") >= 0)).drop("__w", "__row")


def passed(docs: DataFrame, trusted: DataFrame | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they had."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row_of")
    judged = judge(docs.select(F.col(key), F.col(text), own), trusted, key, text, threshold=None)
    return judged.where("kept").select("__row_of.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all rows labelled good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs.select("doc_id", "text"), trusted_ids(labels), threshold=None).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
