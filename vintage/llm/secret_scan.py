"""Operator 1: secret scans by fixed patterns and a randomness test battery.

Base spans are the leftmost non-overlapping matches of three fixed patterns.
The battery adds tokens that look like uniform random strings. A candidate is
a run of 20 or more token characters, whole and (if it holds "/" or "+") in
pieces between those; "=" ends a token but for padding, so a value is judged without
its name. It has a digit, or is long and of mixed case, and at least ``MIN_BITS``
bits for its inferred encoding, the smallest alphabet that holds it all
(decimal, hex, base 32, lower or upper case with digits, base 62, base 64, URL-safe base 64).
Three tests take "uniform over that alphabet" as the null:

- chi-squared of the character counts, with its exact null mean and variance,
- runs above and below the middle of the alphabet (Wald-Wolfowitz),
- serial correlation of neighbouring characters' places in the alphabet.

The least of their p-values is combined by Sidak's formula, so the p of a random
token is about uniform, while that of an ordinary one is small, the more so the
longer it is. What is reported are tokens with a p above a cut, and false
discoveries are ordinary tokens among them. In each class of length the corpus
itself says how many those are: at high p (the first ``LAMBDA_BIN`` bins, p above 1/2) nearly all tokens are random,
so their number there, over the share of random ones that lies there, estimates the
random ones in all; what lies above a cut beyond
the share of these that should is false. The cut is the lowest whose estimated
false share is at most ``LEVEL``, or whose false tokens are no more than one
standard deviation of that estimate (small classes); it never goes below a stretch
of p that holds more false tokens than random ones, nor below 0.01. Under
28 characters the tests have little power: ordinary tokens reach high p and bias the
estimate, so about one in four reported ones may be false there (see the tests). The estimate works on counts by class and p-value bin (a few hundred
rows whatever the corpus), not on ranked candidates.

Only DataFrame expressions: nothing runs in Python on the executors.

Edge cases: null text is the empty text, with no spans; repeated rows give
repeated rows; texts of any length are read whole; extra columns are kept unless they
clash with the added names (spans, base_spans, n_assign, n_access, n_hex), which then
win in ``scan``, while ``redact`` gives the input's columns back; with no candidate
nothing is added; an empty table gives no rows.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.common import table

#: Fixed values of the contract: kind, pattern, group that is measured, least characters.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The same matches, found without stopping at every short run of hex digits:
#: a run that is too short is never part of a longer match.
FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}

#: Runs of token characters with padding, and their pieces between "/" and "+".
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
PIECE = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}={0,2}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets, smallest first; a token has the first that holds all of it.
ALPHABETS = (
    ("decimal", DIGITS), ("hex_lower", DIGITS + "abcdef"), ("hex_upper", DIGITS + "ABCDEF"), ("base32", UPPER + "234567"),
    ("lower36", DIGITS + LOWER), ("upper36", DIGITS + UPPER), ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
MIN_BITS = 80.0
#: Lower ends of the classes of length.
CLASSES = (20, 28, 40, 64, 128)
#: False share of what is reported, and the p above which ordinary tokens are rare (a bin's edge, 10 ** -0.3).
LEVEL, LAMBDA_BIN = 0.05, 3
#: Tokens of this bin and on (p of 0.01 or less) are never reported: one in a hundred random ones is lost.
MOST_BIN = 20
#: Bins of -log10 p, a tenth each.
BINS = 200

SPAN = "struct<kind:string,start:int,stop:int>"


def _starts(pieces: Column, found: Column) -> Column:
    """Start of each match, from what lies between matches."""
    lens = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        lens, empty, lambda a, x: F.struct((a.at + x.p + x.m).alias("at"), F.concat(a.starts, F.array(a.at + x.p)).alias("starts")), lambda a: a.starts
    )


def matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has at
    least ``least`` characters; null where there is no match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    starts = _starts(F.split(text, pattern, -1), found)
    spans = F.zip_with(
        F.zip_with(starts, found, lambda s, m: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).alias("stop"))),
        measured, lambda s, n: F.when(n >= least, s),
    )
    return F.when(text.rlike(pattern), F.filter(spans, lambda s: s.isNotNull()))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tail(z: Column) -> Column:
    """P(N(0,1) > z), by a fixed five-term approximation (error below 1e-7),
    kept above 1e-20."""

    def upper(z: Column) -> Column:
        a = F.abs(z)
        poly = _let(1 / (1 + 0.2316419 * a), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        above = F.exp(-a * a / 2) * 0.3989422804014327 * poly
        return F.greatest(F.when(z >= 0, above).otherwise(1 - above), F.lit(1e-20))

    return _let(z, upper)


def _alphabet(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for _, letters in reversed(ALPHABETS):
        out = F.when(token.rlike("^[" + letters.replace("-", r"\-") + "]+$"), F.lit(letters)).otherwise(out)
    return out


def p_value(token: Column) -> Column:
    """Combined p-value of "uniform over the inferred alphabet"; null where no
    alphabet holds the token or it has under MIN_BITS bits. Padding is ignored."""

    def of(x: Column) -> Column:
        n, k = F.length(x.core).cast("double"), F.length(x.letters).cast("double")
        return F.when(x.letters.isNotNull() & (n >= CLASSES[0]) & (n * F.log2(k) >= MIN_BITS), _combined(x.core, x.letters, n, k))

    named = lambda core: F.struct(core.alias("core"), _alphabet(core).alias("letters"))
    return _let(_let(F.rtrim(token, F.lit("=")), named), of)


def _combined(core: Column, letters: Column, n: Column, k: Column) -> Column:
    places = F.transform(F.split(core, ""), lambda c: F.instr(letters, c).cast("double"))
    squares = F.aggregate(
        F.split(letters, ""), F.lit(0.0),
        lambda a, c: a + F.pow((n - F.length(F.replace(core, c, F.lit("")))).cast("double"), 2),
    )
    z_chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))

    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(x) for x in ("s", "ss", "lag", "high", "turns")], F.lit(-1.0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        above = F.when(x > k / 2, 1.0).otherwise(0.0)
        before = F.when(a["last"] > k / 2, 1.0).otherwise(0.0)
        follows = a["last"] > 0
        return F.struct(
            (a.s + x).alias("s"), (a.ss + x * x).alias("ss"), (a.lag + F.when(follows, x * a["last"]).otherwise(0.0)).alias("lag"),
            (a.high + above).alias("high"), (a.turns + F.when(follows & (above != before), 1.0).otherwise(0.0)).alias("turns"), x.alias("last"),
        )

    def finish(a: Column) -> Column:
        both = 2 * a.high * (n - a.high)
        z_runs = _let(both * (both - n) / (n * n * (n - 1)), lambda v: F.when(v > 0, F.abs(a.turns - both / n) / F.sqrt(v)).otherwise(F.lit(9.0)))
        mean, var = (k + 1) / 2, (k * k - 1) / 12
        first, final = F.instr(letters, F.left(core, F.lit(1))).cast("double"), F.instr(letters, F.right(core, F.lit(1))).cast("double")
        cov = a.lag - mean * (2 * a.s - first - final) + (n - 1) * mean * mean
        z_lag = F.abs(cov) / (var * F.sqrt(n - 1))
        least = F.least(_tail(z_chi), F.least(F.lit(1.0), 2 * _tail(z_runs)), F.least(F.lit(1.0), 2 * _tail(z_lag)))
        return _let(least, lambda m: m * (3 - 3 * m + m * m))  # 1 - (1 - m) ** 3

    return F.aggregate(places, start, step, finish)


def _tested(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Array of struct(start, stop, size, p) of the matches that have a p-value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    starts = _starts(F.split(text, pattern, -1), found)

    def suspect(x: Column) -> Column:
        mixed = x.token.rlike("[a-z]") & x.token.rlike("[A-Z]") & (F.length(x.token) >= 32)
        wanted = x.token.rlike("[0-9]") | mixed
        return wanted & x.token.rlike("[+/]") if keep is not None else wanted

    tested = F.transform(
        F.filter(F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("stop"), m.alias("token"))), suspect),
        lambda x: F.struct(x.start.alias("start"), x.stop.alias("stop"), F.length(F.rtrim(x.token, F.lit("="))).alias("size"), p_value(x.token).alias("p")),
    )
    return F.filter(tested, lambda x: x.p.isNotNull())


def candidates(text: Column) -> Column:
    """Array of struct(start, stop, size, p) of the tokens that the battery
    tests: pieces, and whole runs with "/" or "+"; null where there is none."""
    runs = F.when(text.rlike(r"[A-Za-z0-9_-][+/]|[+/][A-Za-z0-9_-]") & text.rlike(TOKEN), _tested(text, TOKEN, F.lit(True)))
    pieces = F.when(text.rlike(PIECE), _tested(text, PIECE))
    return F.when(text.rlike(TOKEN), F.concat(F.coalesce(runs, _none()), F.coalesce(pieces, _none())))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,stop:int,size:int,p:double>>")


def _class(size: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES):
        out = F.when(size >= least, F.lit(i)).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(p)), F.lit(BINS)).cast("int")


def cut_offs(df: DataFrame, text: str = "text", level: float = LEVEL) -> dict[int, int]:
    """For each class of length, the least bin of -log10 p that is not reported."""
    c = df.select(F.explode(candidates(F.col(text))).alias("c"))
    counts = c.select(_class(F.col("c.size")).alias("class"), _bin(F.col("c.p")).alias("bin")).groupBy("class", "bin").count()
    by_class: dict[int, dict[int, int]] = {}
    for r in counts.collect():  # at most len(CLASSES) * (BINS + 1) rows
        by_class.setdefault(r["class"], {})[r["bin"]] = r["count"]
    return {k: cut_off(bins, level) for k, bins in by_class.items()}


def cut_off(bins: dict[int, int], level: float) -> int:
    """The greatest bin up to which the false share is small enough, from
    counts by bin. The false ones are an estimate from the bins below LAMBDA_BIN."""
    above = 1 - 10 ** (-LAMBDA_BIN / 10)  # share of random tokens in those bins
    n = sum(bins.get(b, 0) for b in range(LAMBDA_BIN))
    random, slack = (n + 1) / above, math.sqrt((n + 1) * (1 - above)) / above
    best, seen = 0, 0
    for b in range(MOST_BIN):
        seen += bins.get(b, 0)
        # where half of the next five bins are false, and not by chance, nothing more is taken
        here, random_here = sum(bins.get(x, 0) for x in range(b, b + 5)), random * (10 ** (-b / 10) - 10 ** (-(b + 5) / 10))
        if here - random_here > max(here / 2, math.sqrt(random_here) + 1):
            break
        false = seen - random * (1 - 10 ** (-(b + 1) / 10))
        if false <= max(level * seen, slack):
            best = b + 1
    return best


def scan(df: DataFrame, text: str = "text", level: float = LEVEL) -> DataFrame:
    """``df`` with base_spans and spans (arrays of kind, start, stop) and the
    counts n_assign, n_access, n_hex. Added spans have kind ``random``."""
    cuts = cut_offs(df, text, level)
    df = df.drop("spans", "base_spans", "n_assign", "n_access", "n_hex", "_added", *[f"_{k}" for k, *_ in BASE])
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    for kind, pattern, group, least in BASE:
        df = df.withColumn(f"_{kind}", F.coalesce(matches(t, FAST.get(kind, pattern), kind, group, least), none))

    def is_ordinary(c: Column) -> Column:
        out = F.lit(False)
        for k, b in cuts.items():
            out = out | ((_class(c.size) == k) & (_bin(c.p) >= b))
        return out

    df = df.withColumn("_added", F.coalesce(F.filter(candidates(t), lambda c: ~is_ordinary(c)), _none()))
    rank = {k: i for i, (k, *_) in enumerate(BASE)} | {"random": len(BASE)}

    def ordered(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[s.kind].alias("rank"), s.stop.alias("stop"), s.kind.alias("kind")))
        return F.transform(F.sort_array(keyed), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop")))

    df = df.withColumn("base_spans", ordered(F.concat("_assign", "_access", "_hex")))
    inside = lambda c, s: (s.start <= c.start) & (c.stop <= s.stop)
    new = F.filter("_added", lambda c: ~F.exists("base_spans", lambda s: inside(c, s)) & ~F.exists("_added", lambda s: inside(c, s) & (s.stop - s.start > c.stop - c.start)))
    new = F.transform(new, lambda c: F.struct(F.lit("random").alias("kind"), c.start.alias("start"), c.stop.alias("stop")))
    return df.withColumns({
        "spans": F.when(F.size("_added") == 0, F.col("base_spans")).otherwise(ordered(F.concat(F.col("base_spans"), new))),
        **{f"n_{k}": F.size(f"_{k}").cast("long") for k, *_ in BASE},
    }).drop("_assign", "_access", "_hex", "_added")


def as_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", level: float = LEVEL) -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``mark``; overlapping
    spans are replaced together. All rows stay; null text stays null."""
    own = [F.col(c) for c in df.columns]  # under one name, as scan adds columns of its own
    found = scan(df.select(F.struct(*own).alias("_row"), F.col(text).alias(text)), text, level)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), a.at + 1, s.start - a.at)
        return F.when(
            s.start >= a.at, F.struct(s.stop.alias("at"), F.concat(a.out, gap, F.lit(mark)).alias("out"))
        ).otherwise(F.struct(F.greatest(a.at, s.stop).alias("at"), a.out.alias("out")))

    done = F.aggregate("spans", first, step, lambda a: F.concat(a.out, F.substring(F.col(text), a.at + 1, F.length(text))))
    clean = F.when(F.size("spans") > 0, done).otherwise(F.col(text))
    return found.select(*[clean.alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(as_text("base_spans").cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"),
    )
