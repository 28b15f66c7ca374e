"""Operator 2: a quality classifier as a sparse ensemble of rules.

1. ``statistics`` takes one pass over whole texts and gives each document
   twenty numbers (shares of byte classes, word and line repetition, lengths).
2. ``fit`` boosts small trees on a sample of labelled documents of documented
   size (``max_rows``, least hash of the id), turns each path of a tree into a
   conjunction of thresholds, and fits lasso logistic weights over the rules.
3. ``compile_score`` writes the surviving rules as one Column expression, so
   that scoring is a projection over the statistics.

Edge cases: null text is the empty text and is scored as such; labels that are
null or not 0/1 are not learned from; several labels of one id count by their
mean (1 from a half on); with no labels every score is 0.5, with one class only it
is that class's smoothed share; a null id is kept as such, scored, and not
learned from; texts of any length are read whole; repeated rows give repeated
rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.common import exact, id_bucket, materialize, table

STATS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digit", "symbol", "exclaim", "bar", "stop", "comma",
    "high", "distinct_words", "top_word", "same_as_last", "repeat_pairs", "lines", "repeat_lines", "line_bytes", "bare_words",
)
CUT_OFF = 0.7


def statistics_of(text: str | None) -> list[float]:
    """The STATS of one text."""
    data = (text or "").encode()
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, high = int(count[65:91].sum()), int(count[97:123].sum()), int(count[128:].sum())
    upper += sum(map(str.isupper, text)) - upper if high else 0
    words = data.split()
    w = max(1, len(words))
    seen = Counter(words)
    pairs = list(zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / w, math.log1p(max(map(len, words), default=0)),
        upper / max(1, upper + lower + high / 2), int(count[48:58].sum()) / n,
        sum(int(count[c]) for c in b"#*$%&<>") / n, int(count[33]) / n, int(count[124]) / n, int(count[46]) / n, int(count[44]) / n,
        high / n, len(seen) / w, max(seen.values(), default=0) / w, sum(a == b for a, b in pairs) / w,
        1 - len(set(pairs)) / max(1, len(pairs)), math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(len(data) / max(1, len(lines))), sum(map(bytes.isalpha, words)) / w,
    ]


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the STATS of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([statistics_of(t) for t in b[text]], columns=list(STATS), dtype=float)
            out.insert(0, key, b[key].array)
            yield out

    src, kind, back = exact(df.select(F.col(key), F.col(text)), [key])
    return back(src.mapInPandas(run, kind + ", " + ", ".join(f"{s} double" for s in STATS)))


# ------------------------------------------------------------------ trees
#: A rule: (statistic, at most, threshold) for each condition.
Rule = tuple[tuple[int, bool, float], ...]


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds between quantiles of each statistic."""
    out = []
    for col in x.T:
        q = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def _grow(x: np.ndarray, codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray, rate: float) -> None:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best, at = 1e-6, None
    if depth and len(rows) >= 20:
        for j, e in enumerate(edges):
            if not len(e):
                continue
            lg = np.bincount(codes[rows, j], g[rows], len(e) + 1).cumsum()[:-1]
            lh = np.bincount(codes[rows, j], h[rows], len(e) + 1).cumsum()[:-1]
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], (j, k)
    if at is None:
        out[rows] += rate * -total_g / (total_h + 1)
        return
    j, k = at
    low = codes[rows, j] <= k
    for side, take in ((True, low), (False, ~low)):
        longer = (*path, (j, side, float(edges[j][k])))
        rules.append(longer)
        _grow(x, codes, edges, g, h, rows[take], depth - 1, longer, rules, out, rate)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 48) -> list[Rule]:
    """Every path of boosted logistic trees, without repeats."""
    edges = _edges(x, bins)
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    z, rules = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        _grow(x, codes, edges, p - y, p * (1 - p), np.arange(len(y)), depth, (), rules, z, rate)
    return list(dict.fromkeys(rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, t in rule:
        out &= (x[:, j] <= t) if low else (x[:, j] > t)
    return out


def lasso(b: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty on all but the intercept, by
    accelerated proximal gradients."""
    a = np.concatenate([np.ones((len(b), 1)), b], axis=1)
    rate = 4 * len(y) / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        u = v - rate * a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / len(y)
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - rate * penalty, 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / s * (u - w), u, s
    return float(w[0]), w[1:]


@dataclass
class Ensemble:
    """intercept + sum of weights of the rules that hold, through a logistic."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))


def fit_arrays(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> Ensemble:
    if not len(y):
        return Ensemble(0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return Ensemble(math.log(share / (1 - share)))
    rules = tree_rules(x, y)
    b = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    first, weights = lasso(b, y, penalty)
    return Ensemble(first, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def fit(stats: DataFrame, labels: DataFrame, where: Column, key: str = "doc_id", label: str = "quality", max_rows: int = 20_000) -> Ensemble:
    """An ensemble from at most ``max_rows`` labelled ids for which ``where``
    holds; only their statistics come to the driver."""
    known = labels.where(where & F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64(F.col(key), F.lit(3)), key).limit(max_rows)
    found = stats.join(F.broadcast(known), key).select("_y", *STATS, F.xxhash64(F.col(key), F.lit(3)).alias("_spot")).dropna()
    # ids that repeat are bounded too, by least hash, so that the same rows are learned from in every run
    rows = found.orderBy("_spot", "_y", *STATS).limit(2 * max_rows).drop("_spot").toPandas()
    rows = rows.sort_values(list(rows.columns))
    return fit_arrays(rows[list(STATS)].to_numpy(float), rows["_y"].to_numpy(float))


def compile_score(model: Ensemble) -> Column:
    """The ensemble as a Column over the statistics."""
    z = F.lit(model.intercept)
    for rule, weight in model.rules:
        cond = F.lit(True)
        for j, low, t in rule:
            cond = cond & ((F.col(STATS[j]) <= t) if low else (F.col(STATS[j]) > t))
        z = z + F.when(cond, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(statistics(table(spark, sf_dir, "documents")), "statistics")
    model = fit(stats, table(spark, sf_dir, "labels"), id_bucket("doc_id", 4) != 2)
    score = compile_score(model)
    return stats.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= CUT_OFF, 1).otherwise(0)
    )
