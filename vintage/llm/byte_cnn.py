"""Operator 7: language identification by a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes that overlap by the longest
filter less one, over its whole length. Byte vectors go through filters of
several widths, the maximum over the window and a softmax; a document's score
is the mean of its windows' probabilities, weighted by the bytes they cover.

Trained in numpy on a sample of labelled rows of documented size
(``max_rows`` rows, spread evenly over the labels and taken by least hash, and
``per_row`` windows of each); applied to every window of every row.

Edge cases: null text, an empty text or one without a letter is ``und`` with
score 0; with no labelled row everything is ``und``; with one language only, that
language has score 1; rows with a null label are not learned from; a null id is
kept as such, predicted, and not learned from; texts of any length are read
whole; repeated rows give repeated rows; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.common import exact, id_bucket, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
VECTOR = 8
STEP = WINDOW - max(WIDTHS) + 1
SPAN = WINDOW - max(WIDTHS) + 1  # positions of every filter in a window


@dataclass
class Net:
    labels: list[str]
    vectors: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter and where; windows: n x WINDOW bytes."""
        x = self.vectors[windows]  # n, WINDOW, VECTOR
        tops, at = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            cols = np.concatenate([x[:, j : j + SPAN] for j in range(w)], axis=2)
            y = cols.reshape(-1, w * VECTOR) @ f
            y = y.reshape(len(windows), SPAN, FILTERS)
            at.append(y.argmax(axis=1))
            tops.append(np.maximum(np.take_along_axis(y, at[-1][:, None], 1)[:, 0] + b, 0))
        return np.concatenate(tops, axis=1), at

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each two bytes add to the responses: at the first two places of
        all filters (65536 x all), and at the two that follow of the wider ones,
        where a width of 3 has one of them (65536 x all but the first width's)."""
        one = [[self.vectors @ f[j * VECTOR : (j + 1) * VECTOR] for j in range(w)] for w, f in zip(WIDTHS, self.filters)]
        head = np.concatenate([t[0][:, None] + t[1][None, :] for t in one], axis=2)
        tail = np.concatenate([t[2][:, None] + (t[3][None, :] if len(t) > 3 else np.zeros((1, 256, 1), t[2].dtype)) for t in one[1:]], axis=2)
        return head.reshape(1 << 16, -1), tail.reshape(1 << 16, -1)

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None, at_once: int = 16) -> np.ndarray:
        """Softmax of each window; responses are sums of two rows of the pair
        tables, for a few windows at a time, so that they stay in the cache."""
        head, tail = tables or self.pair_tables()
        pairs = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
        tops = np.empty((len(windows), head.shape[1]), head.dtype)
        y = np.empty((at_once, SPAN, head.shape[1]), head.dtype)
        more = np.empty((at_once, SPAN, tail.shape[1]), tail.dtype)
        for s in range(0, len(windows), at_once):
            some = pairs[s : s + at_once]
            n = len(some)
            np.take(head, some[:, :SPAN], axis=0, out=y[:n], mode="clip")
            np.take(tail, some[:, 2 : 2 + SPAN], axis=0, out=more[:n], mode="clip")
            y[:n, :, FILTERS:] += more[:n]
            y[:n].max(axis=1, out=tops[s : s + n])
        tops = np.maximum(tops + np.concatenate(self.bias), 0)
        z = tops @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows over the whole of ``data``, the last padded with zero bytes,
    and the bytes that each adds."""
    n = max(1, -(-max(len(data) - (WINDOW - STEP), 1) // STEP))
    padded = np.zeros(n * STEP + WINDOW - STEP, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
    sizes = np.minimum(len(data) - STEP * np.arange(n), WINDOW)
    return windows, np.maximum(sizes, 1)


def train(windows: np.ndarray, labels: list[str], epochs: int = 4, batch: int = 32, rate: float = 0.004, seed: int = 7) -> Net:
    """Adam on the cross-entropy; gradients reach a filter only where its
    response was largest."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    n_out = FILTERS * len(WIDTHS)
    net = Net(
        names, rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * VECTOR), (w * VECTOR, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (n_out, len(names))).astype(np.float32), np.zeros(len(names), np.float32),
    )
    params = [net.vectors, *net.filters, *net.bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), batch):
            pick = order[s : s + batch]
            win, want = windows[pick], y[pick]
            tops, at = net.features(win)
            z = tops @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), want] -= 1
            p /= len(pick)
            g_top = (p @ net.out.T) * (tops > 0)
            grads = [np.zeros_like(net.vectors), *[np.zeros_like(f) for f in net.filters], *[np.zeros_like(b) for b in net.bias], tops.T @ p, p.sum(axis=0)]
            rows = np.arange(len(pick))[:, None]
            for k, w in enumerate(WIDTHS):
                g = g_top[:, k * FILTERS : (k + 1) * FILTERS]
                seen = np.stack([win[rows, at[k] + j] for j in range(w)], axis=2)  # n, FILTERS, w bytes
                x = net.vectors[seen].reshape(len(pick), FILTERS, w * VECTOR)
                grads[1 + k] += np.einsum("nfd,nf->df", x, g)
                grads[1 + len(WIDTHS) + k] += g.sum(axis=0)
                back = np.einsum("df,nf->nfd", net.filters[k], g).reshape(len(pick), FILTERS, w, VECTOR)
                np.add.at(grads[0], seen.ravel(), back.reshape(-1, VECTOR))
            t += 1
            for i, (q, g) in enumerate(zip(params, grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                q -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def sample(df: DataFrame, key: str, text: str, label: str, where: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows: as many of each label as there are,
    up to an equal share, by least hash of the key."""
    known = df.where(where & F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}  # one row for each language
    if not counts:
        return known.select(label, text).limit(0)
    share = max(1, max_rows // len(counts))
    scale = 1 << 30
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, int(1.3 * scale * share / n) + 1))])
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(scale))
    return known.where(spot < rate[F.col(label)]).orderBy(spot, key).limit(max_rows).select(label, text)


def fit(df: DataFrame, where: Column, key: str = "doc_id", text: str = "text", label: str = "lang", max_rows: int = 2400, per_row: int = 2) -> Net | None:
    """A network from the labelled rows for which ``where`` holds."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for name, t in zip(b[label], b[text]):
                if has_letter(t):
                    all_windows = cut(t.encode())[0]
                    for i in sorted({(len(all_windows) - 1) * k // max(1, per_row - 1) for k in range(per_row)}):
                        got.append((str(name), all_windows[i].tobytes()))
            yield pd.DataFrame(got, columns=["label", "window"])

    rows = sample(df, key, text, label, where, max_rows).mapInPandas(pick, "label string, window binary").collect()
    rows.sort()
    if not rows:
        return None
    return train(np.stack([np.frombuffer(r.window, np.uint8) for r in rows]), [r.label for r in rows])


def predict(df: DataFrame, net: Net | None, key: str = "doc_id", text: str = "text", at_once: int = 1024) -> DataFrame:
    """key, lang_pred, score of every row, from every window of its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = net.pair_tables() if net else None
        for b in batches:
            names, scores = ["und"] * len(b), np.zeros(len(b))
            sums = np.zeros((len(b), len(net.labels) if net else 0))
            held: list[np.ndarray] = []
            owner: list[np.ndarray] = []
            size: list[np.ndarray] = []
            waiting = 0

            def flush() -> None:
                win, who, weigh = np.concatenate(held), np.concatenate(owner), np.concatenate(size)
                for s in range(0, len(win), at_once):
                    p = net.probabilities(win[s : s + at_once], tables)
                    np.add.at(sums, who[s : s + at_once], p * weigh[s : s + at_once, None])

            for i, t in enumerate(b[text]):
                if net is None or not has_letter(t):
                    continue
                win, n = cut(t.encode())
                names[i] = ""
                held.append(win)
                owner.append(np.full(len(win), i))
                size.append(n)
                waiting += len(win)
                if waiting >= at_once:
                    flush()
                    held, owner, size, waiting = [], [], [], 0
            if held:
                flush()
            for i in np.flatnonzero([n == "" for n in names]):
                p = sums[i] / sums[i].sum()
                names[i], scores[i] = net.labels[int(p.argmax())], min(1.0, float(p.max()))
            yield pd.DataFrame({key: b[key].array, "lang_pred": names, "score": scores})

    src, kind, back = exact(df.select(F.col(key), F.col(text)), [key])
    return back(src.mapInPandas(run, kind + ", lang_pred string, score double"))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs, id_bucket("doc_id", 3) != 1)
    return predict(docs, net).select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
