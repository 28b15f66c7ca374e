"""Operator 7's network against a plain convolution and numeric gradients."""

import math

import numpy as np

from vintage.llm import byte_cnn as B


def plain_probabilities(net, window):
    """One window by loops over positions, filters and widths."""
    tops = []
    for w, f, b in zip(B.WIDTHS, net.filters, net.bias):
        for k in range(B.FILTERS):
            best = -math.inf
            for at in range(B.SPAN):
                best = max(best, sum(float(net.vectors[window[at + j], d]) * float(f[j * B.VECTOR + d, k]) for j in range(w) for d in range(B.VECTOR)))
            tops.append(max(best + float(b[k]), 0.0))
    z = [sum(t * float(net.out[i, c]) for i, t in enumerate(tops)) + float(net.out_bias[c]) for c in range(len(net.labels))]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def made(epochs):
    rng = np.random.default_rng(1)
    windows = rng.integers(97, 110, (6, B.WINDOW)).astype(np.uint8)
    return windows, ["a", "b", "c", "a", "b", "c"], B.train(windows, ["a", "b", "c", "a", "b", "c"], epochs=epochs, batch=6)


def test_forward_pass_equals_a_plain_convolution():
    windows, _, net = made(3)
    got = net.probabilities(windows[:2])
    for row, window in zip(got, windows[:2]):
        assert np.allclose(row, plain_probabilities(net, window), atol=1e-5)
    tops, _ = net.features(windows[:2])
    z = tops @ net.out + net.out_bias
    e = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(got, e / e.sum(axis=1, keepdims=True), atol=1e-6)


def test_gradients_equal_differences():
    """The first Adam step moves each weight against the sign of its gradient; that sign is the loss's own slope."""
    windows, labels, before = made(0)
    _, _, after = made(1)
    want = [before.labels.index(v) for v in labels]
    flat = lambda n: [n.vectors, *n.filters, *n.bias, n.out, n.out_bias]
    before.vectors, before.out, before.out_bias = before.vectors.astype(float), before.out.astype(float), before.out_bias.astype(float)
    before.filters, before.bias = [f.astype(float) for f in before.filters], [b.astype(float) for b in before.bias]
    loss = lambda: -np.log(before.probabilities(windows)[np.arange(6), want]).mean()
    rng, seen = np.random.default_rng(2), 0
    for p, q in zip(flat(before), flat(after)):
        for _ in range(25):
            at = tuple(rng.integers(s) for s in p.shape)
            moved, old = q[at] - p[at], p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            slope, p[at] = (up - loss()) / 2e-5, old
            if abs(slope) > 1e-4:
                seen += 1
                assert np.sign(moved) == -np.sign(slope), (at, moved, slope)
            elif abs(slope) == 0:
                assert abs(moved) < 1e-6
    assert seen > 40
