"""Small gradient-boosted trees on integer features, trained on the driver and written out as a DataFrame expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int) -> tuple[float, int, float]:
    """(gain, feature, threshold) of the best split by x[:, feature] <= threshold."""
    best = (0.0, -1, 0.0)
    total = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] != v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if not len(cut):
            continue
        gain = gs[cut] ** 2 / (hs[cut] + 1.0) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1.0) - total
        i = int(np.argmax(gain))
        if gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), f, float(v[cut[i]] + v[cut[i] + 1]) / 2)
    return best


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int):
    gain, f, t = _best_split(x, g, h, least) if depth else (0.0, -1, 0.0)
    if f < 0 or gain <= 1e-6:
        return round(float(-rate * g.sum() / (h.sum() + 1.0)), 9)
    left = x[:, f] <= t
    return f, t, _grow(x[left], g[left], h[left], depth - 1, rate, least), _grow(x[~left], g[~left], h[~left], depth - 1, rate, least)


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    def one(node, rows: np.ndarray, out: np.ndarray) -> None:
        if isinstance(node, float):
            out[rows] += node
            return
        f, t, low, high = node
        left = x[rows, f] <= t
        one(low, rows[left], out)
        one(high, rows[~left], out)

    out = np.zeros(len(x))
    for tree in trees:
        one(tree, np.arange(len(x)), out)
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 5) -> list:
    """Trees for the logistic loss; the sum of their leaves is the log odds."""
    trees: list = []
    margin = np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grow(x, p - y, p * (1 - p), depth, rate, least))
        margin += predict(trees[-1:], x)
    return trees


def threshold(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut of held-out margins at which, and above which, precision is reached."""
    order = np.argsort(-margin, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(margin[order][1:] != margin[order][:-1], True)
    ok = np.flatnonzero((good >= precision) & last)
    return float(margin[order][ok[-1]]) if len(ok) else float("inf")


def as_column(trees: list, features: list[Column]) -> Column:
    def one(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        f, t, low, high = node
        return F.when(features[f] <= F.lit(t), one(low)).otherwise(one(high))

    out = F.lit(0.0)
    for tree in trees:
        out = out + one(tree)
    return out
