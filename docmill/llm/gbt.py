"""Gradient-boosted trees for two classes and isotonic calibration, on bounded samples in numpy."""

from __future__ import annotations

import numpy as np

BINS = 48


class Trees:
    """Complete binary trees of one depth; a row's score is the sum of its leaves' values."""

    def __init__(self, base: float, features: list[np.ndarray], cuts: list[np.ndarray], leaves: list[np.ndarray]):
        self.base, self.features, self.cuts, self.leaves = base, features, cuts, leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over histograms of quantile bins; ties take the first feature and cut."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not len(y):
        return Trees(0.0, [], [], [])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    n_bins = BINS + 1
    raw = np.full(len(y), base)
    out = Trees(base, [], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        inner = 2**depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                best = 1e-9
                for f in range(x.shape[1] if len(at) else 0):
                    gs = np.bincount(binned[at, f], g[at], n_bins).cumsum()
                    hs = np.bincount(binned[at, f], h[at], n_bins).cumsum()
                    gain = gs**2 / (hs + ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                    gain = gain[: len(edges[f])]
                    if len(gain) and gain.max() > best:
                        best, feature[k], cut[k] = float(gain.max()), f, edges[f][int(gain.argmax())]
                node[at] = 2 * k + 1 + (x[at, feature[k]] > cut[k])
        leaf = np.zeros(2**depth)
        where = node - inner
        leaf -= rate * np.bincount(where, g, 2**depth) / (np.bincount(where, h, 2**depth) + ridge)
        raw += leaf[where]
        out.features.append(feature)
        out.cuts.append(cut)
        out.leaves.append(leaf)
    return out


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of the best non-decreasing weighted fit of ``y`` to ``score``."""
    order = np.argsort(score, kind="stable")
    points, at = np.unique(score[order], return_index=True)
    sums = np.add.reduceat((np.asarray(y, float) * weight)[order], at) if len(at) else np.zeros(0)
    counts = np.add.reduceat(weight[order], at) if len(at) else np.zeros(0)
    blocks: list[list[float]] = []  # sum, count, first, last point
    for k in range(len(points)):
        blocks.append([sums[k], counts[k], points[k], points[k]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, c, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = last
    xs = [v for b in blocks for v in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    ys = [b[0] / b[1] for b in blocks for _ in range(2 if b[2] < b[3] else 1)]
    return np.array(xs), np.array(ys)
