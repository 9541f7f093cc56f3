"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All nodes of all trees: a leaf is its own child. ``roots`` has each tree's first node."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row; every row walks all trees at once."""
        out = np.full(len(x), self.base)
        if not len(self.roots) or not len(x):
            return out
        step = max(1, 2_000_000 // len(self.roots))
        for a in range(0, len(x), step):
            part = x[a : a + step]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[a : a + step] += self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def _leaf(gradient: float, hessian: float, reg: float, low: float, high: float) -> float:
    return float(np.clip(-gradient / (hessian + reg), low, high))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 64, reg: float = 1.0, least: float = 0.005) -> Forest:
    """Logistic boosting on histograms. ``monotone[f]`` is 1 where the margin may only
    rise with feature f, -1 where it may only fall, else 0. A leaf has at least a share
    ``least`` of the hessian that all rows begin with, so a rare class can be split off at
    any number of rows. With no rows or one class the forest is a constant."""
    n, m = x.shape
    share = float(y.mean()) if n else 0.5
    base = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if n and 0 < share < 1:
        least, reg = least * n * share * (1 - share), reg * min(1.0, n * share * (1 - share) / 100)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
        coded = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(m)], axis=1)
        flat = coded + np.arange(m) * bins
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(len(value))
            # each open node: its rows, bounds of its value, its place in the arrays
            level = [(np.arange(n), -np.inf, np.inf, _new(feature, threshold, left, right, value))]
            leaves = []
            for d in range(depth + 1):
                following = []
                for rows, low, high, at in level:
                    split = _best(flat[rows], g[rows], h[rows], edges, monotone, bins, reg, least, low, high) if d < depth else None
                    if split is None:
                        value[at] = rate * _leaf(g[rows].sum(), h[rows].sum(), reg, low, high)
                        leaves.append((rows, value[at]))
                        continue
                    f, b, wl, wr = split
                    goes = coded[rows, f] <= b
                    a, c = (_new(feature, threshold, left, right, value) for _ in range(2))
                    feature[at], threshold[at], left[at], right[at] = f, float(edges[f][b]), a, c
                    middle = (wl + wr) / 2
                    bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(monotone[f]), ((low, high),) * 2)
                    following += [(rows[goes], *bounds[0], a), (rows[~goes], *bounds[1], c)]
                level = following
            for rows, v in leaves:
                margin[rows] += v
    return Forest(base, np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float), depth)


def _new(feature: list, threshold: list, left: list, right: list, value: list) -> int:
    at = len(value)
    feature.append(0)
    threshold.append(np.inf)
    left.append(at)
    right.append(at)
    value.append(0.0)
    return at


def _best(flat, g, h, edges, monotone, bins, reg, least, low, high):
    """The split of most gain that keeps the constraints, or None."""
    m = flat.shape[1]
    sums = [np.bincount(flat.ravel(), weights=np.repeat(w, m), minlength=m * bins).reshape(m, bins).cumsum(axis=1) for w in (g, h)]
    gl, hl = sums[0][:, :-1], sums[1][:, :-1]
    gt, ht = g.sum(), h.sum()
    gr, hr = gt - gl, ht - hl
    wl, wr = np.clip(-gl / (hl + reg), low, high), np.clip(-gr / (hr + reg), low, high)
    score = lambda w, a, b: -(a * w + 0.5 * (b + reg) * w * w)
    gain = score(wl, gl, hl) + score(wr, gr, hr) - score(np.clip(-gt / (ht + reg), low, high), gt, ht)
    cuts = np.array([len(e) for e in edges])
    gain[np.arange(bins - 1)[None, :] >= cuts[:, None]] = -np.inf
    gain[(hl < least) | (hr < least)] = -np.inf
    gain[monotone[:, None] * (wr - wl) < 0] = -np.inf
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(f), int(b), float(wl[f, b]), float(wr[f, b])) if gain[f, b] > 1e-6 else None
