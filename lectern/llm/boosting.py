"""Small gradient-boosted trees for dense features, and isotonic calibration (numpy)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of complete trees of ``depth`` over quantile bins; a row goes right if its value is above a node's cut."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.15, bins: int = 32, penalty: float = 1.0, least: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.penalty, self.least = depth, rounds, rate, bins, penalty, least
        self.feature = self.cut = self.leaf = None
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.rounds, inner), dtype=np.int64)
        self.cut = np.full((self.rounds, inner), np.inf)
        self.leaf = np.zeros((self.rounds, inner + 1))
        if not n:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        # Zero against the rest matters for rates that are mostly zero.
        cuts = [np.unique(np.append(c, 0.0)) for c in cuts]
        width = max(len(c) for c in cuts) + 1
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        flat = binned + np.arange(d) * width
        margin = np.full(n, self.start)
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                at = ((node - first)[:, None] * (d * width) + flat).ravel()
                shape = (count, d, width)
                gs = np.bincount(at, np.repeat(g, d), count * d * width).reshape(shape).cumsum(2)
                hs = np.bincount(at, np.repeat(h, d), count * d * width).reshape(shape).cumsum(2)
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(hs < self.least * 1e-2) | (ht - hs < self.least * 1e-2)] = -1
                best = gain.reshape(count, -1).argmax(1)
                for k in range(count):
                    j, b = divmod(int(best[k]), width)
                    if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                        self.feature[t, first + k], self.cut[t, first + k] = j, cuts[j][b]
                right = x[np.arange(n), self.feature[t, node]] > self.cut[t, node]
                node = 2 * node + 1 + right
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            self.leaf[t] = self.rate * gs / (hs + self.penalty)
            margin += self.leaf[t, leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """Non-decreasing step fit by pooling adjacent violators, read between the blocks' middles."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # sum of y, weight, sum of x
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([b, 1.0, a])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
        self.x = np.array([s / w for _, w, s in blocks] or [0.0])
        self.y = np.array([s / w for s, w, _ in blocks] or [0.5])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
