"""A small random forest: bagged classification trees over numeric features."""

from __future__ import annotations

import numpy as np


class Forest:
    """Trees as flat arrays; the score of a row is the mean leaf share of class 1."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 7):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            self.nodes.append(self._grow(x[rows], y[rows].astype(float), rng))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, kids, share = [], [], [], []
        todo = [(np.arange(len(y)), 0, -1)]
        while todo:
            rows, depth, slot = todo.pop()
            if slot >= 0:
                kids[slot // 2][slot % 2] = len(share)
            feature.append(-1)
            cut.append(0.0)
            kids.append([0, 0])
            share.append(y[rows].mean())
            if depth == self.depth or len(rows) < 2 * self.least or share[-1] in (0.0, 1.0):
                continue
            best = self._split(x[rows], y[rows], rng)
            if best is None:
                continue
            f, c = best
            feature[-1], cut[-1] = f, c
            left, here = x[rows, f] <= c, len(share) - 1
            todo += [(rows[~left], depth + 1, 2 * here + 1), (rows[left], depth + 1, 2 * here)]
        return np.asarray(feature), np.asarray(cut), np.asarray(kids), np.asarray(share)

    def _split(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[int, float] | None:
        best, found = 0.0, None
        n, total = len(y), y.sum()
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (k >= self.least) & (n - k >= self.least)
            if not ok.any():
                continue
            a, b = ones[:-1], total - ones[:-1]
            gain = a * a / k + (k - a) ** 2 / k + b * b / (n - k) + (n - k - b) ** 2 / (n - k) - (total**2 + (n - total) ** 2) / n
            i = int(np.argmax(np.where(ok, gain, -1)))
            if gain[i] > best + 1e-12:
                best, found = gain[i], (int(f), float((v[i] + v[i + 1]) / 2))
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, kids, share in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(f >= 0, kids[at, right.astype(int)], at)
            out += share[at]
        return out / max(1, len(self.nodes))
