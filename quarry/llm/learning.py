"""Small learners over bounded samples, in numpy: additive models with pairs, boosted trees, isotonic fits, decision lists."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np


def edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges between distinct values, by quantile."""
    v = np.unique(x)
    if len(v) < 2:
        return np.zeros(0)
    q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    at = np.clip(np.searchsorted(v, q, "right"), 1, len(v) - 1)
    return np.unique((v[at - 1] + v[at]) / 2)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)], 1) if len(cuts) else np.zeros((len(x), 0), int)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaf(g, h, l2):
    return -g / (h + l2)


def _gain(g, h, l2):
    return g * g / (h + l2)


def best_cut(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, int]:
    """Gain and bin of the best cut of a histogram: bins below it go left."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = _gain(gl, hl, l2) + _gain(gt - gl, ht - hl, l2) - _gain(gt, ht, l2)
    gain[(hl < least) | (ht - hl < least)] = 0
    if not len(gain):
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


@dataclass
class AdditiveModel:
    """A generalised additive model with pairwise interactions: one lookup table a feature and a pair.

    Cyclic boosting: in each round every feature in turn gets a tree of at most three leaves over its own bins, fitted
    to the gradients left by all others, and a small step of it is added to its table. Pairs are chosen by what a 2 x 2
    split of the remaining gradients gains, then boosted the same way with depth-two trees.
    """

    bins: int = 32
    pair_bins: int = 8
    pairs: int = 5
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    l2: float = 1.0
    least: float = 2.0
    base: float = 0.0
    cuts: list = field(default_factory=list)
    pair_cuts: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    chosen: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def _tree(self, g, h):
        """Leaf value of each bin: the best cut, then the best cut of the better side."""
        out = np.full(len(g), _leaf(g.sum(), h.sum(), self.l2))
        gain, k = best_cut(g, h, self.l2, self.least)
        if gain <= 0:
            return np.zeros(len(g))
        sides = [slice(0, k), slice(k, len(g))]
        more = [best_cut(g[s], h[s], self.l2, self.least) for s in sides]
        deep = int(np.argmax([m[0] for m in more]))
        if more[deep][0] > 0:
            s, c = sides[deep], more[deep][1]
            sides[deep : deep + 1] = [slice(s.start, s.start + c), slice(s.start + c, s.stop)]
        for s in sides:
            out[s] = _leaf(g[s].sum(), h[s].sum(), self.l2)
        return out

    def _pair_tree(self, g, h):
        best, out = 0.0, np.zeros(g.shape)
        for axis in (0, 1):
            a, b = (g, h) if axis == 0 else (g.T, h.T)
            gain, k = best_cut(a.sum(1), b.sum(1), self.l2, self.least)
            tree = np.zeros(a.shape)
            for s in (slice(0, k), slice(k, len(a))):
                more, c = best_cut(a[s].sum(0), b[s].sum(0), self.l2, self.least)
                gain += more
                for t in (slice(0, c), slice(c, a.shape[1])) if more > 0 else (slice(None),):
                    tree[s, t] = _leaf(a[s, t].sum(), b[s, t].sum(), self.l2)
            if gain > best:
                best, out = gain, tree if axis == 0 else tree.T
        return best, out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, m = x.shape
        p = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(p / (1 - p)))
        self.cuts = [edges(x[:, i], self.bins) for i in range(m)]
        self.pair_cuts = [edges(x[:, i], self.pair_bins) for i in range(m)]
        b, c = binned(x, self.cuts), binned(x, self.pair_cuts)
        self.tables = [np.zeros(len(k) + 1) for k in self.cuts]
        z = np.full(n, self.base)
        for _ in range(self.rounds):
            for i in range(m):
                q = sigmoid(z)
                size = len(self.tables[i])
                step = self.rate * self._tree(np.bincount(b[:, i], q - y, size), np.bincount(b[:, i], q * (1 - q), size))
                self.tables[i] += step
                z += step[b[:, i]]
        q = sigmoid(z)
        scored = []
        for i, j in itertools.combinations(range(m), 2):
            shape = (len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1)
            at = c[:, i] * shape[1] + c[:, j]
            grid = lambda v: np.bincount(at, v, shape[0] * shape[1]).reshape(shape)  # noqa: B023, E731
            scored.append((self._pair_tree(grid(q - y), grid(q * (1 - q)))[0], (i, j), at, shape))
        scored = [s for s in sorted(scored, key=lambda s: (-s[0], s[1]))[: self.pairs] if s[0] > 0]
        self.chosen = [s[1] for s in scored]
        self.pair_tables = [np.zeros(s[3]) for s in scored]
        for _ in range(self.pair_rounds):
            for t, (_, _, at, shape) in zip(self.pair_tables, scored):
                q = sigmoid(z)
                grid = lambda v: np.bincount(at, v, shape[0] * shape[1]).reshape(shape)  # noqa: B023, E731
                step = self.rate * self._pair_tree(grid(q - y), grid(q * (1 - q)))[1]
                t += step
                z += step.ravel()[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sums of looked-up bins, through the logistic function."""
        b, c = binned(x, self.cuts), binned(x, self.pair_cuts)
        z = np.full(len(x), self.base)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        for (i, j), t in zip(self.chosen, self.pair_tables):
            z += t[c[:, i], c[:, j]]
        return sigmoid(z)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x, by pooling adjacent violators; equal x are pooled first."""
    v, at = np.unique(x, return_inverse=True)
    w, s = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []
    for k in range(len(v)):
        blocks.append([s[k], w[k], v[k], v[k]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    xs = np.array([e for b in blocks for e in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return xs, ys


@dataclass
class BoostedTrees:
    """Gradient-boosted trees for the logistic loss over binned features, with isotonic calibration on rows set aside."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.15
    bins: int = 32
    l2: float = 1.0
    least: float = 1.5
    base: float = 0.0
    cuts: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    knots: tuple = ()

    def _grow(self, b, g, h, rows, depth):
        best = (1e-9, 0, 0)
        if depth and len(rows) > 1:
            for i in range(b.shape[1]):
                size = len(self.cuts[i]) + 1
                gain, k = best_cut(np.bincount(b[rows, i], g[rows], size), np.bincount(b[rows, i], h[rows], size), self.l2, self.least)
                best = max(best, (gain, i, k), key=lambda t: t[0])
        gain, i, k = best
        if not k:
            return self.rate * float(_leaf(g[rows].sum(), h[rows].sum(), self.l2))
        left = b[rows, i] < k
        return (i, k, self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))

    def _apply(self, tree, b, rows, z):
        if not isinstance(tree, tuple):
            z[rows] += tree
            return
        left = b[rows, tree[0]] < tree[1]
        self._apply(tree[2], b, rows[left], z)
        self._apply(tree[3], b, rows[~left], z)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        aside = np.arange(len(x)) % 4 == 3
        fx, fy = (x[~aside], y[~aside]) if len(x) >= 40 else (x, y)
        self.cuts = [edges(fx[:, i], self.bins) for i in range(x.shape[1])]
        b, every = binned(fx, self.cuts), np.arange(len(fx))
        p = (fy.sum() + 1) / (len(fy) + 2)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(fx), self.base)
        for _ in range(self.rounds):
            q = sigmoid(z)
            self.trees.append(self._grow(b, q - fy, q * (1 - q), every, self.depth))
            self._apply(self.trees[-1], b, every, z)
        cx, cy = (x[aside], y[aside]) if len(x) >= 40 else (x, y)
        # two soft rows keep the ends off 0 and 1
        raw = self.raw(cx)
        lo, hi = (raw.min() - 1e-6, raw.max() + 1e-6) if len(raw) else (-1.0, 1.0)
        self.knots = isotonic(np.concatenate([raw, [lo, lo, hi, hi]]), np.concatenate([cy, [0, p, p, 1]]))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, z = binned(x, self.cuts), np.full(len(x), self.base)
        for t in self.trees:
            self._apply(t, b, np.arange(len(x)), z)
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a small share of the raw score keeps the order inside a flat step."""
        raw = self.raw(x)
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 * sigmoid(raw), 0, 1)


@dataclass(frozen=True)
class Test:
    """feature > cut, or feature <= cut."""

    feature: int
    above: bool
    cut: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.cut if self.above else x[:, self.feature] <= self.cut


def holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t(x)
    return out


def decision_list(x: np.ndarray, y: np.ndarray, most_rules: int = 12, most_tests: int = 4, bins: int = 64, precision: float = 0.9, support: int = 4) -> list[list[Test]]:
    """Sequential covering for y = 1: grow a conjunction on two thirds of the rows by information gain, prune it from
    the end on the others, keep it if it is precise on all rows, take away what it covers, and go on."""
    third = np.arange(len(x)) % 3 == 2
    rules, left = [], np.ones(len(x), bool)
    cuts = [edges(x[:, i], bins) for i in range(x.shape[1])]
    while len(rules) < most_rules:
        grow, prune = left & ~third, left & third
        if y[grow].sum() < support:
            break
        rule, inside = [], grow.copy()
        while len(rule) < most_tests and (y[inside] == 0).any():
            p0, n0 = y[inside].sum(), (1 - y[inside]).sum()
            best = (1e-9, None)
            for i, c in enumerate(cuts):
                if not len(c):
                    continue
                b = np.searchsorted(c, x[inside, i], "left")
                p, n = np.bincount(b, y[inside], len(c) + 1), np.bincount(b, 1 - y[inside], len(c) + 1)
                for above in (True, False):
                    pc, nc = (p[::-1].cumsum()[::-1][1:], n[::-1].cumsum()[::-1][1:]) if above else (p.cumsum()[:-1], n.cumsum()[:-1])
                    gain = np.where(pc > 0, pc * (np.log2(np.maximum(pc, 1e-9) / np.maximum(pc + nc, 1e-9)) - np.log2(p0 / (p0 + n0))), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], Test(i, above, float(c[k])))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= best[1](x)
        if not rule:
            break

        def worth(r):
            m = prune & holds(r, x)  # noqa: B023
            return (y[m].sum() - (1 - y[m]).sum() + 0.0) / max(1, m.sum())

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        cover = left & holds(rule, x)
        if y[cover].sum() < support or y[cover].mean() < precision:
            break
        rules.append(rule)
        left &= ~cover
    return rules
