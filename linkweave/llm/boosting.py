"""Gradient-boosted trees fitted on a bounded labelled sample and compiled to one SQL expression.

Fitting happens on the driver over at most ``MAX_ROWS`` labelled rows (logistic
loss, exact splits over candidate thresholds). Scoring is a nested CASE built
from built-in functions, so that it runs inside the JVM for any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Documented bound of every labelled sample that is fitted on the driver.
MAX_ROWS = 4000


@dataclass
class Boosted:
    """base + sum of trees, in log-odds; a tree is (feature, threshold, left, right) or a float."""

    features: list[str]
    base: float = 0.0
    trees: list = field(default_factory=list)
    threshold: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def column(self, get) -> Column:
        """Log-odds; ``get`` maps a feature's name to its Column."""

        def node(t):
            if isinstance(t, float):
                return F.lit(t)
            j, cut, left, right = t
            return F.when(get(self.features[j]) <= F.lit(cut), node(left)).otherwise(node(right))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + node(t)
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(t, rows):
            if isinstance(t, float):
                return np.full(len(rows), t)
            j, cut, left, right = t
            low = x[rows, j] <= cut
            out = np.empty(len(rows))
            out[low], out[~low] = walk(left, rows[low]), walk(right, rows[~low])
            return out

        total = np.full(len(x), self.base)
        for t in self.trees:
            total += walk(t, np.arange(len(x)))
        return total


def _tree(x, grad, hess, rows, depth, rate, cuts):
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = float(np.round(rate * g / (h + 1.0), 6))
    if depth == 0 or len(rows) < 8:
        return leaf
    best = (1e-6, None)
    for j, points in enumerate(cuts):
        v = x[rows, j]
        for cut in points:
            low = v <= cut
            n = int(low.sum())
            if n < 4 or len(rows) - n < 4:
                continue
            gl, hl = grad[rows][low].sum(), hess[rows][low].sum()
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if gain > best[0]:
                best = (gain, (j, float(cut), low))
    if best[1] is None:
        return leaf
    j, cut, low = best[1]
    return (j, cut, _tree(x, grad, hess, rows[low], depth - 1, rate, cuts), _tree(x, grad, hess, rows[~low], depth - 1, rate, cuts))


def fit(x: np.ndarray, y: np.ndarray, features: list[str], rounds: int = 12, depth: int = 3, rate: float = 0.4, precision: float = 0.95, groups: list[str] | None = None, cuts: dict[str, list[float]] | None = None) -> Boosted:
    """Fit on two thirds; set the threshold on the other third.

    The threshold is the smallest log-odds at which held-out precision reaches
    ``precision`` (never below even odds). Thresholds of splits are quantiles,
    or those that ``cuts`` gives for a feature. Where ``groups`` names a group for
    each row, every group gets a threshold of its own, too. With one class only, or no rows, the
    model is a constant that follows the class at hand (no rows: negative).
    """
    if len(x) > MAX_ROWS:
        raise ValueError(f"at most {MAX_ROWS} labelled rows, not {len(x)}")
    model = Boosted(features)
    if len(x) == 0 or y.min() == y.max():
        model.base = 4.0 if len(x) and y.max() == 1 else -4.0
        return model
    held = np.arange(len(x)) % 3 == 2
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    xt, yt = x[~held], y[~held].astype(float)
    p = yt.mean()
    model.base = float(np.round(np.log(p / (1 - p)), 6))
    own = cuts or {}
    points = [np.array(own[f]) if f in own else np.unique(np.round(np.quantile(xt[:, j], np.linspace(0.02, 0.98, 17)), 6)) for j, f in enumerate(features)]
    score = np.full(len(xt), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        t = _tree(xt, yt - q, q * (1 - q), np.arange(len(xt)), depth, rate, points)
        model.trees.append(t)
        score += Boosted(features, 0.0, [t]).predict(xt)
    if not held.any():
        held[:] = True
    s = model.predict(x[held])
    model.threshold = _threshold(s, y[held], precision)
    for g in dict.fromkeys(groups or []):
        at = np.array([z == g for z in groups])[held]
        model.thresholds[g] = _threshold(s[at], y[held][at], precision) if at.any() else model.threshold
    return model


def _threshold(s: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The smallest log-odds of at least 0 from which on precision holds; a little over the highest where it never does."""
    order = np.argsort(-s, kind="stable")
    s = s[order]
    last = np.append(s[1:] != s[:-1], True)  # rows of equal log-odds are taken together
    good = np.nonzero(last & (np.cumsum(truth[order]) / np.arange(1, len(s) + 1) >= precision))[0]
    return float(max(0.0, np.floor(s[good[-1]] * 1e6) / 1e6)) if len(good) else float(np.round(s.max() + 1e-3, 6))
