"""A small random forest: fitted in numpy on a bounded sample on the driver, applied as a SQL expression."""

from __future__ import annotations

import numpy as np


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[float, int, float] | None:
    """The (impurity, feature, threshold) of the best split by Gini impurity."""
    best, n = None, len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        a, total = at + 1.0, left[-1]
        p, q = left[at] / a, (total - left[at]) / (n - a)
        impurity = a * p * (1 - p) + (n - a) * q * (1 - q)
        k = int(np.argmin(impurity))
        if best is None or impurity[k] < best[0] - 1e-12:
            best = float(impurity[k]), int(f), float((v[at[k]] + v[at[k] + 1]) / 2)
    return best


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, few: int) -> dict | float:
    p = float((y.sum() + 0.5) / (len(y) + 1))
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return round(p, 6)
    found = _split(x, y, rng.choice(x.shape[1], few, replace=False))
    if found is None:
        return round(p, 6)
    _, f, t = found
    left = x[:, f] <= t
    return {"f": f, "t": t, "l": _grow(x[left], y[left], depth - 1, rng, few), "r": _grow(x[~left], y[~left], depth - 1, rng, few)}


def fit(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, seed: int = 7) -> list:
    """Trees on bootstrap samples, each node choosing among the square root of the features."""
    rng = np.random.default_rng(seed)
    few = max(1, round(x.shape[1] ** 0.5))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows].astype(float), depth, rng, few))
    return out


def predict(forest: list, x: np.ndarray) -> np.ndarray:
    def one(tree, row):
        while isinstance(tree, dict):
            tree = tree["l"] if row[tree["f"]] <= tree["t"] else tree["r"]
        return tree

    return np.array([sum(one(t, row) for t in forest) / len(forest) for row in x])


def to_sql(forest: list, names: list[str]) -> str:
    """The forest's mean as nested CASE expressions over columns or fields ``names``."""

    def one(tree) -> str:
        if not isinstance(tree, dict):
            return f"{tree!r}D"
        return f"CASE WHEN {names[tree['f']]} <= {tree['t']!r}D THEN {one(tree['l'])} ELSE {one(tree['r'])} END"

    return "(" + " + ".join(one(t) for t in forest) + f") / {len(forest)}D"
