"""Small trainers for tables of distinct, weighted rows; each takes (x, y, w) and gives a function from rows to labels.

They are fitted inside Spark tasks, one for each (table, model); what they hold is the distinct rows of one table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Rule = Callable[[np.ndarray], np.ndarray]

# Sizes and step counts of the compared models.
BOOSTS, BOOST_DEPTH, BOOST_RATE = 100, 3, 0.1
TREES, TREE_DEPTH = 100, 10
SVM_STEPS, SVM_COST = 1000, 1.0
HIDDEN, EPOCHS = 100, 200
SEED = 1


def majority(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Rule:
    """The label of most rows; the smaller one on a tie."""
    best = int(w[y == 1].sum() > w[y == 0].sum())
    return lambda rows: np.full(len(rows), best)


def _grow(x, gradient, hessian, depth, source, try_features, score):
    """A tree as nested tuples (feature, cut, low, high) or leaf values; `score` rates (sum of gradients, sum of hessians)."""
    def node(at, level):
        g, h = gradient[at].sum(), hessian[at].sum()
        if level == depth or len(at) < 2:
            return g, h
        features = np.arange(x.shape[1]) if try_features is None else source.permutation(x.shape[1])[:try_features]
        best, split = score(g, h) + 1e-12 * (1 + abs(score(g, h))), None
        for f in features:
            values, place = np.unique(x[at, f], return_inverse=True)
            if len(values) < 2:
                continue
            low_g = np.bincount(place, gradient[at]).cumsum()[:-1]
            low_h = np.bincount(place, hessian[at]).cumsum()[:-1]
            gain = score(low_g, low_h) + score(g - low_g, h - low_h)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, split = gain[k], (f, (values[k] + values[k + 1]) / 2)
        if split is None:
            return g, h
        low = x[at, split[0]] <= split[1]
        return (*split, node(at[low], level + 1), node(at[~low], level + 1))

    return node(np.flatnonzero(hessian > 0), 0)


def _leaves(tree, rows: np.ndarray, value) -> np.ndarray:
    out = np.zeros(len(rows))

    def walk(node, at):
        if len(node) == 2:
            out[at] = value(*node)
        else:
            low = rows[at, node[0]] <= node[1]
            walk(node[2], at[low])
            walk(node[3], at[~low])

    walk(tree, np.arange(len(rows)))
    return out


def gradient_boosting(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Rule:
    """Newton boosting of the logistic loss with trees of depth BOOST_DEPTH."""
    share = min(max(np.average(y, weights=w), 1e-6), 1 - 1e-6)
    base = np.log(share / (1 - share))
    total, trees = np.full(len(y), base), []
    value = lambda g, h: g / max(h, 1e-12)
    for _ in range(BOOSTS):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x, w * (y - p), w * p * (1 - p), BOOST_DEPTH, None, None, lambda g, h: g * g / np.maximum(h, 1e-12))
        trees.append(tree)
        total = total + BOOST_RATE * _leaves(tree, x, value)
    return lambda rows: (base + BOOST_RATE * sum(_leaves(t, rows, value) for t in trees) > 0).astype(int)


def random_forest(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Rule:
    """Gini trees on bootstrap resamples of the rows, a random root of the features at each node; mean of leaf shares."""
    source, trees = np.random.default_rng(SEED), []
    n = int(round(w.sum()))
    for _ in range(TREES):
        times = source.multinomial(n, w / w.sum()).astype(float)
        trees.append(_grow(x, times * y, times, TREE_DEPTH, source, max(1, int(np.sqrt(x.shape[1]))), lambda g, h: (g * g + (h - g) ** 2) / np.maximum(h, 1e-12)))
    return lambda rows: (sum(_leaves(t, rows, lambda g, h: g / max(h, 1e-12)) for t in trees) / TREES > 0.5).astype(int)


def descend(objective, start: np.ndarray, steps: int, memory: int = 10, tolerance: float = 1e-4) -> np.ndarray:
    """Limited-memory quasi-Newton minimisation of `objective`, which gives (value, gradient)."""
    at, (value, slope) = start, objective(start)
    moves, changes = [], []
    for _ in range(steps):
        if np.abs(slope).max() < tolerance:
            break
        way, factors = -slope.copy(), []
        for s, t in zip(reversed(moves), reversed(changes)):
            a = (s @ way) / (s @ t)
            factors.append(a)
            way -= a * t
        if moves:
            way *= (moves[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
        for s, t, a in zip(moves, changes, reversed(factors)):
            way += (a - (t @ way) / (s @ t)) * s
        length = 1.0 if moves else 1 / max(1.0, np.abs(slope).sum())
        while True:
            new, (new_value, new_slope) = at + length * way, objective(at + length * way)
            if new_value <= value + 1e-4 * length * (slope @ way) or length < 1e-10:
                break
            length /= 2
        s, t = new - at, new_slope - slope
        if s @ t > 1e-12:
            moves, changes = [*moves, s][-memory:], [*changes, t][-memory:]
        if new_value >= value:
            break
        at, value, slope = new, new_value, new_slope
    return at


def linear_svc(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Rule:
    """Squared hinge loss of all rows plus half the squared coefficients."""
    sign, rows = 2.0 * y - 1, np.column_stack([x, np.ones(len(x))])

    def objective(b):
        short = np.maximum(0, 1 - sign * (rows @ b))
        return b @ b / 2 + SVM_COST * (w * short * short).sum(), b - 2 * SVM_COST * rows.T @ (w * short * sign)

    scale = max(w.sum(), 1.0)
    b = descend(lambda v: tuple(part / scale for part in objective(v)), np.zeros(rows.shape[1]), SVM_STEPS, tolerance=1e-6)
    return lambda new: (np.column_stack([new, np.ones(len(new))]) @ b > 0).astype(int)


def neural_net(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Rule:
    """One hidden layer of HIDDEN rectified units, logistic loss, EPOCHS quasi-Newton steps over all rows."""
    source, d, scale = np.random.default_rng(SEED), x.shape[1], max(w.sum(), 1.0)
    limit = [np.sqrt(6 / (d + HIDDEN)), np.sqrt(2 / (HIDDEN + 1))]
    start = np.concatenate([source.uniform(-limit[0], limit[0], d * HIDDEN + HIDDEN), source.uniform(-limit[1], limit[1], HIDDEN + 1)])
    cut = d * HIDDEN

    def parts(v):
        return v[:cut].reshape(d, HIDDEN), v[cut:cut + HIDDEN], v[cut + HIDDEN:-1], v[-1]

    def objective(v):
        first, shift, second, base = parts(v)
        inner = x @ first + shift
        held = np.maximum(inner, 0)
        out = held @ second + base
        loss = (w * (np.logaddexp(0, out) - y * out)).sum() / scale
        error = w * (1 / (1 + np.exp(-np.clip(out, -500, 500))) - y) / scale
        back = np.outer(error, second) * (inner > 0)
        return loss, np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), held.T @ error, [error.sum()]])

    first, shift, second, base = parts(descend(objective, start, EPOCHS, tolerance=1e-6))
    return lambda rows: (np.maximum(rows @ first + shift, 0) @ second + base > 0).astype(int)


TRAINERS: dict[str, Callable[..., Rule]] = {f.__name__: f for f in (majority, gradient_boosting, random_forest, linear_svc, neural_net)}
