"""The bipartite configuration model of records and items, and how unlikely a number of common records is under it."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.vectorize(math.erfc, otypes=[float])

#: Width of the bins of item frequencies, as logarithm, over which record sizes are fitted; each item's own value is solved for afterwards.
WIDTH = math.log(1.002)


class ConfigurationNull:
    """Item j is in a record of size k with probability x_k y_j / (1 + x_k y_j), such that all sizes and frequencies are met on average.

    Records of one size share x, items of one frequency share y, so the fit is over distinct sizes and bins of frequencies only, of which there are few at any
    number of records; frequencies below 500 have a bin each. y is solved for at the exact frequency.
    """

    def __init__(self, sizes: dict[int, int], degrees: dict[int, int], rounds: int = 300) -> None:
        self.size_counts = np.array([m for _, m in sorted(sizes.items())], float)
        sizes_at = np.array(sorted(sizes), float)
        values = np.array(sorted(degrees), float)
        weights = np.array([m for _, m in sorted(degrees.items())], float)
        _, code = np.unique(np.where(values < 500, values, 500 + np.floor(np.log(values / 500) / WIDTH)), return_inverse=True)
        mass = np.bincount(code, weights)
        at = np.bincount(code, weights * values) / np.maximum(mass, 1e-300)
        total = max(float((sizes_at * self.size_counts).sum()), 1.0)
        x, y = sizes_at / math.sqrt(total), at / math.sqrt(total)
        for _ in range(rounds):
            old = x
            x = sizes_at / np.maximum((mass * y / (1 + x[:, None] * y)).sum(1), 1e-300)
            y = at / np.maximum((self.size_counts[:, None] * x[:, None] / (1 + x[:, None] * y)).sum(0), 1e-300)
            x, y = np.minimum(x, 1e12), np.minimum(y, 1e12)
            if np.allclose(x, old, rtol=1e-9, atol=0):
                break
        self._x = x

    def probability(self, degree: np.ndarray) -> np.ndarray:
        """By size (rows) and item (columns): y such that the item's frequency is met, by Newton's method on its logarithm."""
        degree, which = np.unique(np.asarray(degree, float), return_inverse=True)
        m, x = self.size_counts[:, None], np.log(np.maximum(self._x, 1e-300))[:, None]
        # An item in all records has no finite y.
        aim = np.minimum(degree, m.sum() * (1 - 1e-9))
        u = np.log(aim / np.maximum((m * np.exp(x)).sum(), 1e-300))
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x + u, -700, 700)))
            step = np.clip((aim - (m * p).sum(0)) / np.maximum((m * p * (1 - p)).sum(0), 1e-300), -1, 1)
            u = u + step
            if np.abs(step).max(initial=0) < 1e-12:
                break
        return (1 / (1 + np.exp(-np.clip(x + u, -700, 700))))[:, which.ravel()]

    def tails(self, degree_a: np.ndarray, degree_b: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected common records, and the natural logarithm of the probability of together or more."""
        q = self.probability(degree_a) * self.probability(degree_b)
        return (self.size_counts[:, None] * q).sum(0), log_tail(q, self.size_counts, together)


def log_tail(q: np.ndarray, m: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log P(X >= t) of the Poisson-binomial X with m_k trials of probability q_k, by column of q: exact for a t of 1 or less and of all trials, between them the Lugannani-Rice saddlepoint for lattice variables."""
    q = np.clip(q, 1e-300, 1 - 1e-12)
    m = m[:, None]
    t = np.asarray(t, float)
    most = float(m.sum())
    out = np.zeros(len(t))
    deep = (t > 1) & (t < most)
    out[t > most] = -np.inf
    full = t == most
    out[full] = (m * np.log(q[:, full])).sum(0)
    one = (t == 1) & ~full
    out[one] = np.log(np.maximum(-np.expm1((m * np.log1p(-q[:, one])).sum(0)), 1e-300))
    if not deep.any():
        return out
    q, t = q[:, deep], t[deep]
    s = np.log(t / np.maximum((m * q).sum(0), 1e-300))
    for _ in range(60):
        e = q * np.exp(np.minimum(s, 600.0))
        tilted = e / (1 - q + e)
        first, second = (m * tilted).sum(0), (m * tilted * (1 - tilted)).sum(0)
        step = np.clip((t - first) / np.maximum(second, 1e-300), -2, 2)
        s = s + step
        if np.abs(step).max() < 1e-10:
            break
    e = q * np.exp(np.minimum(s, 600.0))
    tilted = e / (1 - q + e)
    second = (m * tilted * (1 - tilted)).sum(0)
    height = s * t - (m * np.log1p(q * np.expm1(np.minimum(s, 600.0)))).sum(0)
    w = np.sign(s) * np.sqrt(2 * np.maximum(height, 0))
    u = -np.expm1(-s) * np.sqrt(second)
    near = w < 5
    with np.errstate(divide="ignore", invalid="ignore"):
        density = np.exp(-w * w / 2) / math.sqrt(2 * math.pi)
        close = 0.5 * _erfc(w / math.sqrt(2)) + density * (1 / u - 1 / w)
        far = -w * w / 2 - 0.5 * math.log(2 * math.pi) + np.log(np.maximum(1 / u - 1 / w**3 + 3 / w**5, 1e-300))
        value = np.where(near, np.log(np.clip(close, 1e-300, 1)), far)
    # At the mean itself the formula is singular: there the tail is its limit.
    third = (m * tilted * (1 - tilted) * (1 - 2 * tilted)).sum(0)
    middle = 0.5 + (1 / (2 * np.sqrt(second)) - third / (6 * second**1.5)) / math.sqrt(2 * math.pi)
    out[deep] = np.minimum(np.where(np.abs(w) < 1e-3, np.log(np.clip(middle, 1e-300, 1)), value), 0)
    return out
