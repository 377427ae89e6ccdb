"""Draws of the seating of a Pitman-Yor process by numpy: numbers of tables by generalised Stirling numbers, and gamma variables that are functions of keys.

A dish with c customers has t tables with a probability in proportion to S(c, t) x^t, where S are the generalised Stirling numbers of the discount d,
S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t). Up to `EXACT` customers their ratios come from this recurrence. Beyond it S(c, t) is
c! / (t! d^t) P(N_1 + .. + N_t = c), where the N have the generating function 1 - (1 - s)^d: by the finite sum where that is well-conditioned, else by a saddle point with its
first correction (logarithms agree with the recurrence to 4e-3 for discounts up to 0.85 and to 1e-2 at 0.9, the largest that the model takes). Large dishes take random-walk steps by these weights.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from . import _text as X

EXACT, TERMS = 128, 100
#: Terms of the finite sums that are added at once.
PIECE = 10
#: Random-walk steps of a large dish in a sweep.
STEPS = 12
#: Gamma variables drawn at once, so that what is made on the way stays in a core's cache.
_AT_ONCE = 1 << 13
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    low = np.flatnonzero(x < 8)
    y, shift = x.copy(), 0.0
    if len(low):
        shift = np.zeros(len(x))
        shift[low] = np.log(np.prod([x[low] + k for k in range(8)], axis=0))
        y[low] += 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.918938533204672742 + series - shift


def seeds(key: np.ndarray, salt: int) -> np.ndarray:
    return X.mix(key ^ X.mix(np.array([salt], np.uint64) * _GOLD))


def uniforms(seed: np.ndarray, k: int) -> np.ndarray:
    """Numbers in (0, 1), a function of seed and k."""
    return ((X.mix(seed + np.uint64(k * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gammas(shape: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Gamma variables (Marsaglia and Tsang), a function of shape, key and salt: whoever knows these has the same draw."""
    shape, out = np.asarray(shape, np.float64), np.empty(len(shape))
    for i in range(0, len(shape), _AT_ONCE):
        out[i : i + _AT_ONCE] = _gammas(shape[i : i + _AT_ONCE], seeds(key[i : i + _AT_ONCE], salt))
    return out


def _gammas(shape: np.ndarray, seed: np.ndarray) -> np.ndarray:
    small = shape < 1
    a = np.where(small, shape + 1, shape) - 1 / 3
    out, todo, k = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(todo):
        of, some = seed[todo], a[todo]
        u, v, w = (uniforms(of, 3 * k + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        cube = (1 + x / np.sqrt(9 * some)) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            fits = (cube > 0) & (np.log(w) < 0.5 * x * x + some * (1 - cube + np.log(cube)))
        out[todo[fits]] = (some * cube)[fits]
        todo, k = todo[~fits], k + 1
    out[small] *= uniforms(seed[small], 1 << 40) ** (1 / shape[small])
    return np.maximum(out, 1e-300)


@lru_cache(4)
def ratios(discount: float, most: int = EXACT) -> np.ndarray:
    """S(c, t + 1) / S(c, t) at [c, t]."""
    out = np.zeros((most + 1, most + 1))
    t = np.arange(1, most)
    for c in range(1, most):
        before = out[c]
        with np.errstate(divide="ignore"):
            under = np.where(t == 1, 0, 1 / before[t - 1]) + (c - discount * t)
        out[c + 1, 1:most] = np.where(t <= c, (1 + (c - discount * (t + 1)) * before[t]) / np.where(t <= c, under, 1), 0)
    return out


def _small(customers: np.ndarray, x: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Exact draws: t goes through 1, 2, .. and each replaces the last choice with its share of the weight so far."""
    order = np.argsort((EXACT - customers).astype(np.uint8), kind="stable")
    c, weight = customers[order], x[order]
    more = len(c) - np.cumsum(np.bincount(customers))  # dishes with more than t customers
    by_tables, tables, q = np.ascontiguousarray(ratios(discount).T), np.ones(len(c), np.int64), np.ones(len(c))
    with np.errstate(divide="ignore", over="ignore"):
        for t in range(1, int(c[0]) if len(c) else 0):
            n = int(more[t])
            share = by_tables[t].take(c[:n])
            share *= weight[:n]
            q[:n] /= share
            q[:n] += 1
            tables[:n][draw.random(n) * q[:n] < 1] = t + 1
    out = np.empty_like(tables)
    out[order] = tables
    return out


@lru_cache(4)
def _of_terms(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each term j of the finite sums (at j - 1): gamma(1 + j d) / gamma(1 + (j - 1) d) / j, and the factor with its sign."""
    j = np.arange(1, TERMS + 1)
    return np.array([math.gamma(1 + k * d) / math.gamma(1 + (k - 1) * d) / k for k in j.tolist()]), -((-1.0) ** j) * np.sin(np.pi * j * d) / np.pi


class Weights:
    """log of S(c, t) x^t of dishes with c customers, but for what does not depend on t. What the finite sums need of c alone is kept, as steps ask for other tables of the same dishes."""

    def __init__(self, customers: np.ndarray, x: np.ndarray, discount: float):
        self.c, self.d, self.log_x = customers.astype(np.float64), discount, np.log(x / discount)
        self.ahead = log_gamma(self.c - discount) - log_gamma(self.c + 1)
        self.pieces: list[np.ndarray] = []

    def _factors(self, k: int) -> np.ndarray:
        """Of the k-th `PIECE` terms (rows) and each dish: a term's size over that of the term before, but for the ways to choose."""
        while len(self.pieces) <= k:
            first = len(self.pieces) * PIECE
            j = np.arange(first + 1, first + PIECE + 1)[:, None]
            # log of gamma(y) / gamma(y + d) without a difference of large numbers
            y = np.maximum(self.c - j * self.d, 8)
            over = y + self.d
            log = self.d - (y - 0.5) * np.log1p(self.d / y) - self.d * np.log(over) + (1 / 12 - 1 / (360 * y * y)) / y - (1 / 12 - 1 / (360 * over * over)) / over
            if not first:
                log[0] = 0
            self.pieces.append(np.exp(log) * _of_terms(self.d)[0][first : first + PIECE, None])
        return self.pieces[k]

    def _finite_sums(self, t: np.ndarray, dish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(N_1 + .. + N_t = c) by the finite sum, and whether that is well-conditioned and has ended within `TERMS`."""
        total, largest, size, todo = np.zeros(len(t)), np.zeros(len(t)), np.ones(len(t)), np.arange(len(t))
        hopeless = 1e8 * np.exp(-self.ahead[dish])  # of a sum that is at most this / 1e8, as a chance is at most 1
        for k in range(TERMS // PIECE):
            if not len(todo):
                break
            j = np.arange(k * PIECE, (k + 1) * PIECE)
            sizes = self._factors(k).take(dish[todo], axis=1)
            sizes *= t[todo] - j[:, None]
            sizes[0] *= size[todo]
            np.cumprod(sizes, axis=0, out=sizes)
            size[todo] = np.abs(sizes[-1])
            sizes *= _of_terms(self.d)[1][j, None]
            total[todo] += sizes.sum(axis=0)
            largest[todo] = np.maximum(largest[todo], np.abs(sizes, out=sizes).max(axis=0))
            todo = todo[(size[todo] > 1e-10 * np.abs(total[todo])) & (largest[todo] <= hopeless[todo])]
        good = (total > 1e-8 * largest) & (size < 1e-7 * total)
        return np.log(np.maximum(total, 1e-300)) + self.ahead[dish], good

    def _log_sums(self, t: np.ndarray, dish: np.ndarray) -> np.ndarray:
        """log P(N_1 + .. + N_t = c), 1 <= t <= c."""
        c, d = self.c[dish], self.d
        out = np.empty(len(c))
        few = np.flatnonzero((t < c) & (t * c**-d < 12) & (c > EXACT))
        done = np.zeros(len(c), bool)
        out[few], done[few] = self._finite_sums(t[few], dish[few])
        rest = ~done & (t < c)
        if rest.any():
            n, top = t[rest], c[rest]
            ratio = np.log(top / n)
            low, high = np.full(len(n), -50.0), np.full(len(n), 8.0)  # of log(-log y), where 1 - y is the saddle point
            for _ in range(60):
                mid = (low + high) / 2
                log_y = -np.exp(mid)
                slope = np.log(d) + np.log(-np.expm1(log_y)) + (d - 1) * log_y - np.log(-np.expm1(d * log_y))
                low, high = np.where(slope < ratio, mid, low), np.where(slope < ratio, high, mid)
            log_y = -np.exp((low + high) / 2)
            y, x = np.exp(log_y), -np.expm1(log_y)
            g = -np.expm1(d * log_y)
            m, h = top / n, (1 - d) * x / y
            h1, h2 = (1 - d) * x / y**2, (1 - d) * (x / y**2 + 2 * x**2 / y**3)
            k2 = m * np.maximum(1 + h - m, 1e-300)
            k3 = k2 * (1 + h - m) + m * (h1 - k2)
            k4 = k3 * (1 + h - m) + 2 * k2 * (h1 - k2) + m * (h2 - k3)
            fix = (k4 / (8 * k2**2) - 5 * k3**2 / (24 * k2**3)) / n
            out[rest] = n * np.log(g) - top * np.log(x) - 0.5 * np.log(2 * np.pi * n * k2) + np.log1p(np.clip(fix, -0.5, 0.5))
        every, but_one = t == c, t == c - 1
        out[every] = c[every] * np.log(d)
        out[but_one] = (c[but_one] - 1) * np.log(d) + np.log((c[but_one] - 1) * (1 - d) / 2)
        return out

    def of(self, tables: np.ndarray, dish: np.ndarray | None = None) -> np.ndarray:
        """Of these numbers of tables, of the dishes with these numbers or of all."""
        dish, t = np.arange(len(self.c)) if dish is None else dish, tables.astype(np.float64)
        return self._log_sums(t, dish) - log_gamma(t + 1.0) + t * self.log_x[dish]


def log_weights(c: np.ndarray, t: np.ndarray, x: np.ndarray, discount: float) -> np.ndarray:
    """log of S(c, t) x^t, but for what does not depend on t."""
    return Weights(c, x, discount).of(t)


def _large(customers: np.ndarray, x: np.ndarray, discount: float, draw: np.random.Generator, before: np.ndarray | None) -> np.ndarray:
    """Random-walk steps from the tables before; from the likeliest number if there were none."""
    weights = Weights(customers, x, discount)
    if before is None:
        low, high = np.ones(len(customers), np.int64), customers.copy()
        while (low < high).any():
            mid = (low + high) // 2
            up = weights.of(np.minimum(mid + 1, customers)) > weights.of(mid)
            low, high = np.where(up & (low < high), mid + 1, low), np.where(up | (low >= high), high, mid)
        t = low
    else:
        t = np.clip(before, 1, customers)
    weight = weights.of(t)
    for _ in range(STEPS):
        scale = np.exp(draw.random(len(t)) * 0.5 * np.log(customers))  # from 1 to the root of c, whatever t is
        step = np.rint(draw.standard_normal(len(t)) * scale).astype(np.int64)
        other = t + step
        fits = (step != 0) & (other >= 1) & (other <= customers)
        at = np.flatnonzero(fits)
        new = weights.of(other[at], at)
        take = np.log(draw.random(len(at))) < new - weight[at]
        t[at[take]], weight[at[take]] = other[at[take]], new[take]
    return t


def tables(customers: np.ndarray, x: np.ndarray, discount: float, draw: np.random.Generator, before: np.ndarray | None = None) -> np.ndarray:
    """Tables of dishes with a probability in proportion to S(customers, t) x^t each; none without customers."""
    out = np.minimum(customers, 1)
    some = np.flatnonzero((customers > 1) & (customers <= EXACT))
    out[some] = _small(customers[some], x[some], discount, draw)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        out[many] = _large(customers[many], x[many], discount, draw, None if before is None else before[many])
    return out
