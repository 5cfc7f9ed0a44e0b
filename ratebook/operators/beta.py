"""Laws of order statistics of draws with replacement, on numpy arrays."""

from __future__ import annotations

import math

import numpy as np

_EXACT = 16


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """lgamma(z) less (z - 1/2) ln z - z + ln(2 pi) / 2, for whole z from 1."""
    small = np.array([0.0] + [math.lgamma(k) - ((k - 0.5) * math.log(k) - k + 0.5 * math.log(2 * math.pi)) for k in range(1, _EXACT)])
    i = 1.0 / z
    series = i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680)))
    return np.where(z < _EXACT, small[np.minimum(z, _EXACT - 1).astype("int64")], series)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, from its front on."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    m = 0
    while True:
        m += 1
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out *= c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15) or m > 200 + 20 * math.sqrt(float(np.max(a + b))):
            return out


def at_most(place: np.ndarray, n: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n draws from positions 1..n: P(at least r are <= place), P(exactly r are).

    ``r`` is 1..n. The logarithms are taken of the distance to the mode, so that nothing
    of order n cancels.
    """
    least = np.where(place >= n, 1.0, 0.0)
    exact = np.where((place >= n) & (r >= n), 1.0, 0.0)
    inside = (place > 0) & (place < n)
    if not inside.any():
        return least, exact
    p, n, r = place[inside], n[inside], r[inside]
    x, a, b = p / n, r, n - r + 1
    s = a + b
    off = x * s - a
    front = np.sqrt(a * b / (2 * math.pi * s)) * np.exp(
        a * np.log1p(off / a) + b * np.log1p(-off / b) + _stirling_rest(s) - _stirling_rest(a) - _stirling_rest(b)
    )
    low = x < (a + 1) / (s + 2)
    one, other = np.where(low, a, b), np.where(low, b, a)
    tail = front * _fraction(one, other, np.where(low, x, 1 - x)) / one
    least[inside] = np.where(low, tail, 1 - tail)
    exact[inside] = front / (a * (1 - x))
    return least, exact
