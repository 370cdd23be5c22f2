"""Incomplete gamma function and its inverse, for exact Poisson limits and chi-square tails."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _log_density(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a log x - x - log Gamma(a), by Stirling's series for large a to avoid cancellation."""
    u = x / a
    with np.errstate(divide="ignore"):
        large = (
            a * (np.log(u) - (u - 1))
            + 0.5 * np.log(a / (2 * math.pi))
            - 1 / (12 * a)
            + 1 / (360 * a**3)
        )
        small = a * np.log(x) - x - _lgamma(np.minimum(a, 1e3))
    return np.where(a > 1e3, large, small)


def gamma_tails(a, x) -> tuple[np.ndarray, np.ndarray]:
    """Regularised incomplete gamma functions P(a, x) and Q(a, x) = 1 - P for a > 0, x >= 0.

    Each is computed where it is the small one, so small tails keep their precision.
    """
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    lower, upper = np.zeros(a.shape), np.ones(a.shape)
    positive = x > 0
    series = positive & (x < a + 1)
    if series.any():
        aa, xx = a[series], x[series]
        term = 1 / aa
        total, k = term.copy(), aa.copy()
        while True:
            k = k + 1
            term = term * xx / k
            total = total + term
            if (term <= total * 1e-17).all():
                break
        lower[series] = np.exp(_log_density(aa, xx)) * total
        upper[series] = 1 - lower[series]
    fraction = positive & ~series
    if fraction.any():
        aa, xx = a[fraction], x[fraction]
        tiny = 1e-300
        b = xx + 1 - aa
        c = np.full_like(xx, 1 / tiny)
        d = 1 / b
        h = d.copy()
        i = 0
        while True:
            i += 1
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = d * c
            h = h * delta
            if (np.abs(delta - 1) < 1e-15).all():
                break
        upper[fraction] = np.exp(_log_density(aa, xx)) * h
        lower[fraction] = 1 - upper[fraction]
    return lower, upper


def gamma_quantile(p: float, a) -> np.ndarray:
    """x with P(a, x) = p: Newton steps kept inside a shrinking bracket."""
    a = np.asarray(a, float)
    z = NormalDist().inv_cdf(p)
    guess = a * np.maximum(1 - 1 / (9 * a) + z / (3 * np.sqrt(a)), 1e-3) ** 3
    x = np.where(a < 1, np.maximum(guess, np.exp((np.log(p) + _lgamma(np.minimum(a, 2.0) + 1)) / a)), guess)
    lo, hi = np.zeros_like(x), np.full_like(x, np.inf)
    for _ in range(200):
        gap = gamma_tails(a, x)[0] - p
        lo, hi = np.where(gap < 0, x, lo), np.where(gap >= 0, x, hi)
        density = np.exp(_log_density(a, x)) / x
        with np.errstate(divide="ignore", invalid="ignore"):
            new = x - gap / density
        middle = np.where(np.isinf(hi), 2 * x, (lo + hi) / 2)
        new = np.where((new > lo) & (new < hi), new, middle)
        done = np.abs(new - x) <= 1e-14 * x
        x = new
        if done.all():
            break
    return x


def poisson_limits(events, level: float = 0.95, floor_events: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Exact limits for a Poisson mean; events may be weighted sums. The lower limit of 0 is 0."""
    x = np.asarray(events, float)
    if floor_events:
        x = np.floor(x)
    tail = (1 - level) / 2
    lower = np.where(x > 0, gamma_quantile(tail, np.where(x > 0, x, 1.0)), 0.0)
    return lower, gamma_quantile(1 - tail, x + 1)


def chi2_tail(x, df) -> np.ndarray:
    """Upper tail of the chi-square distribution."""
    return gamma_tails(np.asarray(df, float) / 2, np.asarray(x, float) / 2)[1]
