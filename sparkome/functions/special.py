"""Distribution functions and exact tests from their published formulas, on numpy and math alone."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_ppf(p: float) -> float:
    if not 0 < p < 1:
        return math.nan if not 0 <= p <= 1 else math.inf * (1 if p else -1)
    return _NORMAL.inv_cdf(p)


def gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma: a series below a + 1, else Lentz's continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    if math.isnan(x) or x < 0:
        return math.nan
    return math.erfc(math.sqrt(x / 2)) if df == 1 else gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    return beta_i(df / 2, 0.5, df / (df + t * t))


def beta_ppf(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_i(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def skew_test(g1: float, n: int) -> tuple[float, float]:
    """D'Agostino's test of the population skewness: z and two-sided p, NaN below 8 values."""
    if n < 8 or math.isnan(g1):
        return math.nan, math.nan
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    z = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(math.sqrt(w2)))
    return z, 2 * norm_sf(abs(z))


def hwe_exact(hets: int, hom1: int, hom2: int) -> float:
    """Exact test of Hardy-Weinberg proportions: the chance of heterozygote counts that are no likelier than the one observed."""
    n, rare = hets + hom1 + hom2, 2 * min(hom1, hom2) + hets
    if n == 0:
        return math.nan
    k = np.arange(rare % 2, rare + 1, 2)
    log = lambda x: np.array([math.lgamma(v + 1) for v in np.atleast_1d(x)])
    weight = k * math.log(2) - log((rare - k) // 2) - log(k) - log(n - (rare + k) // 2)
    p = np.exp(weight - weight.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[k == hets][0] * (1 + 1e-9)].sum()))


def hommel(p: np.ndarray) -> np.ndarray:
    """Hommel's adjusted p-values: the closed Simes procedure, by its stepwise form."""
    p = np.asarray(p, float)
    n = len(p)
    order = np.argsort(p, kind="stable")
    s = p[order]
    best = np.full(n, np.min(n * s / np.arange(1, n + 1))) if n else s
    adjusted = best.copy()
    for m in range(n - 1, 1, -1):
        low, high = np.arange(n - m + 1), np.arange(n - m + 1, n)
        c = np.min(m * s[high] / np.arange(2, m + 1))
        q = np.empty(n)
        q[low] = np.minimum(m * s[low], c)
        q[high] = q[n - m]
        adjusted = np.maximum(adjusted, q)
    out = np.empty(n)
    out[order] = np.minimum(1, np.maximum(adjusted, s))
    return out


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b in n log n: sort by x, count the exchanges that sort y, correct for ties."""
    n = len(x)
    if n < 2:
        return math.nan
    order = np.lexsort((y, x))
    x, y = np.asarray(x)[order], np.asarray(y)[order]
    pairs = lambda *cols: sum(c * (c - 1) // 2 for c in np.unique(np.stack(cols), axis=1, return_counts=True)[1].tolist())

    def swaps(v: np.ndarray) -> tuple[np.ndarray, int]:
        if len(v) < 2:
            return v, 0
        (a, i), (b, j) = swaps(v[: len(v) // 2]), swaps(v[len(v) // 2 :])
        over = int((len(a) - np.searchsorted(a, b, "right")).sum())
        return np.sort(np.concatenate([a, b]), kind="stable"), i + j + over

    total, tx, ty, both = n * (n - 1) // 2, pairs(x), pairs(y), pairs(x, y)
    below = math.sqrt((total - tx)) * math.sqrt((total - ty))
    return (total - tx - ty + both - 2 * swaps(y)[1]) / below if below else math.nan
