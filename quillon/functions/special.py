"""Special functions for the kernels that run on small arrays: Student's t, digamma, Gauss rules."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])


def digamma(x: float) -> float:
    """Recurrence up to 8, then the asymptotic series."""
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz scheme."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def t_logpdf(y, df, loc, scale):
    z = (y - loc) / scale
    return lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * np.log(df * np.pi) - np.log(scale) - (df + 1) / 2 * np.log1p(z * z / df)


def _t_cdf(z: float, df: float) -> float:
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + z * z))
    return 1 - tail if z > 0 else tail


t_cdf = np.vectorize(_t_cdf, otypes=[float])


def _fractions(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction for arrays; what has converged leaves the loop."""
    out, live = np.empty(len(x)), np.arange(len(x))
    c, d = np.ones(len(x)), 1 / (1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h = h * (d * c)
        on = np.abs(d * c - 1) >= 1e-15
        if not on.all() or m == 499:
            out[live] = h
            if not on.any():
                break
            live, a, b, x, c, d, h = (v[on] for v in (live, a, b, x, c, d, h))
    return out


def t_cdf_array(z: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student's t distribution function, element by element, by the incomplete beta function on its fast side."""
    z, df = np.broadcast_arrays(np.asarray(z, float), np.asarray(df, float))
    with np.errstate(over="ignore", divide="ignore"):
        r = ((z / np.sqrt(df)) ** 2).ravel()
        a, x, rest = df.ravel() / 2, 1 / (1 + r), 1 / (1 + 1 / r)
    tail = np.where(rest <= 0, 1.0, 0.0)
    inner = (x > 0) & (rest > 0)
    a, x, rest = a[inner], x[inner], rest[inner]
    front = np.exp(lgamma(a + 0.5) - lgamma(a) - lgamma(0.5) + a * np.log(x) + 0.5 * np.log(rest)) if len(a) else a
    near = x < (a + 1) / (a + 2.5)
    held, half = np.empty(len(a)), np.full(len(a), 0.5)
    held[near] = front[near] * _fractions(a[near], half[near], x[near]) / a[near]
    held[~near] = 1 - front[~near] * _fractions(half[~near], a[~near], rest[~near]) / 0.5
    tail[inner] = held
    tail = 0.5 * tail.reshape(z.shape)
    return np.where(z > 0, 1 - tail, tail)


@lru_cache(maxsize=4096)
def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on its distribution function."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1 - p, df)
    lo, hi = 0.0, 1.0
    while _t_cdf(hi, df) < p:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if _t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def norm_ppf(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


@lru_cache(maxsize=512)
def gauss_jacobi(n: int, alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and normalised weights on (-1, 1), from the eigenvalues of the recurrence matrix."""
    k = np.arange(n, dtype=float)
    ab = alpha + beta
    with np.errstate(divide="ignore", invalid="ignore"):
        diag = (beta**2 - alpha**2) / ((2 * k + ab) * (2 * k + ab + 2))
    diag[0] = (beta - alpha) / (ab + 2)
    j = np.arange(1, n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        off = 4 * j * (j + alpha) * (j + beta) * (j + ab) / ((2 * j + ab) ** 2 * (2 * j + ab + 1) * (2 * j + ab - 1))
    if n > 1:
        off[0] = 4 * (1 + alpha) * (1 + beta) / ((2 + ab) ** 2 * (3 + ab))
    m = np.diag(diag) + np.diag(np.sqrt(off), 1) + np.diag(np.sqrt(off), -1)
    x, v = np.linalg.eigh(m)
    return x, v[0] ** 2


def student_nodes(df: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes z and weights for expectations under the standard t of df degrees of freedom."""
    x, w = gauss_jacobi(order, -0.5, df / 2 - 1)
    b = (1 + x) / 2
    z = np.sqrt(df * (1 - b) / b)
    w = w / w.sum() / 2
    return np.concatenate([-z[::-1], z]), np.concatenate([w[::-1], w])


@lru_cache(maxsize=4)
def _legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def integrate(f, a: float, b: float, tol: float = 1e-10, depth: int = 40) -> float:
    """Adaptive quadrature: a 15-point rule against its two halves."""
    x, w = _legendre(15)

    def rule(lo: float, hi: float) -> float:
        return float((hi - lo) / 2 * np.sum(w * f((hi + lo) / 2 + (hi - lo) / 2 * x)))

    todo, total = [(a, b, rule(a, b), 0)], 0.0
    while todo:
        lo, hi, whole, level = todo.pop()
        mid = (lo + hi) / 2
        left, right = rule(lo, mid), rule(mid, hi)
        if abs(left + right - whole) <= tol * max(1.0, abs(total)) or level >= depth:
            total += left + right
        else:
            todo += [(lo, mid, left, level + 1), (mid, hi, right, level + 1)]
    return total
