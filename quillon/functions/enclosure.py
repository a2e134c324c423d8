"""Enclosures: intervals of doubles that hold the exact value, and Student's t distribution function in them.

Sums, differences, products, quotients and roots are rounded outward by one unit in the last place, which covers their half unit of
rounding.  Of the platform's logarithm and exponential it is assumed that they are within ULPS units.  Everything
works on arrays; an interval is a pair of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np

#: Units in the last place by which results of log and exp are widened.
ULPS = 8
#: Where Stirling's series starts, how many of its terms are taken, and terms of a power series at most.
START, STIRLING, TERMS = 24.0, 9, 20_000


def _down(x: np.ndarray, ulps: int = 1) -> np.ndarray:
    for _ in range(ulps):
        x = np.nextafter(x, -np.inf)
    return x


def _up(x: np.ndarray, ulps: int = 1) -> np.ndarray:
    for _ in range(ulps):
        x = np.nextafter(x, np.inf)
    return x


@dataclass(frozen=True)
class Interval:
    """Lower and upper ends; operations with a number take it as exact."""

    lo: np.ndarray
    hi: np.ndarray

    @staticmethod
    def of(x) -> Interval:
        if isinstance(x, Interval):
            return x
        if isinstance(x, Fraction):
            near = np.float64(x.numerator / x.denominator)
            return Interval(near, near) if Fraction(float(near)) == x else Interval(_down(near), _up(near))
        x = np.asarray(x, float)
        return Interval(x, x)

    def __add__(self, other) -> Interval:
        o = Interval.of(other)
        return Interval(_down(self.lo + o.lo), _up(self.hi + o.hi))

    __radd__ = __add__

    def __neg__(self) -> Interval:
        return Interval(-self.hi, -self.lo)

    def __sub__(self, other) -> Interval:
        return self + -Interval.of(other)

    def __rsub__(self, other) -> Interval:
        return Interval.of(other) + -self

    def __mul__(self, other) -> Interval:
        o = Interval.of(other)
        ends = [a * b for a in (self.lo, self.hi) for b in (o.lo, o.hi)]
        return Interval(_down(np.minimum.reduce(np.broadcast_arrays(*ends))), _up(np.maximum.reduce(np.broadcast_arrays(*ends))))

    __rmul__ = __mul__

    def __truediv__(self, other) -> Interval:
        o = Interval.of(other)
        if np.any((o.lo <= 0) & (o.hi >= 0)):
            raise ZeroDivisionError("the divisor may be zero")
        ends = [a / b for a in (self.lo, self.hi) for b in (o.lo, o.hi)]
        return Interval(_down(np.minimum.reduce(np.broadcast_arrays(*ends))), _up(np.maximum.reduce(np.broadcast_arrays(*ends))))

    def __rtruediv__(self, other) -> Interval:
        return Interval.of(other) / self

    def square(self) -> Interval:
        a, b = self.lo * self.lo, self.hi * self.hi
        return Interval(np.where((self.lo <= 0) & (self.hi >= 0), 0.0, np.maximum(_down(np.minimum(a, b)), 0.0)), _up(np.maximum(a, b)))

    def sqrt(self) -> Interval:
        return Interval(np.maximum(_down(np.sqrt(np.maximum(self.lo, 0.0))), 0.0), _up(np.sqrt(self.hi)))

    def log(self) -> Interval:
        if np.any(self.lo <= 0):
            raise ValueError("the logarithm of what may not be positive")
        return Interval(_down(np.log(self.lo), ULPS), _up(np.log(self.hi), ULPS))

    def exp(self) -> Interval:
        return Interval(np.maximum(_down(np.exp(self.lo), ULPS), 0.0), _up(np.exp(self.hi), ULPS))

    def clip(self, low: float, high: float) -> Interval:
        return Interval(np.clip(self.lo, low, high), np.clip(self.hi, low, high))

    @property
    def width(self) -> np.ndarray:
        return self.hi - self.lo

    def holds(self, x) -> np.ndarray:
        return (self.lo <= x) & (x <= self.hi)


def _bernoulli(n: int) -> list[Fraction]:
    """B_0 to B_n by their recurrence."""
    out: list[Fraction] = []
    for m in range(n + 1):
        out.append(Fraction(1) if m == 0 else -sum((math.comb(m + 1, k) * out[k] for k in range(m)), Fraction(0)) / (m + 1))
    return out


_SERIES = [b / (2 * k * (2 * k - 1)) for k, b in enumerate(_bernoulli(2 * STIRLING + 2)[::2]) if k]


def log_gamma(x: Interval) -> Interval:
    """Logarithm of the gamma function of positive arguments: moved up by its recurrence, then Stirling's series, whose error has the size of the next term at most."""
    if np.any(x.lo <= 0):
        raise ValueError("the argument must be positive")
    moved, steps = Interval.of(np.zeros(np.shape(x.lo))), int(max(0, math.ceil(START - float(np.min(x.lo)))))
    for _ in range(steps):
        moved, x = moved + x.log(), x + 1.0
    half_log = ((Interval.of(2.0) * Interval(_down(np.float64(np.pi)), _up(np.float64(np.pi)))).log()) * 0.5
    out = (x - 0.5) * x.log() - x + half_log
    power = Interval.of(1.0) / x
    inverse = power * power
    for c in _SERIES[:STIRLING]:
        out, power = out + Interval.of(c) * power, power * inverse
    rest = Interval.of(abs(_SERIES[STIRLING])) * power
    return out + Interval(-rest.hi, rest.hi) - moved


def _series(ratio_top: Interval, ratio_bottom: Interval, x: Interval) -> Interval:
    """The sum over n of x^n times the product of (top + k)/(bottom + k): positive terms; what is left out is bounded by a geometric series once ratios fall."""
    shape = np.broadcast(ratio_top.lo, x.lo).shape
    term = Interval.of(np.ones(shape))
    total = Interval.of(np.zeros(shape))
    for n in range(TERMS):
        total = total + term
        step = x * ((ratio_top + float(n)) / (ratio_bottom + float(n)))
        term = term * step
        # Ratios (t + k)/(b + k) go to 1 from one side, so later ones are at most the larger of this one and x.
        most = np.maximum(step.hi, x.hi)
        if np.all((most < 0.999) & (term.hi <= np.maximum(total.lo, 1e-300) * 2.0**-56)):
            rest = term / (1.0 - Interval.of(most))
            return Interval(total.lo, (total + rest).hi)
    raise ArithmeticError("the series didn't end")


#: Arguments beyond which, and under which, powers leave the range of doubles.
LARGEST, LEAST = 1e100, 1e-100


def t_cdf(z: Interval, df: Interval) -> Interval:
    """Enclosure of Student's t distribution function, whose argument and (positive) degrees of freedom may be intervals.

    Monotone in z, so the ends of z are enclosed by themselves; degrees of freedom enter as they are.
    """
    z, df = Interval.of(z), Interval.of(df)
    if np.any(df.lo <= 0) or not (np.all(np.isfinite(z.lo)) and np.all(np.isfinite(z.hi)) and np.all(np.isfinite(df.hi))):
        raise ValueError("finite arguments and positive degrees of freedom are needed")
    return Interval(_point_cdf(z.lo, df).lo, _point_cdf(z.hi, df).hi)


def _point_cdf(z: np.ndarray, df: Interval) -> Interval:
    z = np.atleast_1d(np.asarray(z, float))
    df = Interval(*(np.broadcast_to(v, z.shape) for v in (df.lo, df.hi)))
    if np.any(np.abs(z) > LARGEST):  # monotone: the ends are those of the largest argument
        inside = _point_cdf(np.clip(z, -LARGEST, LARGEST), df)
        return Interval(np.where(z < -LARGEST, 0.0, inside.lo), np.where(z > LARGEST, 1.0, inside.hi))
    # The density is under 1/2, so next to 0 the value is next to 1/2.
    lo, hi = np.where(z < 0, _down(np.float64(0.5)), 0.5), np.where(z > 0, _up(np.float64(0.5)), 0.5)
    r = Interval.of(z).square() / df
    x, rest = 1.0 / (r + 1.0), r / (r + 1.0)
    near = (rest.hi < 0.5) & (np.abs(z) > LEAST)
    far = (rest.hi >= 0.5)
    for part, inner in ((near, True), (far, False)):
        if not part.any():
            continue
        a, p, q = (Interval(v.lo[part], v.hi[part]) for v in (df * 0.5, x, rest))
        # The power of x and the root of its complement over the beta function, by logarithms.
        front = (a * p.log() + q.log() * 0.5 + log_gamma(a + 0.5) - log_gamma(a) - log_gamma(Interval.of(np.full(a.lo.shape, 0.5)))).exp()
        if inner:  # from the middle: the complement's series
            half = front * _series(a + 0.5, Interval.of(1.5), q)
            up = half.clip(0.0, 0.5) + 0.5
        else:
            tail = (front / a * _series(a + 0.5, a + 1.0, p) * 0.5).clip(0.0, 0.5)
            up = 1.0 - tail
        down = 1.0 - up
        above = z[part] > 0
        lo[part] = np.where(above, up.lo, down.lo)
        hi[part] = np.where(above, up.hi, down.hi)
    return Interval(np.clip(lo, 0.0, 1.0), np.clip(hi, 0.0, 1.0))


def mixture_cdf(weights: list[Interval], parts: list[Interval]) -> Interval:
    """Enclosure of a mixture from enclosures of its weights and of its parts."""
    out = Interval.of(0.0)
    for w, p in zip(weights, parts, strict=True):
        out = out + Interval.of(w) * p
    return out.clip(0.0, 1.0)
