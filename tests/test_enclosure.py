"""Enclosures against exact arithmetic and closed forms in many digits."""

import math
from decimal import Decimal, getcontext
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import enclosure as en
from quillon.functions import special
from quillon.operators import certify, gram
from quillon.operators.gram import Prior, generic_bank

getcontext().prec = 60


def inside(interval, k, exact):
    return Decimal(float(interval.lo[k])) <= exact <= Decimal(float(interval.hi[k]))


def test_arithmetic():
    """Every operation holds the exact result of fractions, ends of either sign."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=400) * 10.0 ** rng.integers(-8, 8, 400), rng.normal(size=400) * 10.0 ** rng.integers(-8, 8, 400)
    x, y = en.Interval.of(a), en.Interval.of(b)
    for got, f in ((x + y, lambda p, q: p + q), (x - y, lambda p, q: p - q), (x * y, lambda p, q: p * q), (x / y, lambda p, q: p / q), (x.square(), lambda p, q: p * p)):
        exact = [f(Fraction(float(p)), Fraction(float(q))) for p, q in zip(a, b, strict=True)]
        assert all(Fraction(float(lo)) <= e <= Fraction(float(hi)) for lo, hi, e in zip(got.lo, got.hi, exact, strict=True))
        assert (got.width <= 4 * np.spacing(np.maximum(np.abs(got.lo), np.abs(got.hi)))).all()
    wide = en.Interval(np.array([-1.0, 2.0]), np.array([3.0, 4.0]))
    assert (wide.square().lo == [0.0, np.nextafter(4.0, 0)]).all() and (wide * wide).lo[0] <= -3 and (wide - wide).holds(0).all()
    third = en.Interval.of(Fraction(1, 3))
    assert Fraction(float(third.lo)) < Fraction(1, 3) < Fraction(float(third.hi)) and en.Interval.of(Fraction(1, 4)).width == 0
    with pytest.raises(ZeroDivisionError):
        x / en.Interval(np.array(-1.0), np.array(1.0))
    with pytest.raises(ValueError):
        wide.log()


def test_log_exp_and_gamma():
    rng = np.random.default_rng(4)
    v = 10.0 ** rng.uniform(-5, 5, 200)
    logs, exps = en.Interval.of(v).log(), en.Interval.of(np.log(v)).exp()
    assert all(inside(logs, k, Decimal(float(p)).ln()) for k, p in enumerate(v))
    assert all(inside(exps, k, Decimal(float(p)).exp()) for k, p in enumerate(np.log(v)))
    n = np.arange(1.0, 30.0)
    g = en.log_gamma(en.Interval.of(n))
    assert all(inside(g, k, Decimal(math.factorial(k)).ln()) for k in range(len(n))) and g.width.max() < 1e-11
    half = en.log_gamma(en.Interval.of(np.array([0.5, 7.5])))
    pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")
    assert inside(half, 0, pi.ln() / 2) and inside(half, 1, pi.ln() / 2 + (Decimal(135135) / Decimal(128)).ln())


def test_t_cdf_closed_forms():
    """Two, four and six degrees of freedom have algebraic distribution functions."""
    z = np.concatenate((np.linspace(-12, 12, 301), [1e-9, -1e-9, 1e-120, 40.0, -40.0, 1e6, -1e6]))

    def exact(t, nu):
        t2 = t * t
        if nu == 2:
            return Decimal("0.5") + t / (2 * (2 + t2).sqrt())
        s = t / (nu + t2).sqrt()
        c2 = Decimal(nu) / (nu + t2)
        return Decimal("0.5") + s / 2 * (1 + c2 / 2 + (c2 * c2 * 3 / 8 if nu == 6 else 0))

    for nu in (2, 4, 6):
        got = en.t_cdf(z, np.full(len(z), float(nu)))
        assert all(inside(got, k, exact(Decimal(float(t)), nu)) for k, t in enumerate(z)) and got.width.max() < 2e-12
        assert (got.lo >= 0).all() and (got.hi <= 1).all()


def test_t_cdf_intervals():
    rng = np.random.default_rng(5)
    z, nu = rng.normal(0, 3, 500), rng.uniform(0.7, 150, 500)
    got = en.t_cdf(z, nu)
    assert got.width.max() < 1e-11 and (np.abs(special.t_cdf_array(z, nu) - got.lo) < 1e-11).all()
    wide = en.t_cdf(en.Interval(z - 0.1, z + 0.1), en.Interval.of(nu))
    assert (wide.lo <= got.lo).all() and (wide.hi >= got.hi).all() and (wide.width > got.width).mean() > 0.95
    far = en.t_cdf(np.array([-1e200, 1e200, 0.0]), np.full(3, 2.0))
    assert far.lo[0] == 0 and far.hi[1] == 1 and far.lo[2] == far.hi[2] == 0.5
    with pytest.raises(ValueError):
        en.t_cdf(np.array([np.nan]), np.array([2.0]))
    with pytest.raises(ValueError):
        en.t_cdf(np.array([1.0]), np.array([0.0]))


def test_posterior_oracle():
    """A bank's predictive probabilities lie in their enclosures."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 2))
    y = x[:, 0] + 0.1 * rng.normal(size=40)
    names = tuple(dict.fromkeys(t for b in generic_bank(2) for t in b.terms))
    d = gram.design_rows(x, names)
    posts = gram.bank_posterior(generic_bank(2), gram.Stats(names, 40.0, d.T @ d, d.T @ y, float(y @ y)), Prior())
    got = certify.PosteriorCdf(posts).cdf(x[:9], y[:9])
    assert (np.abs(gram.mixture_cdf(posts, x[:9], y[:9]) - got.lo) < 1e-11).all() and got.width.max() < 1e-11


def test_enclosed_columns(spark):
    df = spark.createDataFrame([(1, 0.5, 3.0), (2, None, 3.0), (3, float("nan"), 3.0), (4, 1.0, -1.0), (5, 2.0, 4.0)], "id int, z double, nu double")
    got = {r.id: r for r in certify.enclosed_t_cdf(df, F.col("z"), F.col("nu")).collect()}
    assert all(got[k].lower is None and got[k].upper is None for k in (2, 3, 4)) and got[1].z == 0.5
    exact = 0.5 + 2 * (4 + 6) / (2 * 8**1.5)  # four degrees of freedom: t (t^2 + 6) / (2 (t^2 + 4)^(3/2))
    assert got[5].lower - 1e-15 <= exact <= got[5].upper + 1e-15
