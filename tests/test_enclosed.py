"""Enclosures of posteriors, evidences and acceptances against exact fractions and many digits."""

from decimal import Decimal, getcontext
from fractions import Fraction

import numpy as np
import pytest

from quillon.operators import certify, enclosed, envelope, grammar
from quillon.operators.gram import Prior, Stats, Structure, conjugate
from quillon.operators.grammar import Grammar

getcontext().prec = 60
PRIOR = Prior(0.25, 0.75, 3.0, 0.0625)
G = Grammar(1, 0.5)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1.5, 1.5, (8, 1))
    return x, 0.2 + 0.6 * x[:, 0] + rng.normal(0, 0.1, 8)


def keys():
    return sorted(G.quotient(5))


def exact(key, x, y, w):
    f = [sum(Fraction(c) * Fraction(float(v)) ** p[0] for p, c in key) for v in x[:, 0]]
    w, y = ([Fraction(float(v)) for v in a] for a in (w, y))
    p = Fraction(3, 4) + sum(a * b * b for a, b in zip(w, f, strict=True))
    info = sum(a * b * c for a, b, c in zip(w, f, y, strict=True)) + Fraction(3, 16)
    scale = Fraction(1, 16) + (sum(a * b * b for a, b in zip(w, y, strict=True)) + Fraction(3, 64) - info * info / p) / 2
    return p, info / p, 3 + sum(w) / 2, scale


def inside(i, v):
    return Fraction(float(i.lo)) <= v <= Fraction(float(i.hi))


def test_parameters_and_evidence(data):
    x, y = data
    pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")
    for w in (np.ones(8), np.array([1, 1, 1, 1, 0, 0, 0, 0.0])):
        for key in keys():
            got, want = enclosed.parameters(key, x, y, PRIOR, w), exact(key, x, y, w)
            assert all(inside(i, v) for i, v in zip((got.precision, got.mean, got.shape, got.scale), want, strict=True))
            n, (p, _, shape, scale) = int(w.sum()), want
            gamma = Decimal(1)
            for k in range(3, int(shape)):
                gamma *= k  # gamma(shape) over gamma(3), for whole shapes
            dec = lambda v: Decimal(v.numerator) / Decimal(v.denominator)
            log = -Decimal(n) / 2 * (2 * pi).ln() + (Decimal("0.75").ln() - dec(p).ln()) / 2 + 3 * Decimal("0.0625").ln() - dec(shape) * dec(scale).ln() + gamma.ln()
            e = enclosed.log_marginal(key, x, y, PRIOR, w)
            assert Decimal(float(e.lo)) <= log <= Decimal(float(e.hi)) and e.width < 1e-11
    with pytest.raises(ValueError):
        enclosed.log_marginal(keys()[0], x, y, Prior(0.0, 1.0, 3.0, -1.0))


def test_predictive(data):
    x, y = data
    new = np.linspace(-1, 1, 5)[:, None]
    for key in keys()[::4]:
        f = sum(c * x[:, 0] ** p[0] for p, c in key) * np.ones(8)
        post = conjugate(Structure("f", ("f",), 1.0), Stats(("f",), 8.0, np.array([[f @ f]]), np.array([f @ y]), float(y @ y)), PRIOR)
        post.probability = 1.0
        rows = (sum(c * new[:, 0] ** p[0] for p, c in key) * np.ones(5))[:, None]
        df, loc, scale = post.predict(rows)
        from quillon.functions import special

        got = enclosed.predictive(key, x, y, PRIOR, new, 0.3 * new[:, 0])
        assert (np.abs(special.t_cdf_array((0.3 * new[:, 0] - loc) / scale, df) - got.lo) < 1e-10).all() and got.width.max() < 1e-10


def test_acceptance(data):
    """Where the enclosure decides, the floating-point ratio says the same; at the ratio itself it doesn't decide."""
    x, y = data
    held = {}

    def of(key):
        if key not in held:
            held[key] = enclosed.log_marginal(key, x, y, PRIOR)
        return held[key]

    rng = np.random.default_rng(8)
    plain = envelope.class_evidence(x, y, PRIOR)
    for _ in range(60):
        e, new = G.draw(rng), G.draw(rng)
        if grammar.size(e) > 6 or grammar.size(new) > 6:
            continue
        u = float(rng.random())
        a = enclosed.acceptance(G, of, e, (), new, u)
        t = envelope.common_transition(G, plain, e, (), new)
        assert a.log_ratio.lo - 1e-9 <= t.log_acceptance <= a.log_ratio.hi + 1e-9 and a.log_ratio.width < 1e-10
        assert a.decided is bool(np.log(u) < t.log_acceptance) or abs(np.log(u) - t.log_acceptance) < 1e-9
    e, new = ("var", 0), ("one",)
    t = envelope.common_transition(G, plain, e, (), new)
    if t.log_acceptance < 0:
        assert enclosed.acceptance(G, of, e, (), new, float(np.exp(t.log_acceptance))).decided is None
    assert enclosed.acceptance(G, of, e, (), e, 0.5).decided is True


def test_bound_holds_for_enclosures(data):
    """No class's evidence exceeds the uniform bound, ends included."""
    x, y = data
    assert all(enclosed.log_marginal(k, x, y, PRIOR).hi <= certify.uniform_log_bound(8.0, PRIOR) for k in keys())
