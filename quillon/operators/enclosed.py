"""Enclosures of a class's posterior over the open target: parameters, log evidence at a bridge, predictive probabilities and acceptances.

Responses, actions, powers and the prior are taken as they are; every sum and function after them is rounded outward.
Classes have one amplitude, so all is scalar.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np

from quillon.functions.enclosure import Interval, log_gamma, t_cdf
from quillon.operators import grammar
from quillon.operators.gram import Prior
from quillon.operators.grammar import Grammar


def polynomial(key: tuple, x: np.ndarray) -> Interval:
    """A class's function at rows of actions."""
    total = Interval.of(np.zeros(len(x)))
    for powers, c in key:
        term = Interval.of(np.full(len(x), float(c)))
        for k, p in enumerate(powers):
            for _ in range(p):
                term = term * x[:, k]
        total = total + term
    return total


def _sum(v: Interval) -> Interval:
    """Of a few rows, one after the other."""
    total = Interval.of(0.0)
    for lo, hi in zip(np.atleast_1d(v.lo), np.atleast_1d(v.hi), strict=True):
        total = total + Interval(lo, hi)
    return total


@dataclass(frozen=True)
class Parameters:
    """Enclosures of the amplitude's precision and mean, and of the noise's shape and scale."""

    precision: Interval
    mean: Interval
    shape: Interval
    scale: Interval
    n: Interval


def parameters(key: tuple, x: np.ndarray, y: np.ndarray, prior: Prior, powers: np.ndarray | None = None) -> Parameters:
    """The posterior of a class given responses with likelihood powers, 1 where None."""
    w = np.ones(len(y)) if powers is None else np.asarray(powers, float)
    f = polynomial(key, x)
    n = _sum(Interval.of(w))
    precision = _sum(f.square() * w) + prior.precision
    info = _sum(f * w * y) + Interval.of(prior.precision) * prior.mean
    start = Interval.of(prior.mean).square() * prior.precision
    scale = (_sum(Interval.of(y).square() * w) + start - info.square() / precision) * 0.5 + prior.scale
    return Parameters(precision, info / precision, n * 0.5 + prior.shape, scale, n)


def log_marginal(key: tuple, x: np.ndarray, y: np.ndarray, prior: Prior, powers: np.ndarray | None = None) -> Interval:
    """The log evidence of a class at those powers."""
    p = parameters(key, x, y, prior, powers)
    if np.any(p.scale.lo <= 0):
        raise ArithmeticError("the scale's enclosure reaches zero")
    two_pi = Interval(np.nextafter(2 * np.pi, 0), np.nextafter(2 * np.pi, 7))
    out = -(p.n * 0.5 * two_pi.log()) + (Interval.of(prior.precision).log() - p.precision.log()) * 0.5 + Interval.of(prior.shape) * Interval.of(prior.scale).log() - p.shape * p.scale.log()
    return out + log_gamma(p.shape) - log_gamma(Interval.of(prior.shape))


def predictive(key: tuple, x: np.ndarray, y: np.ndarray, prior: Prior, new_x: np.ndarray, new_y: np.ndarray, powers: np.ndarray | None = None) -> Interval:
    """P(Y <= y) at new actions, by the class's posterior."""
    p, f = parameters(key, x, y, prior, powers), polynomial(key, new_x)
    spread = (f.square() / p.precision + 1.0) * p.scale / p.shape
    z = (Interval.of(new_y) - f * p.mean) / spread.sqrt()
    df = p.shape * 2.0
    return t_cdf(z, Interval(np.broadcast_to(df.lo, z.lo.shape), np.broadcast_to(df.hi, z.hi.shape)))


@dataclass(frozen=True)
class Acceptance:
    """A move's log acceptance, and whether a uniform number accepts it: True, False, or None where the enclosure can't say."""

    log_ratio: Interval
    decided: bool | None


def acceptance(g: Grammar, evidence, e: tuple, site: tuple[int, ...], new: tuple, u: float) -> Acceptance:
    """The regenerated subtree's move against the common target.  evidence: from a class key to an Interval of its log evidence."""
    proposed, _, _ = grammar.subtree_proposal(g, e, site, new)
    old = e
    for k in site:
        old = old[k]
    a, b = (evidence(grammar.polynomial_key(t, g.d)) for t in (proposed, e))
    # Prior and proposal masses are rationals: their ratio is exact before its logarithm.
    prior = _mass(g, proposed) / _mass(g, e)
    moves = (_mass(g, old) / grammar.size(proposed)) / (_mass(g, new) / grammar.size(e))
    log_ratio = a - b + Interval.of(prior * moves).log()
    log_u = Interval.of(u).log() if u > 0 else Interval.of(-math.inf)
    decided = True if log_u.hi < log_ratio.lo else False if log_u.lo > log_ratio.hi else None
    return Acceptance(Interval(np.minimum(log_ratio.lo, 0.0), np.minimum(log_ratio.hi, 0.0)), decided)


def _mass(g: Grammar, e: tuple) -> Fraction:
    n, rho = grammar.size(e), Fraction(g.rho)
    return (1 - rho) * rho ** (n - 1) / g.count(n)
