"""Exact draws from an envelope of the whole open target, and moves against that target.

The envelope weighs each listed class by its prior mass and evidence, and all that isn't listed by the grammar's tail mass
and an upper bound of the evidence.  A draw picks a class or the tail by cumulative probability; a class is lifted to
one of its expressions by exact ranks, the tail gives a size beyond the list and a uniform rank in that shell.  Both
log masses come with the draw, so it serves as an independence proposal: a listed draw's target over its proposal is one constant, a tail draw's is less.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillon.operators import grammar
from quillon.operators.certify import uniform_log_bound
from quillon.operators.gram import Prior, Stats, Structure, conjugate
from quillon.operators.grammar import Grammar, _below


@dataclass(frozen=True)
class Draw:
    """An expression, whether it is listed, and the logs of its unnormalised target mass and of its probability as a proposal."""

    expression: tuple
    listed: bool
    log_target: float
    log_proposal: float


class Envelope:
    """evidence: log evidence of a class key; log_bound: of every evidence that isn't listed."""

    def __init__(self, g: Grammar, most: int, evidence: Callable[[tuple], float], log_bound: float):
        self.g, self.most, self.evidence, self.log_bound = g, most, evidence, log_bound
        self.keys = sorted(g.quotient(most))
        self.sizes = {k: [(n, g.shell(n)[k]) for n in range(1, most + 1) if k in g.shell(n)] for k in self.keys}
        self.log_mass = {k: math.log(math.fsum(m * g.prior(n) for n, m in self.sizes[k])) for k in self.keys}
        logs = np.array([self.log_mass[k] + evidence(k) for k in self.keys] + [most * math.log(g.rho) + log_bound])
        self.log_total = float(np.logaddexp.reduce(logs))
        self.upto = np.cumsum(np.exp(logs - self.log_total))
        self.upto[-1] = 1.0

    @property
    def listed_probability(self) -> float:
        return float(self.upto[-2])

    def masses(self, e: tuple) -> Draw:
        """Both log masses of any expression."""
        n = grammar.size(e)
        prior = math.log(self.g.prior(n))
        own = self.evidence(grammar.polynomial_key(e, self.g.d))
        return Draw(e, n <= self.most, prior + own, prior + (own if n <= self.most else self.log_bound) - self.log_total)

    def lift(self, key: tuple, rng: np.random.Generator) -> tuple:
        """An expression of a class by its prior within the class."""
        u, total = rng.random(), math.exp(self.log_mass[key])
        for n, m in self.sizes[key]:
            u -= m * self.g.prior(n) / total
            if u < 0 or n == self.sizes[key][-1][0]:
                return self.g.unrank_in_class(n, key, _below(rng, m))
        raise AssertionError

    def draw(self, rng: np.random.Generator) -> Draw:
        k = int(np.searchsorted(self.upto, rng.random(), "right"))
        return self.masses(self.g.draw(rng, self.most) if k >= len(self.keys) else self.lift(self.keys[k], rng))


def independence_log_acceptance(current: Draw, proposed: Draw) -> float:
    """Metropolis-Hastings acceptance of an envelope's draw."""
    return grammar.independence_log_acceptance(current.log_target, proposed.log_target, current.log_proposal, proposed.log_proposal)


@dataclass(frozen=True)
class Transition:
    """A regenerated subtree judged by the common target: both endpoints, both proposal masses, the acceptance."""

    current: tuple
    proposed: tuple
    log_target_current: float
    log_target_proposed: float
    forward: float
    reverse: float
    log_acceptance: float


def common_transition(g: Grammar, evidence: Callable[[tuple], float], e: tuple, site: tuple[int, ...], new: tuple) -> Transition:
    """The move that replaces the subtree at a site, against the same target as every other move: prior times evidence of the class."""
    proposed, forward, reverse = grammar.subtree_proposal(g, e, site, new)
    here, there = (math.log(g.prior(grammar.size(x))) + evidence(grammar.polynomial_key(x, g.d)) for x in (e, proposed))
    back = grammar.subtree_proposal(g, proposed, site, _subtree(e, site))
    if back[0] != e or not math.isclose(back[1], reverse, rel_tol=1e-12):
        raise ArithmeticError("the reverse proposal doesn't lead back")
    return Transition(e, proposed, here, there, forward, reverse, grammar.mh_log_acceptance(here, there, forward, reverse))


def _subtree(e: tuple, site: tuple[int, ...]) -> tuple:
    for k in site:
        e = e[k]
    return e


def chain(env: Envelope, start: tuple, steps: int, rng: np.random.Generator, local: float = 0.5) -> tuple[list[tuple], int]:
    """States of a chain on the whole open target that mixes envelope draws and regenerated subtrees, and how many moves it made."""
    from quillon.operators.openmc import sites

    e, out, moved = start, [], 0
    for _ in range(steps):
        if rng.random() < local:
            where = sites(e)
            t = common_transition(env.g, env.evidence, e, where[int(rng.integers(len(where)))], env.g.draw(rng))
            new, log_a = t.proposed, t.log_acceptance
        else:
            d = env.draw(rng)
            new, log_a = d.expression, independence_log_acceptance(env.masses(e), d)
        if math.log(rng.random()) < log_a:
            moved += new != e
            e = new
        out.append(e)
    return out, moved


def draws(spark: SparkSession, g: Grammar, most: int, x: np.ndarray, y: np.ndarray, prior: Prior, n: int, seeds: int) -> DataFrame:
    """(seed, listed, size, log_target, log_proposal, log_total) of n draws for each of `seeds` streams, over a registered design of few rows."""
    names = ["seed", "listed", "size", "log_target", "log_proposal", "log_total"]
    x, y, d, rho = np.asarray(x, float).reshape(len(y), -1), np.asarray(y, float), g.d, g.rho

    def some(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        env = Envelope(Grammar(d, rho), most, class_evidence(x, y, prior), uniform_log_bound(float(len(y)), prior))
        for part in parts:
            for seed in part["id"]:
                rng = np.random.default_rng(int(seed))
                got = [env.draw(rng) for _ in range(n)]
                yield pd.DataFrame([(int(seed), v.listed, grammar.size(v.expression), v.log_target, v.log_proposal, env.log_total) for v in got], columns=names)

    return spark.range(seeds).repartition(seeds).mapInPandas(some, "seed long, listed boolean, size int, log_target double, log_proposal double, log_total double")


def class_evidence(x: np.ndarray, y: np.ndarray, prior: Prior) -> Callable[[tuple], float]:
    """Log evidence of a class key on a design of few rows; what was asked before is kept."""
    held: dict[tuple, float] = {}

    def of(key: tuple) -> float:
        if key not in held:
            f = sum((c * np.prod(x ** np.array(p), axis=1) for p, c in key), np.zeros(len(y)))
            held[key] = conjugate(Structure("f", ("f",), 1.0), Stats(("f",), float(len(y)), np.array([[f @ f]]), np.array([f @ y]), float(y @ y)), prior).log_evidence
        return held[key]

    return of
