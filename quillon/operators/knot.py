"""Populations over a finite slice of the open grammar whose last move of each row is a two-branch knot.

Before the last potential of a row every particle makes one uniform proposal over the slice, so it has two branches: to stay
or to move.  The standard way draws a branch by its acceptance and weighs it by the potential.  The knot weighs the
particle by the mean potential of its branches and draws the branch from acceptance times potential, which
takes the noise of the acceptance out of the weights.  All ways make the same proposals and evaluate the same number
of potentials.  The conditional way leaves the last row's move standard but keeps both branches, weighted, for what is
estimated at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import grammar
from quillon.operators.gram import Prior
from quillon.operators.grammar import Grammar
from quillon.operators.smc import systematic

METHODS = ("standard", "knot", "nonterminal", "conditional")
BETAS = (0.25, 0.5, 1.0)


class Slice:
    """Expressions up to a size with their prior within the slice, and log evidences of all of them at any prefix and power."""

    def __init__(self, g: Grammar, most: int, x: np.ndarray, y: np.ndarray, prior: Prior):
        x = np.asarray(x, float).reshape(len(y), -1)
        listed = [(n, e) for n in range(1, most + 1) for e in g.expressions(n)]
        self.expressions = [e for _, e in listed]
        self.y, self.prior = np.asarray(y, float), prior
        self.log_prior = np.array([math.log(g.prior(n)) for n, _ in listed])
        self.log_prior -= np.logaddexp.reduce(self.log_prior)
        self.f = np.array([grammar.evaluate(e, x) * np.ones(len(y)) for e in self.expressions])
        zero = np.zeros((len(listed), 1))
        self.square, self.cross = (np.hstack((zero, np.cumsum(v, axis=1))) for v in (self.f**2, self.f * self.y))
        self.own = np.concatenate(([0.0], np.cumsum(self.y**2)))

    def log_marginal(self, rows: int, power: float) -> np.ndarray:
        """Of each expression, with the first `rows` responses whole and the next one at a power."""
        p, n = self.prior, rows + power
        square, cross, own = self.square[:, rows], self.cross[:, rows], self.own[rows]
        if power:
            square, cross, own = square + power * self.f[:, rows] ** 2, cross + power * self.f[:, rows] * self.y[rows], own + power * self.y[rows] ** 2
        precision, info, shape = p.precision + square, cross + p.precision * p.mean, p.shape + n / 2
        scale = p.scale + 0.5 * (own + p.precision * p.mean**2 - info**2 / precision)
        return -n / 2 * math.log(2 * math.pi) + 0.5 * np.log(p.precision / precision) + p.shape * math.log(p.scale) - shape * np.log(scale) + math.lgamma(shape) - math.lgamma(p.shape)

    def log_evidence(self) -> float:
        return float(np.logaddexp.reduce(self.log_prior + self.log_marginal(len(self.y), 0.0)))

    def posterior(self) -> np.ndarray:
        logs = self.log_prior + self.log_marginal(len(self.y), 0.0)
        return np.exp(logs - np.logaddexp.reduce(logs))


def _normalised(log_w: np.ndarray) -> tuple[np.ndarray, float]:
    total = float(np.logaddexp.reduce(log_w))
    return log_w - total, total


def run(s: Slice, n: int, seed: int, method: str = "knot", betas: tuple[float, ...] = BETAS, ess: float = 0.5) -> dict:
    """One population: log evidence, estimated probabilities of the slice's expressions, potentials evaluated, proposals made, roots left."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if n < 2 or len(betas) < 2 or betas[-1] != 1.0 or any(not 0 < a < b for a, b in zip(betas, betas[1:], strict=False)):
        raise ValueError("a population of two or more and powers that grow to 1 are needed")
    rng = np.random.default_rng(seed)
    at = rng.choice(len(s.log_prior), n, p=np.exp(s.log_prior))
    root, log_w, log_z = np.arange(n), np.full(n, -math.log(n)), 0.0
    potentials = proposals = 0
    pool: tuple[np.ndarray, np.ndarray] | None = None
    for t in range(len(s.y)):
        last_row, before = t == len(s.y) - 1, 0.0
        for beta in betas[:-1]:
            step = s.log_marginal(t, beta)[at] - s.log_marginal(t, before)[at]
            log_w, more = _normalised(log_w + step)
            log_z, before, potentials = log_z + more, beta, potentials + n
        here, full = s.log_marginal(t, before), s.log_marginal(t, 1.0)
        goal = s.log_prior + here
        new = rng.integers(len(goal), size=n)
        log_move = np.minimum(0.0, goal[new] - goal[at])
        with np.errstate(divide="ignore"):
            log_stay = np.where(log_move < 0, np.log(-np.expm1(log_move)), -np.inf)
        stay, move = log_stay + (full - here)[at], log_move + (full - here)[new]
        mean = np.logaddexp(stay, move)
        potentials, proposals, u = potentials + 2 * n, proposals + n, rng.random(n)
        if method == "knot" or method == "nonterminal" and not last_row:
            log_w, more = _normalised(log_w + mean)
            moved = np.log(u) < move - mean
        else:
            if method == "conditional" and last_row:
                both, more_pool = _normalised(np.concatenate((log_w + stay, log_w + move)))
                pool = np.concatenate((at, new)), both
            moved = np.log(u) < log_move
            log_w, more = _normalised(log_w + np.where(moved, (full - here)[new], (full - here)[at]))
            if pool is not None:
                more = more_pool
        at, log_z = np.where(moved, new, at), log_z + more
        w = np.exp(log_w)
        if 1 / (w @ w) < ess * n and not last_row:
            pick = systematic(w / w.sum(), n, rng.random())
            at, root, log_w = at[pick], root[pick], np.full(n, -math.log(n))
    where, logs = pool if pool is not None else (at, log_w)
    return {"log_evidence": log_z, "probabilities": np.bincount(where, np.exp(logs), len(s.log_prior)), "potentials": potentials, "proposals": proposals, "roots": len(set(root.tolist()))}


def populations(runs: DataFrame, data: dict[str, tuple[np.ndarray, np.ndarray]], g: Grammar, most: int, prior: Prior, betas: tuple[float, ...] = BETAS) -> DataFrame:
    """One population for each (dataset, method, n, seed), against the slice's exact posterior.

    data: registered designs of a few dozen rows.
    """
    d, rho = g.d, g.rho

    def some(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Slice] = {}
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                s = held.get(r.dataset)
                if s is None:
                    s = held.setdefault(r.dataset, Slice(Grammar(d, rho), most, *data[r.dataset], prior))
                got = run(s, int(r.n), int(r.seed), r.method, betas)
                exact = s.log_evidence()
                out.append((r.dataset, r.method, r.n, r.seed, got["log_evidence"], exact, 0.5 * float(np.abs(got["probabilities"] - s.posterior()).sum()), got["potentials"], got["proposals"], got["roots"]))
            yield pd.DataFrame(out, columns=names)

    schema = "dataset string, method string, n int, seed int, log_evidence double, exact double, tv double, potentials long, proposals long, roots int"
    names = [c.split()[0] for c in schema.split(", ")]
    return runs.select("dataset", "method", "n", "seed").repartition(F.xxhash64("dataset", "method", "n", "seed")).mapInPandas(some, schema)


def summary(df: DataFrame) -> DataFrame:
    """By dataset, method and size: how far the mean evidence of the runs is from the exact one (logarithms), the deviation of log evidences, mean total variation, work done."""
    shift = F.col("log_evidence") - F.col("exact")
    return df.groupBy("dataset", "method", "n").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max("exact").alias("exact"), F.log(F.avg(F.exp(shift))).alias("bias"), F.stddev_pop(shift).alias("deviation"), F.avg("tv").alias("tv"), F.sum("potentials").alias("potentials"), F.sum("proposals").alias("proposals"),
    )
