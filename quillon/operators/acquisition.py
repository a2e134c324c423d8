"""Measured-pool acquisition: policies score the candidates left, one label is revealed a round, and the bank learns.

A run is sequential by nature and small (tens of rows); runs are the parallel axis, one group a
(dataset, policy, seed).  Within a run all candidates are scored together by array operations.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillon.functions import special
from quillon.operators import discrepancy, gram, information
from quillon.operators.gram import Posterior, Prior, Stats, Structure

POLICIES = ("random", "uncertainty", "qbc", "class_eig", "epig", "maximin", "mmd_safe", "reference_dominance", "discrepancy_aware", "discriminative")
POWERS = (0.25, 0.5, 1.0)
TIE = 1e-15


def derived_seed(seed: int, policy: str, step: int) -> int:
    """The first eight bytes of SHA-256 over seed, policy and round."""
    return int.from_bytes(hashlib.sha256(f"quillon:{seed}:{policy}:{step}".encode()).digest()[:8], "big")


def stable_argmax(scores: np.ndarray, ids: np.ndarray) -> int:
    """Position of the smallest id among the scores within TIE of the largest."""
    good = np.flatnonzero(scores >= scores.max() - TIE)
    return int(good[np.argmin(ids[good])])


def class_eig_all(posts: list[Posterior], groups: list[list[int]], x: np.ndarray, order: int, extra: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Nested Gauss-Jacobi class information of all actions at once, and its error.  extra: variance that a discrepancy adds to each law."""
    comps = [(w, df, loc, np.sqrt(scale**2 + extra * (df - 2) / df)) for w, df, loc, scale in information.components(posts, x)]

    def at(n: int) -> np.ndarray:
        total = np.zeros(len(x))
        for g in groups:
            mass = sum(comps[i][0] for i in g)
            if mass <= 0:
                continue
            for i in g:
                w, df, loc, scale = comps[i]
                if w <= 1e-300:
                    continue
                z, q = special.student_nodes(float(df), n)
                y = loc[:, None] + scale[:, None] * z[None, :]
                logs = np.array([math.log(max(c[0], 1e-300)) + special.t_logpdf(y, c[1], c[2][:, None], c[3][:, None]) for c in comps])
                whole = np.logaddexp.reduce(logs, axis=0)
                own = np.logaddexp.reduce(logs[g], axis=0)
                total += w * ((own - math.log(mass) - whole) * q[None, :]).sum(axis=1)
        return np.maximum(0, total)

    fine = at(order)
    return fine, 4 * np.abs(fine - at(max(2, order // 2))) + 64 * np.finfo(float).eps * np.maximum(1, np.abs(fine))


def safe_set(observed: np.ndarray, candidates: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Candidates that don't raise the squared MMD to the target set; the present value; the value with each."""
    mean = targets.mean(0)
    pooled = np.sqrt(((np.vstack((observed, candidates, targets)) - mean) ** 2).mean(0))
    sd = np.where(targets.std(0) > 0, targets.std(0), np.where(pooled > 0, pooled, 1.0))
    o, c, t = ((v - mean) / sd for v in (observed, candidates, targets))
    h2 = discrepancy.median_positive(discrepancy.squared(t))

    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)
        return np.exp(-0.5 * d2 / h2)

    oo, ot, tt, co, ct = k(o, o).sum(), k(o, t).sum(), k(t, t).mean(), k(c, o).sum(1), k(c, t).sum(1)
    n, m = len(o), len(t)
    now = oo / n**2 - 2 * ot / (n * m) + tt
    then = (oo + 2 * co + 1) / (n + 1) ** 2 - 2 * (ot + ct) / ((n + 1) * m) + tt
    return then <= now + 512 * np.finfo(float).eps * max(1.0, abs(now)), float(now), then


def discrepancy_profile(excess: float, observed: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Extra predictive variance that grows with the distance from what was seen."""
    h2 = discrepancy.median_positive(discrepancy.squared(observed))
    d2 = np.maximum((candidates**2).sum(1)[:, None] + (observed**2).sum(1)[None, :] - 2 * candidates @ observed.T, 0).min(1)
    return excess * (1 + d2 / h2)


@dataclass(frozen=True)
class Maximin:
    """Bounds of each action's worst score over likelihood powers, the leader, and whether no other can beat it."""

    lower: np.ndarray
    upper: np.ndarray
    leader: int
    certified: bool
    order: int


def maximin_until_ranked(by_power: dict[float, list[Posterior]], groups: list[list[int]], x: np.ndarray, ids: np.ndarray, targets: np.ndarray, eligible: np.ndarray, orders: tuple[int, ...] = (8, 16, 32), extra: np.ndarray | float = 0.0) -> Maximin:
    """Class information plus predictive information, the least over powers, with finer quadrature until the leader is certain."""
    epig = [information.class_epig(p, groups, x, targets, extra) for p in by_power.values()]
    for order in orders:
        eig = [class_eig_all(p, groups, x, order, extra) for p in by_power.values()]
        lower = np.where(eligible, np.min([np.maximum(0, v - e) + g for (v, e), g in zip(eig, epig, strict=True)], axis=0), -np.inf)
        upper = np.where(eligible, np.min([v + e + g for (v, e), g in zip(eig, epig, strict=True)], axis=0), -np.inf)
        lead = stable_argmax(lower, ids)
        others = np.delete(upper, lead)
        if not len(others) or lower[lead] > others.max():
            return Maximin(lower, upper, lead, True, order)
    return Maximin(lower, upper, lead, False, orders[-1])


def discriminative(by_power: dict[float, list[Posterior]], groups: list[list[int]], observed: np.ndarray, x: np.ndarray, ids: np.ndarray, targets: np.ndarray, seed: int) -> tuple[int, str]:
    """The next action and why: among the safe ones the certified maximin leader, else a draw among those that may lead; without safe ones the one that harms coverage least."""
    safe, _, then = safe_set(observed, x, targets)
    if not safe.any():
        return stable_argmax(-then, ids), "least_harm"
    m = maximin_until_ranked(by_power, groups, x, ids, targets, safe)
    if m.certified:
        return m.leader, "certified"
    open_ = np.flatnonzero(safe & (m.upper >= m.lower[m.leader]))
    return int(open_[weighted_draw(ids[open_], np.ones(len(open_)), seed)]), "undecided"


def weighted_draw(ids: np.ndarray, weights: np.ndarray, seed: int) -> int:
    """Position of an action drawn by reference weights, which need not sum to 1, in the order of ids."""
    if not len(ids) or (weights < 0).any() or not weights.sum() > 0:
        raise ValueError("weights must not be negative and not all 0")
    order = np.argsort(ids, kind="stable")
    u = int.from_bytes(hashlib.sha256(str(seed).encode()).digest()[:8], "big") / 2**64
    return int(order[min(len(ids) - 1, int(np.searchsorted(np.cumsum(weights[order]) / weights.sum(), u, "right")))])


def scores(policy: str, posts: list[Posterior], groups: list[list[int]], observed: np.ndarray, x: np.ndarray, targets: np.ndarray, seed: int, order: int = 16, by_power: dict[float, list[Posterior]] | None = None, excess: float = 0.0) -> np.ndarray:
    """Higher is better; candidates that a policy excludes score -inf."""
    if policy == "random":
        return np.random.default_rng(seed).random(len(x))
    if policy == "uncertainty":
        w = np.array([p.probability for p in posts])
        c = information.components(posts, x)
        loc, var = np.array([v[2] for v in c]), np.array([v[3] ** 2 * v[1] / (v[1] - 2) for v in c])
        return (w[:, None] * (var + loc**2)).sum(0) - (w[:, None] * loc).sum(0) ** 2
    if policy == "qbc":
        return information.committee_disagreement(posts, x, 32, seed)
    if policy in ("class_eig", "reference_dominance"):
        return class_eig_all(posts, groups, x, order)[0]
    if policy == "epig":
        return information.class_epig(posts, groups, x, targets)
    if policy == "maximin":
        return np.min([class_eig_all(p, groups, x, order)[0] + information.class_epig(p, groups, x, targets) for p in (by_power or {1.0: posts}).values()], axis=0)
    if policy == "discrepancy_aware":
        extra = discrepancy_profile(excess, observed, x)
        return class_eig_all(posts, groups, x, order, extra)[0] + information.class_epig(posts, groups, x, targets, extra)
    if policy == "mmd_safe":
        safe, _, then = safe_set(observed, x, targets)
        if not safe.any():
            return -then
        return np.where(safe, class_eig_all(posts, groups, x, order)[0] + information.class_epig(posts, groups, x, targets), -np.inf)
    raise ValueError(f"unknown policy {policy}")


def choose(policy: str, posts: list[Posterior], groups: list[list[int]], observed: np.ndarray, x: np.ndarray, ids: np.ndarray, targets: np.ndarray, seed: int, by_power=None, excess: float = 0.0, reference: np.ndarray | None = None) -> int:
    """Position of the next candidate.  Reference dominance hands over to the leader only if its lower bound beats the reference's mean upper bound, else draws by it.  reference: its weights, alike where None."""
    if policy == "discriminative":
        return discriminative(by_power or {1.0: posts}, groups, observed, x, ids, targets, seed)[0]
    if policy != "reference_dominance":
        return stable_argmax(scores(policy, posts, groups, observed, x, targets, seed, by_power=by_power, excess=excess), ids)
    value, err = class_eig_all(posts, groups, x, 16)
    lead, weights = stable_argmax(value - err, ids), np.ones(len(ids)) if reference is None else np.asarray(reference, float)
    if value[lead] - err[lead] - float(weights @ (value + err) / weights.sum()) > 256 * np.finfo(float).eps * max(1.0, float(np.abs(value).max())):
        return lead
    return weighted_draw(ids, weights, seed)


def entropy(p: list[float]) -> float:
    return -sum(v * math.log(v) for v in p if v > 0)


def run(bank: list[Structure], prior: Prior, initial: tuple, pool: tuple, valid: tuple, policy: str, seed: int, rounds: int, budget: int = 64) -> list[dict]:
    """The learning curve: a row before the first query and one after each."""
    (xi, yi), (xp, yp), (xv, yv) = initial, pool, valid
    names = tuple(dict.fromkeys(t for b in bank for t in b.terms))

    def stats(x: np.ndarray, y: np.ndarray) -> Stats:
        d = gram.design_rows(x, names)
        return Stats(names, float(len(y)), d.T @ d, d.T @ y, float(y @ y))

    s, seen, left, frozen, out = stats(xi, yi), xi, np.arange(len(yp)), None, []
    for step in range(rounds + 1):
        posts = gram.bank_posterior(bank, s, prior)
        if frozen is None:
            frozen = information.operational_classes(posts, xv, budget)
            start = entropy([sum(posts[i].probability for i in g) for g in frozen])
        now = entropy([sum(posts[i].probability for i in g) for g in frozen])
        mean = sum(p.probability * (gram.design_rows(xv, p.structure.terms) @ p.mean) for p in posts)
        row = {"step": step, "rmse": float(np.sqrt(np.mean((yv - mean) ** 2))), "nll": float(-gram.mixture_logpdf(posts, xv, yv).mean()), "class_entropy": now, "entropy_gain": start - now, "chosen": -1}
        if step < rounds:
            by_power = {e: gram.bank_posterior(bank, s, prior, e) for e in POWERS} if policy in ("maximin", "discriminative") else None
            excess = information.residual_excess(posts, s, prior) if policy == "discrepancy_aware" else 0.0
            k = choose(policy, posts, frozen, seen, xp[left], left, xv, derived_seed(seed, policy, step), by_power, excess)
            at = left[k]
            row["chosen"] = int(at)
            s, seen, left = s + stats(xp[at : at + 1], yp[at : at + 1]), np.vstack((seen, xp[at])), np.delete(left, k)
        out.append(row)
    return out


def normalised_area(curve: list[float]) -> float:
    return (sum(curve) - (curve[0] + curve[-1]) / 2) / ((len(curve) - 1) * curve[0])


def replay(runs: DataFrame, data: dict[str, tuple], bank: list[Structure], prior: Prior, rounds: int) -> DataFrame:
    """(dataset, policy, seed, step, ...): every run of a table of (dataset, policy, seed), each in its own group."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        r = part.iloc[0]
        rows = run(bank, prior, *data[r["dataset"]], r["policy"], int(r["seed"]), rounds)
        return pd.DataFrame([{"dataset": r["dataset"], "policy": r["policy"], "seed": int(r["seed"]), **x} for x in rows])

    return runs.groupBy("dataset", "policy", "seed").applyInPandas(one, "dataset string, policy string, seed int, step int, rmse double, nll double, class_entropy double, entropy_gain double, chosen int")
