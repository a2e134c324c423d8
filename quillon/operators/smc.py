"""Collapsed sequential Monte Carlo over a finite bank, one population a group, with an exact answer beside it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.gram import Prior, Stats, Structure, bank_posterior, conjugate, design_rows


def proposal_graph(bank: list[Structure]) -> dict[str, list[str]]:
    """Birth, death and replacement: structures that differ by one added, one removed or one exchanged term, or by nesting."""
    out = {}
    for a in bank:
        near = [b.name for b in bank if b is not a and (set(a.terms) < set(b.terms) or set(b.terms) < set(a.terms) or len(set(a.terms) ^ set(b.terms)) <= 2)]
        out[a.name] = near or [b.name for b in bank if b is not a]
    return out


def systematic(weights: np.ndarray, n: int, u: float) -> np.ndarray:
    c = np.cumsum(weights)
    c[-1] = 1.0
    return np.searchsorted(c, (np.arange(n) + u) / n, "right")


def bisect_step(weights: np.ndarray, inc: np.ndarray, remaining: float, target: float, tol: float = 1e-9) -> float:
    """Largest tempering step whose conditional effective sample size is target of N."""

    def cess(d: float) -> float:
        e = np.exp(d * (inc - inc.max()))
        return (weights @ e) ** 2 / (weights @ (e * e))

    if cess(remaining) >= target:
        return remaining
    lo, hi = 0.0, remaining
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cess(mid) >= target else (lo, mid)
        if hi - lo < tol:
            break
    return max(lo, min(tol, remaining))


def run(bank: list[Structure], x: np.ndarray, y: np.ndarray, prior: Prior, n: int, seed: int, cess: float = 0.9, ess: float = 0.5, moves: int = 2) -> dict:
    """Particles are structures, coefficients are integrated out.  Observations come one by one, each bridged by tempering."""
    rng = np.random.default_rng(seed)
    names = [b.name for b in bank]
    graph = {a: [names.index(b) for b in near] for a, near in proposal_graph(bank).items()}
    designs = [design_rows(x, b.terms) for b in bank]

    def evidence(t: int, beta: float) -> np.ndarray:
        """Log evidence of each structure with the first t rows and row t at power beta."""
        out = []
        for b, d in zip(bank, designs, strict=True):
            w = np.append(np.ones(t), beta)[: min(t + 1, len(y))]
            dw, yy = d[: len(w)] * w[:, None], y[: len(w)]
            out.append(conjugate(b, Stats(b.terms, float(w.sum()), dw.T @ d[: len(w)], dw.T @ yy, float((w * yy) @ yy)), prior).log_evidence)
        return np.array(out)

    at = rng.choice(len(bank), n, p=[b.prior for b in bank])
    root, logw, log_z = np.arange(n), np.full(n, -math.log(n)), 0.0
    log_prior = np.log([b.prior for b in bank])
    trace = []
    for t in range(len(y)):
        beta, low = 0.0, evidence(t, 0.0)
        full = evidence(t, 1.0) - low
        while beta < 1:
            w = np.exp(logw - logw.max())
            w /= w.sum()
            here = evidence(t, beta)
            step = bisect_step(w, full[at], 1 - beta, cess)
            there = evidence(t, min(1.0, beta + step))
            beta = min(1.0, beta + step)
            new = np.log(w) + (there - here)[at]
            top = new.max()
            norm = top + math.log(np.exp(new - top).sum())
            log_z += norm
            logw = new - norm
            w = np.exp(logw)
            if 1 / (w @ w) < ess * n:
                pick = systematic(w / w.sum(), n, rng.random())
                at, root, logw = at[pick], root[pick], np.full(n, -math.log(n))
            goal = log_prior + there
            for _ in range(moves):
                for k in range(n):
                    near = graph[names[at[k]]]
                    to = near[rng.integers(len(near))]
                    back = graph[names[to]]
                    if at[k] in back and math.log(rng.random()) < goal[to] - goal[at[k]] + math.log(len(near) / len(back)):
                        at[k] = to
            trace.append((t, beta, len(set(root.tolist())), float(1 / (w @ w))))
    w = np.exp(logw)
    prob = {name: float(w[at == k].sum() / w.sum()) for k, name in enumerate(names)}
    return {"probabilities": prob, "log_evidence": log_z, "roots": len(set(root.tolist())), "trace": trace}


def compare(bank: list[Structure], x: np.ndarray, y: np.ndarray, prior: Prior, got: dict) -> dict[str, float]:
    """Total variation, KL and evidence error against the exact posterior."""
    s = Stats(tuple(dict.fromkeys(t for b in bank for t in b.terms)), 0, np.zeros((0, 0)), np.zeros(0), 0)
    d = design_rows(x, s.terms)
    s = Stats(s.terms, float(len(y)), d.T @ d, d.T @ y, float(y @ y))
    exact = {p.structure.name: p for p in bank_posterior(bank, s, prior)}
    p = np.array([exact[b.name].probability for b in bank])
    q = np.array([got["probabilities"][b.name] for b in bank])
    logs = np.array([math.log(b.prior) + exact[b.name].log_evidence for b in bank])
    log_z = logs.max() + math.log(np.exp(logs - logs.max()).sum())
    return {"tv": 0.5 * float(np.abs(p - q).sum()), "kl": float(np.sum(np.where(p > 0, p * np.log(np.maximum(p, 1e-300) / np.maximum(q, 1e-12)), 0))), "evidence_error": abs(got["log_evidence"] - log_z), "max_error": float(np.abs(p - q).max())}


def populations(runs: DataFrame, data: dict[str, tuple[np.ndarray, np.ndarray]], bank: list[Structure], prior: Prior) -> DataFrame:
    """One population for each (dataset, n, seed): (dataset, n, seed, tv, kl, evidence_error, roots).

    data: registered designs of a few dozen rows.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        r = part.iloc[0]
        x, y = data[r["dataset"]]
        got = run(bank, x, y, prior, int(r["n"]), int(r["seed"]))
        c = compare(bank, x, y, prior, got)
        return pd.DataFrame([{"dataset": r["dataset"], "n": r["n"], "seed": r["seed"], "tv": c["tv"], "kl": c["kl"], "evidence_error": c["evidence_error"], "roots": got["roots"]}])

    return runs.groupBy("dataset", "n", "seed").applyInPandas(one, "dataset string, n int, seed int, tv double, kl double, evidence_error double, roots int")


def population_summary(df: DataFrame) -> DataFrame:
    """Mean, deviation and maximum of each error by dataset and size."""
    aggs = [f(c).alias(f"{n}_{c}") for c in ("tv", "evidence_error") for n, f in (("mean", F.avg), ("max", F.max))]
    return df.groupBy("dataset", "n").agg(*aggs, *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std_{c}") for c in ("tv", "evidence_error")])
