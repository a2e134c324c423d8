"""Operational classes, class information and acquisition scores.

Discrete tables stay in SQL.  Predictive mixtures are (structure x action) tables; the
integrals over one action run in a kernel on that action's few components.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import special
from quillon.functions.columns import xlogx
from quillon.operators.gram import Posterior, design_rows

LEVELS = (0.1, 0.5, 0.9)


def discrete_mi(joint: DataFrame, keys: list[str], cls: str, outcome: str, p: str) -> DataFrame:
    """By keys (actions): mutual information of class and outcome of a joint table, and the class entropy."""
    j = joint.groupBy(*keys, cls, outcome).agg(F.sum(p).alias("_p"))
    total = j.groupBy(*keys).agg(F.sum("_p").alias("_t"))
    c = j.groupBy(*keys, cls).agg(F.sum("_p").alias("_c"))
    o = j.groupBy(*keys, outcome).agg(F.sum("_p").alias("_o"))
    n = lambda x: xlogx(F.col(x) / F.col("_t"))
    hj = j.join(total, keys).groupBy(*keys).agg(F.sum(n("_p")).alias("hj"))
    hc = c.join(total, keys).groupBy(*keys).agg(F.sum(n("_c")).alias("hc"))
    ho = o.join(total, keys).groupBy(*keys).agg(F.sum(n("_o")).alias("ho"))
    return hj.join(hc, keys).join(ho, keys).select(*keys, F.greatest(F.lit(0.0), F.col("hj") - F.col("hc") - F.col("ho")).alias("mi"), (-F.col("hc")).alias("class_entropy"))


def update_utility(table: DataFrame, keys: list[str], structure: str, outcome: str, prior: str, likelihood: str, eta: float, cls: str | None = None) -> DataFrame:
    """By keys: the drop of structure entropy when the posterior is made with likelihood**eta, under the ordinary predictive.

    cls: a column that maps structures to classes; the entropies are then those of classes, whose masses are summed
    after the update.  For eta = 1 the drop is the mutual information; for less it may be negative.
    """
    t = table.withColumns({"_j": F.col(prior) * F.col(likelihood), "_w": F.col(prior) * F.pow(F.col(likelihood), F.lit(eta))})
    prior_of = t.select(*keys, structure, F.col(cls or structure).alias("_c"), F.col(prior).alias("_p")).distinct()
    t = t.groupBy(*keys, outcome, F.col(cls or structure).alias("_c")).agg(F.sum("_j").alias("_j"), F.sum("_w").alias("_w"))
    o = t.groupBy(*keys, outcome).agg(F.sum("_j").alias("_py"), F.sum("_w").alias("_z"), F.sum(xlogx(F.col("_w"))).alias("_e"))
    after = o.select(*keys, (F.col("_py") * F.when(F.col("_z") > 0, F.ln("_z") - F.col("_e") / F.col("_z")).otherwise(0.0)).alias("_h"))
    before = prior_of.groupBy(*keys, "_c").agg(F.sum("_p").alias("_p")).groupBy(*keys).agg((-F.sum(xlogx(F.col("_p")))).alias("_b"))
    return after.groupBy(*keys).agg(F.sum("_h").alias("_a")).join(before, keys).select(*keys, F.col("_b").alias("entropy_before"), F.col("_a").alias("entropy_after"), (F.col("_b") - F.col("_a")).alias("utility"))


def predictive_moments(components: DataFrame, action: str) -> DataFrame:
    """By action: mean and variance of a weighted mixture of t laws (w, df, loc, scale)."""
    w, v = F.col("w"), F.col("scale") * F.col("scale") * F.col("df") / (F.col("df") - 2)
    m = F.sum(w * F.col("loc"))
    return components.groupBy(action).agg(m.alias("mean"), F.greatest(F.lit(0.0), F.sum(w * (v + F.col("loc") * F.col("loc"))) - m * m).alias("variance"))


def inflated(scale: Column, df: Column, extra: Column) -> Column:
    """The scale of a t law whose variance grew by `extra`."""
    return F.sqrt(scale * scale + extra * (df - 2) / df)


def components(posts: list[Posterior], x: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per structure: probability, df, locations and scales at the actions."""
    return [(p.probability, *p.predict(design_rows(x, p.structure.terms))) for p in posts]


def component_rows(spark: SparkSession, posts: list[Posterior], x: np.ndarray) -> DataFrame:
    rows = [(p.structure.name, a, float(p.probability), float(df), float(loc[a]), float(scale[a])) for p, (_, df, loc, scale) in zip(posts, components(posts, x), strict=True) for a in range(len(x))]
    return spark.createDataFrame(rows, "structure string, action int, w double, df double, loc double, scale double")


def law_distances(posts: list[Posterior], x: np.ndarray) -> np.ndarray:
    """Root mean square, over actions and quantile levels, of quantile differences over pooled deviations."""
    q, v = [], []
    for _, df, loc, scale in components(posts, x):
        q.append(np.stack([loc + scale * special.t_ppf(level, float(df)) for level in LEVELS], 1))
        v.append(scale**2 * df / (df - 2))
    n = len(posts)
    out = np.zeros((n, n))
    for a in range(n):
        for b in range(a):
            out[a, b] = out[b, a] = math.sqrt(float(np.mean((q[a] - q[b]) ** 2 / (0.5 * (v[a] + v[b]))[:, None])))
    return out


def complete_link(distance: np.ndarray, names: list[str], threshold: float) -> list[list[int]]:
    """Merge the two groups of least diameter while it is within the threshold; ties by names."""
    groups = [[k] for k in range(len(names))]
    while len(groups) > 1:
        best = min(((max(distance[i, j] for i in a for j in b), min(names[i] for i in a), min(names[j] for j in b), ka, kb) for ka, a in enumerate(groups) for kb, b in enumerate(groups) if ka < kb), key=lambda z: z[:3])
        if best[0] > threshold:
            break
        groups[best[3]] = sorted(groups[best[3]] + groups[best[4]])
        del groups[best[4]]
    return sorted(groups, key=lambda g: min(names[i] for i in g))


def operational_classes(posts: list[Posterior], x: np.ndarray, budget: int) -> list[list[int]]:
    """Structures whose predictive laws can't be told apart with so many measurements."""
    return complete_link(law_distances(posts, x), [p.structure.name for p in posts], 1 / math.sqrt(budget))


def _log_mixture(y: np.ndarray, parts: list[tuple[float, float, float, float]]) -> np.ndarray:
    logs = np.array([math.log(max(w, 1e-300)) + special.t_logpdf(y, df, loc, scale) for w, df, loc, scale in parts])
    top = logs.max(axis=0)
    return top + np.log(np.exp(logs - top).sum(axis=0))


def exact_class_eig(by_class: list[list[tuple[float, float, float, float]]]) -> float:
    """Information between class and response at one action, by adaptive quadrature."""
    everything = [c for g in by_class for c in g]
    center = sum(w * loc for w, _, loc, _ in everything)
    spread = max(scale for *_, scale in everything) + max(abs(loc - center) for _, _, loc, _ in everything)

    def f(t: np.ndarray) -> np.ndarray:
        y = center + spread * np.tan(np.pi / 2 * t)
        jac = spread * np.pi / 2 / np.cos(np.pi / 2 * t) ** 2
        whole = _log_mixture(y, everything)
        total = np.zeros(len(t))
        for g in by_class:
            mass = sum(w for w, *_ in g)
            own = _log_mixture(y, g)
            total += np.exp(own) * (own - math.log(mass) - whole)
        return np.where(np.isfinite(total * jac), total * jac, 0.0)

    return max(0.0, sum(special.integrate(f, a, b) for a, b in ((-1 + 1e-9, -0.5), (-0.5, 0.0), (0.0, 0.5), (0.5, 1 - 1e-9))))


def class_eig(by_class: list[list[tuple[float, float, float, float]]], order: int, safety: float = 4.0) -> tuple[float, float]:
    """Nested Gauss-Jacobi estimate and its error: four times the change from half the order, plus rounding."""

    def at(n: int) -> float:
        everything = [c for g in by_class for c in g]
        total = 0.0
        for g in by_class:
            mass = sum(w for w, *_ in g)
            for w, df, loc, scale in g:
                z, q = special.student_nodes(df, n)
                y = loc + scale * z
                total += w * float(np.sum(q * (_log_mixture(y, g) - math.log(mass) - _log_mixture(y, everything))))
        return max(0.0, total)

    fine = at(order)
    return fine, safety * abs(fine - at(max(2, order // 2))) + 64 * np.finfo(float).eps * max(1.0, abs(fine))


def eig_until_ranked(actions: list, least: int = 8, most: int = 64) -> tuple[list[float], list[float], int, bool]:
    """Double the order until the leader's margin exceeds both errors, or the cap is met."""
    order = least
    while True:
        got = [class_eig(a, order) for a in actions]
        score, err = [g[0] for g in got], [g[1] for g in got]
        lead = max(range(len(score)), key=lambda k: (score[k], -k))
        sure = all(score[lead] - err[lead] > score[k] + err[k] for k in range(len(score)) if k != lead)
        if sure or order >= most:
            return score, err, order, sure
        order *= 2


def eig_bounds(by_class: list[list[tuple[float, float, float, float]]], levels: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9), slack: float = 1e-9) -> tuple[float, float]:
    """Information of the quantised response from below; class entropy and a Gaussian bound from above."""
    everything = [c for g in by_class for c in g]
    mass = np.array([sum(w for w, *_ in g) for g in by_class])
    mean = sum(w * loc for w, _, loc, _ in everything)
    var = sum(w * (s * s * df / (df - 2) + (loc - mean) ** 2) for w, df, loc, s in everything)
    edges = np.array([mean + math.sqrt(var) * special.norm_ppf(p) for p in levels])
    cells = []
    for g in by_class:
        cdf = sum(w * np.concatenate(([0.0], special.t_cdf((edges - loc) / s, df), [1.0])) for w, df, loc, s in g)
        cells.append(np.diff(cdf))
    joint = np.maximum(np.array(cells), 1e-300)
    lower = float(np.sum(joint * np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))))
    entropy = -float(np.sum(mass * np.log(np.maximum(mass, 1e-300))))
    within = sum(w * t_entropy(df, s) for w, df, _, s in everything)
    return max(0.0, lower - slack), min(entropy, max(0.0, 0.5 * math.log(2 * math.pi * math.e * var) - within + slack))


def t_entropy(df: float, scale: float) -> float:
    a = (df + 1) / 2
    return a * (special.digamma(a) - special.digamma(df / 2)) + math.log(math.sqrt(df)) + math.lgamma(df / 2) + math.lgamma(0.5) - math.lgamma(a) + math.log(scale)


def grouped_components(posts: list[Posterior], classes: list[list[int]], x: np.ndarray) -> list[list[list[tuple[float, float, float, float]]]]:
    """For each action, for each class, its components."""
    c = components(posts, x)
    return [[[(float(c[i][0]), float(c[i][1]), float(c[i][2][a]), float(c[i][3][a])) for i in g] for g in classes] for a in range(len(x))]


def class_epig(posts: list[Posterior], classes: list[list[int]], x: np.ndarray, targets: np.ndarray, extra: np.ndarray | float = 0.0, target_extra: np.ndarray | float = 0.0) -> np.ndarray:
    """Class-averaged -1/2 log(1 - rho^2) between the responses at an action and at the targets, Gaussian in their moments.

    extra, target_extra: variance that a discrepancy adds at the actions and at the targets.
    """
    out, eps = np.zeros(len(x)), np.finfo(float).eps
    for g in classes:
        mass = sum(posts[i].probability for i in g)
        if mass <= 0:
            continue
        ma, mt, vaa, vtt, vat = 0.0, 0.0, 0.0, 0.0, 0.0
        for i in g:
            p, w = posts[i], posts[i].probability / mass
            a, t = design_rows(x, p.structure.terms), design_rows(targets, p.structure.terms)
            noise = p.scale / (p.shape - 1)
            la, lt = a @ p.mean, t @ p.mean
            ma, mt = ma + w * la, mt + w * lt
            vaa = vaa + w * (noise * (1 + np.einsum("ij,jk,ik->i", a, p.cov, a)) + la**2)
            vtt = vtt + w * (noise * (1 + np.einsum("ij,jk,ik->i", t, p.cov, t)) + lt**2)
            vat = vat + w * (noise * a @ p.cov @ t.T + np.outer(la, lt))
        cov = vat - np.outer(ma, mt)
        rho2 = np.clip(cov**2 / np.outer(vaa - ma**2 + extra, vtt - mt**2 + target_extra), 0, 1 - 64 * eps)
        out += mass * np.mean(-0.5 * np.log1p(-rho2), axis=1)
    return out


def epistemic_variance(posts: list[Posterior], x: np.ndarray) -> np.ndarray:
    """Variance of the latent mean over structures and coefficients, noise left out."""
    w = np.array([p.probability for p in posts])
    loc = np.array([design_rows(x, p.structure.terms) @ p.mean for p in posts])
    var = np.array([p.latent_variance(design_rows(x, p.structure.terms)) for p in posts])
    return np.maximum(0, (w[:, None] * (var + loc**2)).sum(0) - (w[:, None] * loc).sum(0) ** 2)


def committee_disagreement(posts: list[Posterior], x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Sample variance of the means of a committee drawn by probability."""
    rng = np.random.default_rng(seed)
    loc = np.array([design_rows(x, p.structure.terms) @ p.mean for p in posts])
    w = np.array([p.probability for p in posts])
    return loc[rng.choice(len(posts), size, p=w / w.sum())].var(axis=0, ddof=1)


def apportion(shares: list[float], seats: int) -> list[int]:
    """Largest remainders; ties to the first."""
    x = [s * seats for s in shares]
    out = [math.floor(v) for v in x]
    for k in sorted(range(len(x)), key=lambda k: (out[k] - x[k], k))[: seats - sum(out)]:
        out[k] += 1
    return out


def residual_excess(posts: list[Posterior], stats, prior) -> float:
    """Probability-weighted residual mean square beyond the prior noise, from statistics alone."""
    total = 0.0
    for p in posts:
        s = stats.of(p.structure.terms)
        mse = float(s.yy - 2 * p.mean @ s.xy + p.mean @ s.xx @ p.mean) / s.n
        total += p.probability * max(0.0, mse - prior.scale / (prior.shape - 1))
    return total
