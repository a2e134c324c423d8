"""Regression metrics, summaries and paired statistics as aggregates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import finite, t975, xlogx
from quillon.operators.ordered import quantiles, running

FLOOR = 1e-12


def finite_pairs(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """The rows where truth and prediction are both finite."""
    return df.where(finite(y) & finite(p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def nmse(y: Column, p: Column, floor: float = FLOOR) -> Column:
    """Mean squared error over the population variance of the truth."""
    return mse(y, p) / F.greatest(F.var_pop(y), F.lit(floor))


def r2(y: Column, p: Column) -> Column:
    """One pass: the total sum of squares is n times the population variance."""
    return 1 - F.sum((y - p) * (y - p)) / F.greatest(F.var_pop(y) * F.count(y), F.lit(FLOOR))


def relative_error(y: Column, p: Column, floor: float = 1e-6) -> Column:
    return F.abs(y - p) / F.greatest(F.abs(y), F.lit(floor))


def tail_block(df: DataFrame, y: Column, p: Column, keys: list[str], floor: float = 1e-6) -> DataFrame:
    """nmse, largest relative error, its .99 and .995 quantiles, and the share at .1 or less."""
    rel = relative_error(y, p, floor)
    main = df.groupBy(*keys).agg(nmse(y, p).alias("nmse"), F.max(rel).alias("max_rel"), F.avg((rel <= 0.1).cast("int")).alias("share_01"))
    q = quantiles(df, rel, [0.99, 0.995], keys).groupBy(*keys).agg(F.max(F.when(F.col("level") == 0.99, F.col("q"))).alias("p99"), F.max(F.when(F.col("level") == 0.995, F.col("q"))).alias("p995"))
    return main.join(q, keys) if keys else main.crossJoin(F.broadcast(q))


def objective(nmse_: Column, p99: Column, p99_of_mean: Column, profile: str, tail_weight: float = 1.0) -> Column:
    """nmse plus a weighted, capped tail term."""
    share = {"nmse": 0.25, "tail": 3.0, "low_complexity": 0.5}.get(profile, 1.0)
    return nmse_ + F.lit(tail_weight * share) * F.least(F.lit(100.0), p99 / F.greatest(F.lit(1.0), p99_of_mean))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are there, zero where it isn't defined."""
    u, v = F.var_pop(F.when(b.isNotNull(), a)), F.var_pop(F.when(a.isNotNull(), b))
    r = F.when((u > 0) & (v > 0), F.covar_pop(a, b) / F.sqrt(u) / F.sqrt(v))
    return F.when(r.isNull() | F.isnan(r), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rho, n.  Ranks come from counts of distinct values, so ties share their mean rank."""
    out = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    for c in (a, b):
        v = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_m"))
        v = running(v, F.col(c).cast("double"), c, {"_upto": F.col("_m")}).select(c, (F.col("_upto") - (F.col("_m") - 1) / 2).alias(f"_rank_{c}"))
        out = out.join(v, c)
    x, y, n = F.col(f"_rank_{a}"), F.col(f"_rank_{b}"), F.col("n")
    s = out.agg(F.sum(n).alias("n"), (F.sum(n * x) / F.sum(n)).alias("mx"), (F.sum(n * y) / F.sum(n)).alias("my"), (F.sum(n * x * y) / F.sum(n)).alias("xy"), (F.sum(n * x * x) / F.sum(n)).alias("xx"), (F.sum(n * y * y) / F.sum(n)).alias("yy"))
    cov, vx, vy = F.col("xy") - F.col("mx") * F.col("my"), F.col("xx") - F.col("mx") ** 2, F.col("yy") - F.col("my") ** 2
    return s.select("n", F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).otherwise(0.0).alias("rho"))


def mean_ci(df: DataFrame, keys: list[str], value: Column, name: str = "value") -> DataFrame:
    """Mean with a 95% t interval, sample deviation and count; one observation gives a point."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("s"), F.count(value).alias("n"))
    half = F.when(F.col("n") > 1, t975(F.greatest(F.lit(1), F.col("n") - 1).cast("double")) * F.col("s") / F.sqrt("n")).otherwise(0.0)
    return s.select(*keys, F.col("m").alias(f"{name}_mean"), (F.col("m") - half).alias(f"{name}_low"), (F.col("m") + half).alias(f"{name}_high"), F.col("s").alias(f"{name}_std"), "n")


def paired_deltas(runs: DataFrame, scope: str, unit: str, policy: str, reference: str, value: str) -> DataFrame:
    """(scope, unit, baseline, delta): the reference policy less each other on the same unit; unmatched units drop out."""
    ours = runs.where(F.col(policy) == reference).select(scope, unit, F.col(value).alias("_ours"))
    theirs = runs.where(F.col(policy) != reference).select(scope, unit, F.col(policy).alias("baseline"), F.col(value).alias("_theirs"))
    return theirs.join(ours, [scope, unit]).select(scope, unit, "baseline", (F.col("_ours") - F.col("_theirs")).alias("delta"))


def paired_methods(runs: DataFrame, keys: list[str], method: str, base: str, candidate: str, budgets: list[str], errors: list[str]) -> DataFrame:
    """Runs of two methods side by side: each budget and error of both, whether budgets match, and by how much an error fell.

    Keys that don't have one run of each method and of no other are left out.  One aggregate: no side is read twice.
    """
    of = lambda m, c: F.max(F.when(F.col(method) == m, F.col(c)))
    n = lambda m: F.sum((F.col(method) == m).cast("long"))
    cols = [of(m, c).alias(f"{c}_{w}") for c in [*budgets, *errors] for m, w in ((base, "base"), (candidate, "candidate"))]
    d = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), n(base).alias("_b"), n(candidate).alias("_c"), *cols).where("_n = 2 and _b = 1 and _c = 1")
    more = {f"{c}_matched": F.col(f"{c}_base").eqNullSafe(F.col(f"{c}_candidate")) for c in budgets} | {f"{c}_improvement": F.col(f"{c}_base") - F.col(f"{c}_candidate") for c in errors}
    return d.withColumns(more).drop("_n", "_b", "_c")


def paired_effects(deltas: DataFrame, scope: str) -> DataFrame:
    """Mean effect with its interval and the share of units that got worse, by scope and baseline."""
    ci = mean_ci(deltas, [scope, "baseline"], F.col("delta"), "delta")
    worse = deltas.groupBy(scope, "baseline").agg(F.avg((F.col("delta") > 0).cast("int")).alias("worse_share"))
    return ci.join(worse, [scope, "baseline"])


def area_under_curve(df: DataFrame, keys: list[str], order: Column, value: Column) -> DataFrame:
    """Trapezoids of unit width, plain and normalised by (n-1) times the first value; no window is needed."""
    at = F.struct(order.alias("o"))
    s = df.groupBy(*keys).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    area = F.col("s") - (F.col("first") + F.col("last")) / 2
    return s.select(*keys, "n", area.alias("area"), F.when((F.col("n") > 1) & (F.col("first") != 0), area / ((F.col("n") - 1) * F.col("first"))).alias("normalised"))


def entropy(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Entropy of the category's shares, by keys; counts come first, so a hot key is small."""
    c = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    # -sum p ln p with p = c/n is ln n - sum(c ln c)/n.
    return c.groupBy(*keys).agg((F.ln(n) - F.sum(F.col("_n") * F.ln("_n")) / n).alias("entropy"), n.alias("n"))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * F.sum(F.abs(F.coalesce(p, F.lit(0.0)) - F.coalesce(q, F.lit(0.0))))


def categorical_entropy(p: Column) -> Column:
    return -F.sum(xlogx(p))


def wilcoxon_holm(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: counts, mean, median, wins, ties, one-sided signed-rank p, and p_holm, adjusted over the groups of the first key.

    p is exact for up to EXACT_N deltas without ties or zeros, else normal with tie correction.  Ranks of
    |delta| come from counts of distinct absolute values; the Holm step sorts one row a group.
    """
    d = deltas.withColumn("_a", F.round(F.abs("delta"), 12))
    v = d.where(F.col("_a") > 0).groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("t"), F.sum((F.col("delta") < 0).cast("long")).alias("wins"))
    v = running(v, F.col("_a"), "_a", {"upto": F.col("t")}, keys)
    w = v.groupBy(*keys).agg(F.sum(F.col("wins") * (F.col("upto") - (F.col("t") - 1) / 2)).alias("w"), F.sum("t").alias("m"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties3"))
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), F.sum((F.col("delta") < 0).cast("long")).alias("n_wins"), F.sum((F.col("_a") == 0).cast("long")).alias("n_ties"))
    med = quantiles(deltas, F.col("delta"), [0.5], keys).select(*keys, F.col("q").alias("median"))
    out = s.join(med, keys).join(w, keys, "left")
    m = F.coalesce("m", F.lit(0))
    z = (F.col("w") - m * (m + 1) / 4 - 0.5) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties3") / 48)
    out = out.withColumn("z", F.when(m > 0, z).otherwise(0.0))
    tails = F.from_json(F.lit(json.dumps([signed_rank_tail(k) for k in range(EXACT_N + 1)])), "array<array<double>>")
    exact = F.element_at(F.element_at(tails, F.least(m, F.lit(EXACT_N)).cast("int") + 1), F.least(F.col("w"), m * (m + 1) / 2).cast("int") + 1)
    whole = (m <= EXACT_N) & (m > 0) & (F.col("ties3") == 0) & (F.col("n_ties") == 0)
    out = out.withColumn("p", F.when(whole, exact).otherwise(normal_tail(F.col("z"))))
    return holm_adjusted(out.select(*keys, "n", "mean", "median", "n_wins", "n_ties", "p"), keys[:1], "p", keys)


#: Deltas up to which the signed-rank test is exact.
EXACT_N = 20


def signed_rank_tail(n: int) -> list[float]:
    """P(W >= w) for w from 0 on, W the sum of ranks 1..n with fair signs."""
    counts = [1]
    for k in range(1, n + 1):
        counts = [(counts[w] if w < len(counts) else 0) + (counts[w - k] if w >= k else 0) for w in range(len(counts) + k)]
    out, total = [], 0
    for c in reversed(counts):
        total += c
        out.append(total / 2**n)
    return out[::-1]


def holm_adjusted(df: DataFrame, family: list[str], p: str, ident: list[str]) -> DataFrame:
    """Adds `p_holm`: step-down adjusted p values within each family (one row a comparison)."""
    by = Window.partitionBy(*family)
    step = df.withColumn("_k", F.row_number().over(by.orderBy(p, *ident))).withColumn("_step", F.least(F.lit(1.0), F.col(p) * (F.count(F.lit(1)).over(by) - F.col("_k") + 1)))
    return step.withColumn("p_holm", F.max("_step").over(by.orderBy("_k"))).drop("_k", "_step")


def normal_tail(z: Column) -> Column:
    """1 - Phi(z) to 1e-7, by a rational approximation."""
    # Fixed values of the approximation.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    s = sum((F.lit(c) * F.pow(t, F.lit(k)) for k, c in enumerate(b, 1)), F.lit(0.0))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * s
    return F.when(z >= 0, tail).otherwise(1 - tail)


def holm(ps: dict[str, float]) -> dict[str, float]:
    """Step-down adjusted p values."""
    out, most = {}, 0.0
    for k, (name, p) in enumerate(sorted(ps.items(), key=lambda x: x[1])):
        most = max(most, min(1.0, p * (len(ps) - k)))
        out[name] = most
    return out


def bootstrap_median(df: DataFrame, keys: list[str], value: str, resamples: int, seed: int) -> DataFrame:
    """Percentile interval of the median over seeded resamples of each (small) group of paired effects."""
    import numpy as np
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(part[value].to_numpy())
        rng = np.random.default_rng(seed)
        m = np.array([np.median(x[rng.integers(0, len(x), len(x))]) for _ in range(resamples)])
        lo, hi = np.quantile(m, [0.025, 0.975])
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "median": [float(np.median(x))], "low": [float(lo)], "high": [float(hi)], "n": [len(x)]})

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", median double, low double, high double, n long")
