"""Weights, resampling, e-processes and genealogy: operators over an order or a population."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import seeded_hex, uniform
from quillon.operators.ordered import running
from quillon.sources.shared import removed, written

PIT_LAMBDAS = (-0.8, -0.4, 0.4, 0.8)


def weight_stats(df: DataFrame, keys: list[str], log_weight: Column) -> DataFrame:
    """By keys: log normaliser, effective sample size and entropy of self-normalised weights.

    Shifted by the largest log weight, so that nothing overflows; the shift is an aggregate too.
    """
    top = df.groupBy(*keys).agg(F.max(log_weight).alias("_top"))
    d = (df.join(top, keys) if keys else df.crossJoin(F.broadcast(top))).withColumn("_w", F.exp(log_weight - F.col("_top"))).withColumn("_l", log_weight - F.col("_top"))
    s = d.groupBy(*keys).agg(F.max("_top").alias("_top"), F.sum("_w").alias("_s"), F.sum(F.col("_w") * F.col("_w")).alias("_q"), F.sum(F.col("_w") * F.col("_l")).alias("_e"), F.count(F.lit(1)).alias("n"))
    return s.select(*keys, "n", (F.col("_top") + F.ln("_s")).alias("log_sum"), (F.col("_s") * F.col("_s") / F.col("_q")).alias("ess"), (F.ln("_s") - F.col("_e") / F.col("_s")).alias("entropy"))


def bridge_update(df: DataFrame, keys: list[str], log_weight: Column, current: Column, following: Column) -> DataFrame:
    """Adds `log_weight_next`, normalised by keys, and `log_increment`, the log ratio of evidences of one bridge: weights times following over current targets.

    keys: populations, each at one bridge.  Incoming weights need not be normalised.  A particle whose weight or step isn't finite, or is
    minus infinity, weighs nothing; a population in which all do so has null results.
    """
    step = log_weight + following - current
    good = step.isNotNull() & ~F.isnan(step) & (step < float("inf")) & (step > float("-inf")) & (log_weight > float("-inf"))
    d = df.withColumns({"_w": F.when(log_weight.isNotNull() & ~F.isnan(log_weight) & (log_weight > float("-inf")), log_weight), "_s": F.when(good, step)})
    tops = d.groupBy(*keys).agg(F.max("_w").alias("_tw"), F.max("_s").alias("_ts"))
    sums = d.join(tops, keys).groupBy(*keys).agg(F.max("_ts").alias("_ts"), (F.max("_ts") + F.ln(F.sum(F.exp(F.col("_s") - F.col("_ts"))))).alias("_norm"), (F.max("_tw") + F.ln(F.sum(F.exp(F.col("_w") - F.col("_tw"))))).alias("_before"))
    out = d.join(sums, keys)
    return out.withColumns({"log_weight_next": F.when(F.col("_norm").isNotNull(), F.coalesce(F.col("_s") - F.col("_norm"), F.lit(float("-inf")))), "log_increment": F.col("_norm") - F.col("_before")}).drop("_w", "_s", "_ts", "_norm", "_before")


def conditional_ess(df: DataFrame, weight: Column, increment: Column, delta: float) -> DataFrame:
    """One row: N (sum W e^(delta l))^2 / sum W e^(2 delta l), with normalised W."""
    top = df.agg(F.max(increment).alias("_top"))
    d = df.crossJoin(F.broadcast(top)).withColumns({"_w": weight, "_e": F.exp(F.lit(delta) * (increment - F.col("_top")))})
    s = d.agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_e")).alias("a"), F.sum(F.col("_w") * F.col("_e") * F.col("_e")).alias("b"))
    return s.select((F.col("n") * F.col("a") * F.col("a") / (F.col("b") * F.col("w"))).alias("cess"), "n")


def tempering_step(df: DataFrame, weight: Column, increment: Column, remaining: float, target: float, tolerance: float = 1e-6, rounds: int = 60) -> float:
    """The largest step with a conditional effective sample size of target * N, by bisection; each probe is one aggregate."""

    def good(delta: float) -> bool:
        r = conditional_ess(df, weight, increment, delta).first()
        return r["cess"] >= target * r["n"]

    if good(remaining):
        return remaining
    lo, hi = 0.0, remaining
    for _ in range(rounds):
        if hi - lo <= tolerance:
            break
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if good(mid) else (lo, mid)
    return max(lo, min(tolerance, remaining))


def cumulative_shares(df: DataFrame, ident: str, weight: str) -> DataFrame:
    """Adds the cumulative share of total weight before and up to each row, by id; the last is exactly 1."""
    total, last = df.agg(F.sum(weight), F.max(ident)).first()
    out = running(df.withColumn("_w", F.col(weight) / F.lit(float(total or 1.0))), F.col(ident).cast("double"), ident, {"_upto": F.col("_w")})
    upto = F.when(F.col(ident) == F.lit(last), 1.0).otherwise(F.least(F.col("_upto"), F.lit(1.0)))
    return out.withColumns({"share_before": F.greatest(F.lit(0.0), F.col("_upto") - F.col("_w")), "share_upto": upto}).drop("_w", "_upto")


def systematic_counts(df: DataFrame, ident: str, weight: str, n: int, u: float) -> DataFrame:
    """(ident, copies): how many of the positions (u+i)/n fall into each row's share.  Counted in closed form, without a join."""
    c = cumulative_shares(df, ident, weight)

    def at(x: Column) -> Column:
        """Positions below x."""
        return F.least(F.lit(n), F.greatest(F.lit(0), F.ceil(F.lit(float(n)) * x - F.lit(u)))).cast("long")

    return c.select(ident, (at(F.col("share_upto")) - at(F.col("share_before"))).alias("copies"))


def stratified_counts(df: DataFrame, ident: str, weight: str, n: int, seed: int) -> DataFrame:
    """(ident, copies): positions (i+u_i)/n with u_i by hash; a row meets only the strata that its share touches."""
    c = cumulative_shares(df, ident, weight)
    a, b = F.col("share_before") * n, F.col("share_upto") * n
    strata = F.sequence(F.least(F.floor(a), F.lit(n - 1)), F.least(F.floor(b), F.lit(n - 1)))
    e = c.select(ident, a.alias("_a"), b.alias("_b"), F.explode(strata).alias("_i"))
    p = F.col("_i") + uniform(seeded_hex(seed, F.col("_i").cast("string")))
    return e.groupBy(ident).agg(F.sum(((p >= F.col("_a")) & (p < F.col("_b"))).cast("long")).alias("copies"))


def multinomial_counts(df: DataFrame, ident: str, weight: str, n: int, seed: int) -> DataFrame:
    """(ident, copies): n independent positions by hash.  The positions, n rows, are aggregated to strata first."""
    spark = df.sparkSession
    draws = spark.range(n).select(uniform(seeded_hex(seed, F.col("id").cast("string"))).alias("_p")).withColumn("_i", F.floor(F.col("_p") * n))
    c = cumulative_shares(df, ident, weight)
    e = c.select(ident, "share_before", "share_upto", F.explode(F.sequence(F.least(F.floor(F.col("share_before") * n), F.lit(n - 1)), F.least(F.floor(F.col("share_upto") * n), F.lit(n - 1)))).alias("_i"))
    j = e.join(draws, "_i", "left")
    return j.groupBy(ident).agg(F.sum(F.coalesce(((F.col("_p") >= F.col("share_before")) & (F.col("_p") < F.col("share_upto"))).cast("long"), F.lit(0))).alias("copies"))


def residual_counts(df: DataFrame, ident: str, weight: str, n: int, u: float) -> DataFrame:
    """(ident, copies): floor(n p) sure copies, the rest systematically by what is left."""
    total = float(df.agg(F.sum(weight)).first()[0] or 1.0)
    d = df.select(ident, (F.lit(float(n)) * F.col(weight) / F.lit(total)).alias("_x")).withColumn("_sure", F.floor("_x")).withColumn("_rest", F.col("_x") - F.col("_sure"))
    left = n - int(d.agg(F.sum("_sure")).first()[0] or 0)
    extra = systematic_counts(d, ident, "_rest", left, u) if left else d.select(ident, F.lit(0).alias("copies"))
    return d.select(ident, "_sure").join(extra, ident).select(ident, (F.col("_sure") + F.col("copies")).alias("copies"))


def credible_mass(df: DataFrame, keys: list[str], exact: str, approx: str, level: float = 0.95) -> DataFrame:
    """By keys (each a finite bank): exact mass of the smallest set that reaches the level under the approximation."""
    w = Window.partitionBy(*keys).orderBy(F.desc(approx), F.desc(exact)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_b", F.coalesce(F.sum(approx).over(w), F.lit(0.0))).where(F.col("_b") < level).groupBy(*keys).agg(F.sum(exact).alias("mass"), F.count(F.lit(1)).alias("n"))


def pit_basis(u: Column) -> list[Column]:
    """Three bounded polynomials of a probability transform."""
    return [2 * u - 1, 6 * u * (1 - u) - 1, 20 * u * u * u - 30 * u * u + 12 * u - 1]


def pit_eprocess(df: DataFrame, key: str, order: Column, ident: str, u: Column, alpha: float = 0.01) -> DataFrame:
    """By key: length, log of the final mixture of twelve betting capitals, its largest value, and the first position that reaches 1/alpha (-1 if none).

    Capitals are running sums of ln(1 + lambda h); |lambda h| is at most .8, so the logarithm is safe.
    """
    bets = {f"_c{i}": F.log1p(F.lit(lam) * h) for i, (h, lam) in enumerate((h, lam) for h in pit_basis(u) for lam in PIT_LAMBDAS)}
    r = running(df, order, ident, {"_t": F.lit(1), **bets}, [key])
    cs = [F.col(c) for c in bets]
    top = F.greatest(*cs)
    mixture = top + F.ln(sum((F.exp(c - top) for c in cs), F.lit(0.0)) / len(cs))
    r = r.withColumn("_m", mixture)
    return r.groupBy(key).agg(F.max("_t").alias("n"), F.max_by("_m", "_t").alias("log_e"), F.max("_m").alias("max_log_e"), F.coalesce(F.min(F.when(F.col("_m") >= math.log(1 / alpha), F.col("_t"))), F.lit(-1)).alias("first_crossing"))


def root_summary(df: DataFrame, keys: list[str], root: str) -> DataFrame:
    """By keys: exact number of distinct roots and the entropy of their counts over its largest possible value."""
    c = df.groupBy(*keys, root).agg(F.count(F.lit(1)).alias("_n"))
    n, k = F.sum("_n"), F.count(F.lit(1))
    h = F.ln(n) - F.sum(F.col("_n") * F.ln("_n")) / n
    return c.groupBy(*keys).agg(n.alias("n"), k.alias("n_roots"), F.when(n > 1, h / F.ln(n)).otherwise(0.0).alias("normalised_entropy"))


def genealogy_event(before: DataFrame, after: DataFrame, root: str, parent: str) -> DataFrame:
    """One row: roots before and after a resampling, their retention, distinct parents and the largest family's share; foreign counts new roots."""
    a, b = before.select(root).distinct(), after.select(root).distinct()
    families = after.groupBy(parent).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("n_parents"), (F.max("_n") / F.sum("_n")).alias("largest_share"))
    counts = a.agg(F.count(F.lit(1)).alias("roots_before")).crossJoin(b.agg(F.count(F.lit(1)).alias("roots_after"))).crossJoin(b.join(a, root, "left_anti").agg(F.count(F.lit(1)).alias("foreign")))
    return counts.crossJoin(families).withColumn("retention", F.col("roots_after") / F.col("roots_before"))


def recomposed(maps: DataFrame, step: str, child: str, parent: str) -> DataFrame:
    """(step, child, root): each child's ancestor before the first step, by pointer doubling; null where its line is broken.

    maps: of every step, each child once with its parent among the children of the step before; steps are
    consecutive integers.  A round joins every pointer with the pointer of where it leads, so pointers of
    length 1, 2, 4, ... give all roots of T steps after log2(T) rounds, and no round sees more rows than the maps have.
    """
    spark, made = maps.sparkSession, []
    span = maps.agg(F.min(step), F.max(step)).first()
    base = (span[0] or 0) - 1
    state = written(maps.select(F.col(step).cast("long").alias("step"), F.col(child).alias("child"), F.col(parent).alias("at"), (F.col(step) - 1).cast("long").alias("level")), "pointers", made)
    for _ in range(max(0, (span[1] or 0) - base - 1).bit_length()):
        leads = state.select(F.col("step").alias("level"), F.col("child").alias("at"), F.col("at").alias("_at"), F.col("level").alias("_level"), F.lit(True).alias("_met"))
        j = state.where(F.col("level") > base).join(leads, ["level", "at"], "left")
        moved = j.select("step", "child", F.col("_at").alias("at"), F.coalesce("_level", F.lit(base)).alias("level"))
        last, made = made, []
        state = written(state.where(F.col("level") <= base).unionByName(moved), "pointers", made)
        removed(spark, last)
    return state.select(F.col("step").cast(maps.schema[step].dataType).alias(step), F.col("child").alias(child), F.col("at").alias("root"))


def genealogy_check(maps: DataFrame, step: str, child: str, parent: str, root: str) -> DataFrame:
    """By step: children, distinct roots, children whose line to the first step is broken, and those whose tracked root isn't the recomposed one."""
    r = recomposed(maps, step, child, parent)
    d = maps.select(step, child, F.col(root).alias("_tracked")).join(r, [step, child])
    return d.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("root").alias("n_roots"), F.sum(F.col("root").isNull().cast("long")).alias("n_broken"), F.sum((~F.col("root").eqNullSafe(F.col("_tracked"))).cast("long")).alias("n_wrong"))


def monotone(df: DataFrame, step: str, value: str) -> DataFrame:
    """One row: whether the value never grows from one (consecutive integer) step to the next."""
    nxt = df.select((F.col(step) - 1).alias(step), F.col(value).alias("_next"))
    return df.join(nxt, step).agg(F.coalesce(F.bool_and(F.col("_next") <= F.col(value)), F.lit(True)).alias("monotone"), F.count(F.lit(1)).alias("n_steps"))


def mh_transition(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Metropolis-Hastings matrix over finite states: (source, target, p), with what is left on the diagonal.

    states: (state, log_target); edges: (source, target, forward, reverse).
    """
    s = states.select(F.col("state").alias("source"), F.col("log_target").alias("_a"))
    t = states.select(F.col("state").alias("target"), F.col("log_target").alias("_b"))
    ratio = F.col("_b") - F.col("_a") + F.ln("reverse") - F.ln("forward")
    off = edges.join(s, "source").join(t, "target").select("source", "target", (F.col("forward") * F.exp(F.least(F.lit(0.0), ratio))).alias("p"))
    stay = s.join(off.groupBy("source").agg(F.sum("p").alias("_p")), "source", "left").select("source", F.col("source").alias("target"), (1 - F.coalesce("_p", F.lit(0.0))).alias("p"))
    return off.unionByName(stay)


def complete_proposals(states: DataFrame, kind: str = "uniform", prior: str | None = None, most: int = 4096) -> DataFrame:
    """(source, target, forward, reverse) between all pairs of a small registered set of states, at most `most`: every other state alike, or by a prior whatever the source."""
    n = states.limit(most + 1).count()
    if n > most:
        raise ValueError("too many states for a table of all pairs")
    if kind not in ("uniform", "prior"):
        raise ValueError(f"unknown kind of proposal {kind}")
    total = states.agg(F.sum(prior)).first()[0] if kind == "prior" else None
    p = F.col(prior) / F.lit(float(total)) if kind == "prior" else F.lit(1.0 / max(1, n - 1))
    a, b = states.select(F.col("state").alias("source"), p.alias("reverse")), states.select(F.col("state").alias("target"), p.alias("forward"))
    return a.join(F.broadcast(b), F.col("source") != F.col("target")).select("source", "target", "forward", "reverse")


def balance(matrix: DataFrame, target: DataFrame) -> DataFrame:
    """One row: largest detailed-balance and stationarity errors of a transition matrix; target: (state, pi)."""
    a = matrix.join(target.select(F.col("state").alias("source"), F.col("pi").alias("_pa")), "source").select("source", "target", (F.col("_pa") * F.col("p")).alias("flow"))
    b = a.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("flow").alias("back"))
    db = a.join(b, ["source", "target"], "left").agg(F.max(F.abs(F.col("flow") - F.coalesce("back", F.lit(0.0)))).alias("balance_error"))
    st = a.groupBy(F.col("target").alias("state")).agg(F.sum("flow").alias("_in")).join(target, "state").agg(F.max(F.abs(F.col("_in") - F.col("pi"))).alias("stationarity_error"))
    return db.crossJoin(st)


def reachable(edges: DataFrame, start: Column) -> DataFrame:
    """States that the edge list reaches from the start, by rounds of joins until nothing is new: as many rounds as the longest shortest path.

    A round writes what it finds first and nothing else; what was found before is the fronts that are there, read as one table.
    """
    spark, fronts = edges.sparkSession, []
    front = written(edges.select(start.alias("state")).limit(1), "reach", fronts)
    while not front.isEmpty():
        seen = spark.read.schema(front.schema).parquet(*fronts)
        front = written(edges.join(front, edges["source"] == front["state"]).select(F.col("target").alias("state")).distinct().join(seen, "state", "left_anti"), "reach", fronts)
    return spark.read.schema(front.schema).parquet(*fronts)
