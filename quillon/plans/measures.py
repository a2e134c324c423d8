"""Queries on metrics, paired statistics, ranking, resampling and information, each with equal SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.columns import Z975, small_t
from quillon.operators import certify, discovery, distance, information, metrics, ranking, roles, sequential
from quillon.operators.ordered import quantiles, ranked
from quillon.sources.shared import written
from quillon.sources.tables import table

SIZE = 64


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"), "l_quantity", "l_discount", "l_tax")


_PRED = "p AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    return predicted(spark, sf_dir).groupBy("l_returnflag").agg(F.round(metrics.mse(y, p), 2).alias("mse"), F.round(metrics.r2(y, p), 8).alias("r2"), F.round(metrics.nmse(y, p), 8).alias("nmse"), F.round(metrics.safe_corr(y, p), 8).alias("corr"))


def tail_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.tail_block(predicted(spark, sf_dir), F.col("y"), F.col("p"), ["l_returnflag"])
    return d.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("nmse", "max_rel", "share_01", "p99", "p995")])


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of orders by the rank of their price; the worst fold is the largest error."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), (F.col("o_custkey") * 10.0).alias("p"))
    d = ranked(d, F.abs("y"), "o_orderkey", "rk").withColumn("fold", F.floor(F.col("rk") * 5 / F.lit(d.count())).cast("int"))
    return d.groupBy("fold").agg(F.round(metrics.nmse(F.col("y"), F.col("p")), 6).alias("nmse"), F.count(F.lit(1)).alias("n"))


def ood_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the [.05, .95] range of any feature, the range taken from early rows."""
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity")
    train = d.where(F.year("l_shipdate") <= 1998)
    out = F.lit(False)
    for c in ("l_extendedprice", "l_quantity"):
        q = {r.level: r.q for r in quantiles(train, F.col(c).cast("double"), [0.05, 0.95]).collect()}
        out = out | (F.col(c) < q[0.05]) | (F.col(c) > q[0.95])
    return d.where(out).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


def entropy_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.entropy(table(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", F.round("entropy", 8).alias("entropy"), "n")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount").select("n", F.round("rho", 8).alias("rho"))


def mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.mean_ci(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], F.col("o_totalprice"), "price")
    return d.select("o_orderpriority", "o_orderstatus", *[F.round(c, 4).alias(c) for c in ("price_mean", "price_low", "price_high", "price_std")], "n")


def _t(df: str) -> str:
    z = Z975
    cs = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    series = f"{z!r}" + "".join(f" + {c!r}/power({df}, {k})" for k, c in enumerate(cs, 1))
    return f"CASE WHEN {df} = 1 THEN tan(pi()*0.475) WHEN {df} = 2 THEN 2*0.475*sqrt(2/(4*0.975*0.025)) ELSE {series} END"


_SMALL = "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in small_t()) + "]"
_HALF = f"CASE WHEN n > 41 THEN ({_t('(n-1)')}) * s / sqrt(n) WHEN n > 1 THEN {_SMALL}[n-1] * s / sqrt(n) ELSE 0 END"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run table from orders: scope is the priority, policy the status, the paired unit the customer."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scope"), F.col("o_orderstatus").alias("policy"), F.col("o_custkey").alias("unit")).agg(F.avg("o_totalprice").alias("v"))


_RUNS = "runs AS (SELECT o_orderpriority AS scope, o_orderstatus AS policy, o_custkey AS unit, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3), d AS (SELECT scope, b.policy AS baseline, unit, a.v - b.v AS delta FROM runs a JOIN runs b USING (scope, unit) WHERE a.policy = 'F' AND b.policy <> 'F')"


def paired_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.paired_effects(metrics.paired_deltas(runs(spark, sf_dir), "scope", "unit", "policy", "F", "v"), "scope")
    return d.select("scope", "baseline", *[F.round(c, 3).alias(c) for c in ("delta_mean", "delta_low", "delta_high", "delta_std")], F.round("worse_share", 6).alias("worse_share"), "n")


def real_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in four roles, the extremes of price apart."""
    d, _ = roles.split(table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("y")), ["price"], "y", "p_partkey", 0.7, 0.15, 0.1, "feature0", 7)
    return d.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"), F.sum("p_partkey").alias("keys"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(island, new, old): metric vectors made of parts' columns, to put gates to the test."""
    d = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 2000).alias("v"), (F.col("p_size") / 50.0).alias("s"))
    value = {"val_nmse": "v", "val_strict": "s", "val_p99": "v * s", "val_p995": "v", "stress_nmse": "s", "stress_strict": "v", "stress_p99": "v * 0.5", "ood_nmse": "v * v", "ood_strict": "s", "ood_penalty": "v", "complexity": "s * 40"}
    new = F.struct(*[F.expr(value[m]).cast("double").alias(m) for m in discovery.METRICS], F.lit("new").alias("digest"))
    old = F.struct(*[F.lit(20.0 if m == "complexity" else 0.7).alias(m) for m in discovery.METRICS], F.lit("old").alias("digest"))
    island = F.element_at(F.array(*map(F.lit, sorted(discovery.ISLANDS))), (F.col("p_partkey") % len(discovery.ISLANDS) + 1).cast("int"))
    return d.select(island.alias("island"), new.alias("new"), old.alias("old"))


def discovery_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many metric vectors dominate the old one, and are accepted, by island."""
    policy, new, old = discovery.Policy(), F.col("new"), F.col("old")
    d = metric_rows(spark, sf_dir).select("island", discovery.dominates(new, old, policy).alias("beats"), discovery.accepts(new, old, F.col("island"), policy).alias("accepted"), discovery.island_score(new, F.col("island")).alias("score"))
    return d.groupBy("island").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("beats").cast("long")).alias("beats"), F.sum(F.col("accepted").cast("long")).alias("accepted"), F.round(F.avg("score"), 8).alias("score"))


def projection_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass of suppliers by the bin of two intervals about their balance; null where an interval crosses an edge."""
    s = table(spark, sf_dir, "supplier")
    mass = F.lit(1.0) / F.lit(s.count())
    rows = s.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("coordinate"), (F.col("s_acctbal") / 10000).alias("b"))
    rows = rows.select(F.col("s_suppkey").alias("state"), mass.alias("mass"), "coordinate", (F.col("b") - 0.02 * (F.col("coordinate") + 1)).alias("lower"), (F.col("b") + 0.02).alias("upper"))
    return certify.projection_bounds(rows, [0.25, 0.75]).select("class_rank", F.round("mass", 9).alias("mass"))


_SAFE = " AND ".join(f"{v} <= 0.7 * 1.01 + 1e-12" for v in ("v", "s", "v * s", "v * 0.5", "v * v"))
_DOM = " AND ".join(f"{v} <= 0.7 * 1.01 + 1e-12" for v in ("v", "s", "v * 0.5", "v * v"))
_G = "(0.45*(1-v/0.7) + 0.125*(1-v*s/0.7) + 0.125*(1-s/0.7) + 0.1*(1-s/0.7) + 0.1*(1-v*0.5/0.7) + 0.05*(1-v*v/0.7) + 0.05*(1-s/0.7))"
_COST = "0.2*least(1.0, greatest(0.0, s*40-20)/36.0)"


def _score_sql(v: str, s: str, vs: str, p: str, vv: str, size: str) -> str:
    common = f"2.5*ln(1+{v}) + 0.7*ln(1+{s}) + 0.5*ln(1+{vv}) + 0.15*ln(1+{v})"
    return f"CASE island WHEN 'balanced' THEN {common} + 0.65*ln(1+{vs}) + 0.35*ln(1+{s}) + 0.02*{size} WHEN 'nmse' THEN {common} + 0.25*ln(1+{vs}) + 0.01*{size} WHEN 'tail' THEN {common} + 1.5*ln(1+{s}) + 1.2*ln(1+{vs}) + 0.7*ln(1+{p}) + 0.012*{size} WHEN 'low_complexity' THEN {common} + 0.25*ln(1+{vs}) + 0.05*{size} ELSE {common} + 0.4*ln(1+{vs}) + 0.015*{size} END"


_GATES_SQL = f"""WITH d AS (SELECT ['balanced', 'low_complexity', 'nmse', 'novelty', 'tail'][p_partkey % 5 + 1] AS island, p_retailprice / 2000 AS v, p_size / 50.0 AS s FROM part),
g AS (SELECT *, {_G} AS gain, {_COST} AS cost, {_score_sql("v", "s", "(v*s)", "(v*0.5)", "(v*v)", "(s*40)")} AS score, {_score_sql("0.7", "0.7", "0.7", "0.7", "0.7", "20")} AS before FROM d),
a AS (SELECT *, score - CASE WHEN island = 'novelty' THEN 0.3 ELSE 0 END AS after FROM g)
SELECT island, count(*) AS n, CAST(sum(CASE WHEN {_DOM} AND v <= 1.25 AND (gain - cost >= 0.01 OR s * 40 < 20) AND gain >= cost - 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS beats,
CAST(sum(CASE WHEN {_SAFE} AND v <= 1.25 AND ((before - after) / abs(before) >= 0.01 OR gain - cost >= 0.01) THEN 1 ELSE 0 END) AS BIGINT) AS accepted, round(avg(score), 8) AS score FROM a GROUP BY island"""
_SPLIT_SQL = """WITH d AS (SELECT min(p_partkey) AS k, p_retailprice AS price FROM part GROUP BY p_retailprice, p_size), c AS (SELECT count(*) AS n, least(greatest(2, CAST(round_even(count(*) * 0.25, 0) AS BIGINT)), count(*) - 4) AS extra FROM d),
r AS (SELECT k, price, row_number() OVER (ORDER BY price, k) - 1 >= n - extra AS far, n, extra FROM d, c),
h AS (SELECT *, row_number() OVER (PARTITION BY far ORDER BY sha256('7:' || k)) - 1 AS place FROM r)
SELECT CASE WHEN far THEN CASE WHEN place < CAST(round_even(extra * 0.15 / 0.25, 0) AS BIGINT) THEN 'acquisition-pool' ELSE 'untouched-heldout' END ELSE CASE WHEN place < CAST(round_even((n - extra) * 0.7, 0) AS BIGINT) THEN 'development' ELSE 'validation' END END AS role,
count(*) AS n, round(sum(price), 2) AS price, CAST(sum(k) AS BIGINT) AS keys FROM h GROUP BY 1"""
_PROJECTION_SQL = """WITH s AS (SELECT s_suppkey, s_acctbal / 10000 AS b, 1.0 / (SELECT count(*) FROM supplier) AS m FROM supplier),
x AS (SELECT *, (b - 0.02 >= 0.25)::INT + (b - 0.02 >= 0.75)::INT AS l0, (b + 0.02 >= 0.25)::INT + (b + 0.02 >= 0.75)::INT AS h0, (b - 0.04 >= 0.25)::INT + (b - 0.04 >= 0.75)::INT AS l1 FROM s)
SELECT CAST(CASE WHEN l0 = h0 AND l1 = h0 THEN l0 + 3 * l1 END AS BIGINT) AS class_rank, round(sum(CAST(m AS DOUBLE)), 9) AS mass FROM x GROUP BY 1"""


def signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.wilcoxon_holm(metrics.paired_deltas(runs(spark, sf_dir), "scope", "unit", "policy", "F", "v"), ["scope", "baseline"])
    return d.select("scope", "baseline", "n", F.round("mean", 3).alias("mean"), F.round("median", 3).alias("median"), "n_wins", "n_ties", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


_TAIL = "exp(-z*z/2)/2.5066282746310002*(0.319381530*t + -0.356563782*power(t,2) + 1.781477937*power(t,3) + -1.821255978*power(t,4) + 1.330274429*power(t,5))"


def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: means of units first, then of their means."""
    r = runs(spark, sf_dir).groupBy("policy", "unit").agg(F.avg("v").alias("u"))
    return r.groupBy("policy").agg(F.round(F.avg("u"), 4).alias("family_mean"), F.count(F.lit(1)).alias("n_units"))


def quantified_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = metrics.paired_effects(metrics.paired_deltas(runs(spark, sf_dir), "scope", "unit", "policy", "F", "v"), "scope")
    return e.groupBy("scope").agg(F.bool_and(F.col("delta_mean") <= 0).alias("all_gain"), F.bool_and(F.col("worse_share") <= 0.25).alias("all_safe"), F.count(F.lit(1)).alias("n_baselines"))


def area_under_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.area_under_curve(table(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"), F.col("value"))
    return d.select("user_id", "n", F.round("area", 4).alias("area"), F.round("normalised", 6).alias("normalised"))


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("quillon_lineitem")
    return spark.sql("SELECT l_returnflag, l_linenumber, round(avg(l_extendedprice), 4) AS mean_price, count(*) AS n FROM quillon_lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_linenumber))")


def value_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events")
    med = quantiles(d, F.col("value"), [0.5], ["event_type"]).select("event_type", F.round("q", 8).alias("median"))
    return d.groupBy("event_type").agg(F.min("value").alias("min"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std")).join(med, "event_type")


def paired_linf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest difference between two labels' category shares, per year, missing categories counting zero."""
    d = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr"), "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("c"))
    t = d.groupBy("yr", "o_orderstatus").agg(F.sum("c").alias("t"))
    d = d.join(t, ["yr", "o_orderstatus"]).withColumn("p", F.col("c") / F.col("t"))
    a, b = (d.where(F.col("o_orderstatus") == x).select("yr", "o_orderpriority", F.col("p").alias(n)) for x, n in (("F", "a"), ("O", "b")))
    j = a.join(b, ["yr", "o_orderpriority"], "full_outer").select("yr", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    return j.groupBy("yr").agg(F.round(F.max(F.abs(F.col("a") - F.col("b"))), 8).alias("linf"), F.round(0.5 * F.sum(F.abs(F.col("a") - F.col("b"))), 8).alias("tv"))


def move_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON of events flattened and summed by key."""
    d = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("k", "v"))
    return d.groupBy("event_type", "k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last less first yearly mean."""
    m = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("yr")).agg(F.avg("o_totalprice").alias("m"))
    return m.groupBy("o_orderpriority").agg(F.round(F.max_by("m", "yr") - F.min_by("m", "yr"), 4).alias("change"), F.count(F.lit(1)).alias("n_years"))


def failure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    d = predicted(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(metrics.nmse(y, p).alias("nmse"), F.avg((metrics.relative_error(y, p) <= 0.1).cast("int")).alias("strict"), F.max(metrics.relative_error(y, p)).alias("worst"))
    tags = F.array_compact(F.array(F.when(F.col("nmse") > 0.05, F.lit("high_nmse")), F.when(F.col("strict") < 0.5, F.lit("low_strict")), F.when(F.col("worst") > 1.25, F.lit("tail"))))
    return d.select("l_returnflag", "l_linestatus", F.array_join(tags, ",").alias("tags"))


def candidate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.col("n_nationkey"))).alias("r"))
    return q.groupBy("n_nationkey").agg(F.sum(128 - F.col("r")).alias("evaluations"))


def stable_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("score"))
    return ranking.stable_argmax(d, ["p_brand"], "score", "p_partkey")


def rank_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("s"), (F.col("p_size") / 1000).alias("e"))
    return ranking.certificate(d, ["p_brand"], "s", "e", "p_partkey").select("p_brand", "leader", F.round("gap", 6).alias("gap"), "certified")


def envelope_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_type", "p_partkey", (F.col("p_retailprice") - F.col("p_size")).alias("lo"), (F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    return ranking.envelope_certificate(d, ["p_type"], "lo", "hi", "p_partkey")


def supplier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 8).alias("m1"), F.round(F.avg("l_tax"), 8).alias("m2"), F.round(-F.avg("l_extendedprice") / 1e5, 8).alias("m3"))


def pareto_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pareto_front(supplier_metrics(spark, sf_dir), "l_suppkey", ["m1", "m2", "m3"])


_SUPP = "s AS (SELECT l_suppkey, round(avg(l_discount), 8) AS m1, round(avg(l_tax), 8) AS m2, round(-avg(l_extendedprice)/1e5, 8) AS m3 FROM lineitem GROUP BY 1)"


def pareto_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = supplier_metrics(spark, sf_dir)
    c = {"val_nmse": F.col("m1"), "stress_nmse": F.col("m2"), "ood_nmse": F.abs("m3"), "ood_penalty": F.col("m1") * F.col("m2")}
    return d.select("l_suppkey", F.round(ranking.pareto_score(c), 6).alias("score"))


def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight users whose kinds of events are most like the wanted ones."""
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("tokens"), F.round(F.avg("value") / 100, 6).alias("gain"), F.round(F.count(F.lit(1)) / 1000, 6).alias("stab"))
    return ranking.retrieve(d, "tokens", ["click", "error", "signup"], F.col("gain"), F.col("stab"), 8, "user_id").select("user_id", F.round("score", 6).alias("score"))


def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part")
    return ranking.best_per_group(d, ["p_type"], [-F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")], ["p_partkey", "p_retailprice"])


def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    a, b = (d.where(F.col("l_returnflag") == x).select("l_quantity", "l_discount") for x in ("R", "A"))
    return ranking.multiset_diff(a, b, ["l_quantity", "l_discount"]).groupBy("l_quantity").agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b")).select("l_quantity", "only_a", "only_b", ranking.edit_action(F.col("only_a"), F.col("only_b")).alias("action"))


def reference_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") / 1000).alias("lo"), (F.col("s_acctbal") / 1000 + 0.5).alias("hi"), (F.abs("s_acctbal") + 1).alias("ref"))
    return ranking.reference_dominance(d, ["s_nationkey"], "s_suppkey", "lo", "hi", "ref").select("s_nationkey", "leader", F.round("leader_lower", 6).alias("leader_lower"), F.round("reference_upper", 6).alias("reference_upper"), "hands_over")


def user_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(F.abs("value")), 4).alias("w"))


_UW = "w AS (SELECT user_id, round(sum(abs(value)), 4) AS w FROM events GROUP BY 1), c AS (SELECT user_id, w, w/sum(w) OVER () AS p, sum(w) OVER (ORDER BY user_id)/sum(w) OVER () AS upto FROM w)"


def systematic_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.systematic_counts(user_weights(spark, sf_dir), "user_id", "w", SIZE, 0.37)


def stratified_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.stratified_counts(user_weights(spark, sf_dir), "user_id", "w", SIZE, 7)


def multinomial_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.multinomial_counts(user_weights(spark, sf_dir), "user_id", "w", SIZE, 7)


def residual_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.residual_counts(user_weights(spark, sf_dir), "user_id", "w", 1000, 0.37).agg(F.sum("copies").cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


_U = "CAST(CAST('0x' || substr(sha256('7:' || CAST({0} AS VARCHAR)), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"


def weight_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequential.weight_stats(table(spark, sf_dir, "events"), ["event_type"], F.col("value") / 50)
    return d.select("event_type", "n", F.round("log_sum", 6).alias("log_sum"), F.round("ess", 4).alias("ess"), F.round("entropy", 6).alias("entropy"))


def conditional_ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = user_weights(spark, sf_dir)
    t = float(w.agg(F.sum("w")).first()[0])
    d = sequential.conditional_ess(w, F.col("w") / t, F.col("w") / 1000, 0.25)
    return d.select(F.round("cess", 5).alias("cess"), "n")


def credible_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type, users' exact shares against a smoothed version."""
    c = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("state")).agg(F.count(F.lit(1)).alias("c"))
    t = c.groupBy("event_type").agg(F.sum("c").alias("t"))
    d = c.join(t, "event_type").select("event_type", "state", (F.col("c") / F.col("t")).alias("p"), (F.col("c") * F.col("c") / (F.col("t") * 1.0)).alias("z"))
    z = d.groupBy("event_type").agg(F.sum("z").alias("zs"))
    d = d.join(z, "event_type").select("event_type", "p", (F.col("z") / F.col("zs")).alias("q"))
    return sequential.credible_mass(d, ["event_type"], "p", "q").select("event_type", F.round("mass", 8).alias("mass"), "n")


def pit_eprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("event_type", "event_id", (1 - F.exp(-F.abs("value") / 40)).alias("u"))
    e = sequential.pit_eprocess(d, "event_type", F.col("event_id").cast("double"), "event_id", F.col("u"))
    return e.select("event_type", "n", F.round("log_e", 5).alias("log_e"), F.round("max_log_e", 5).alias("max_log_e"), "first_crossing")


_HS = ("2*u-1", "6*u*(1-u)-1", "20*u*u*u-30*u*u+12*u-1")
_BETS = [f"sum(ln(1 + {lam}*({h}))) OVER w" for h in _HS for lam in sequential.PIT_LAMBDAS]


def root_genealogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("step"), "o_custkey")
    return sequential.root_summary(d, ["step"], "o_custkey").select("step", "n", "n_roots", F.round("normalised_entropy", 8).alias("normalised_entropy"))


def genealogy_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderpriority").alias("parent"), "o_orderstatus")
    return sequential.genealogy_event(d, d.where(F.col("o_orderstatus") == "F"), "root", "parent").select("roots_before", "roots_after", "foreign", "n_parents", F.round("largest_share", 8).alias("largest_share"), F.round("retention", 8).alias("retention"))


def root_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("step")).agg(F.countDistinct("o_custkey").alias("v"))
    return sequential.monotone(d, "step", "v")


def priority_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Priorities as states with their log counts, and a ring of proposals with self-made odds."""
    s = table(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("state")).agg(F.count(F.lit(1)).alias("c")).select("state", F.ln("c").alias("log_target"))
    e = spark.createDataFrame([(a, (a + d - 1) % 5 + 1, 0.5, 0.5) for a in range(1, 6) for d in (1, 4)], "source int, target int, forward double, reverse double")
    return s, e


def mh_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.mh_transition(*priority_states(spark, sf_dir)).select("source", "target", F.round("p", 8).alias("p"))


def mh_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = priority_states(spark, sf_dir)
    t = s.agg(F.sum(F.exp("log_target")).alias("t"))
    pi = s.crossJoin(F.broadcast(t)).select("state", (F.exp("log_target") / F.col("t")).alias("pi"))
    return sequential.balance(sequential.mh_transition(s, e), pi).select(F.round("balance_error", 10).alias("balance_error"), F.round("stationarity_error", 10).alias("stationarity_error"))


def reachable_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that a chain of neighbouring keys within a region reaches from nation 0."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    m = n.select(F.col("n_nationkey").alias("target"), "n_regionkey")
    e = n.withColumnRenamed("n_nationkey", "source").join(m, "n_regionkey").where("source <> target").select("source", "target")
    return sequential.reachable(e, F.lit(0)).select(F.col("state").cast("int").alias("state"))


def discrete_eig(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("action"), "o_orderpriority", "o_orderstatus", F.lit(1.0).alias("p"))
    return information.discrete_mi(d, ["action"], "o_orderpriority", "o_orderstatus", "p").select("action", F.round("mi", 8).alias("mi"), F.round("class_entropy", 8).alias("class_entropy"))


def _likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("action"), "o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("c"))
    s = c.groupBy("action", "o_orderpriority").agg(F.sum("c").alias("cs"))
    t = c.groupBy("action").agg(F.sum("c").alias("ct"))
    return c.join(s, ["action", "o_orderpriority"]).join(t, "action").select("action", "o_orderpriority", "o_orderstatus", (F.col("cs") / F.col("ct")).alias("prior"), (F.col("c") / F.col("cs")).alias("lik"))


def update_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = information.update_utility(_likelihoods(spark, sf_dir), ["action"], "o_orderpriority", "o_orderstatus", "prior", "lik", 0.5)
    return d.select("action", *[F.round(c, 8).alias(c) for c in ("entropy_before", "entropy_after", "utility")])


_LIK = "c AS (SELECT year(o_orderdate) AS action, o_orderpriority AS s, o_orderstatus AS y, count(*) AS c FROM orders GROUP BY 1, 2, 3), l AS (SELECT action, s, y, sum(c) OVER (PARTITION BY action, s) / sum(c) OVER (PARTITION BY action) AS prior, c / sum(c) OVER (PARTITION BY action, s) AS lik FROM c)"


def mixture_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures of t laws made from parts: one action a brand."""
    d = table(spark, sf_dir, "part")
    t = d.groupBy("p_brand").agg(F.sum("p_size").alias("t"))
    c = d.join(t, "p_brand").select("p_brand", (F.col("p_size") / F.col("t")).alias("w"), (F.col("p_size") + 3.0).alias("df"), (F.col("p_retailprice") / 100).alias("loc"), (F.col("p_size") / 10).alias("scale"))
    m = information.predictive_moments(c, "p_brand")
    return m.select("p_brand", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))


def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every vector whose id is divisible by 20, against all vectors."""
    d = table(spark, sf_dir, "embeddings")
    return distance.nearest(d, "vec_id", "embedding", d.where("vec_id % 20 = 0")).select("query_id", "nn_id", F.round("distance", 5).alias("distance"))


def label_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and kernel of label centers (a registered design of ten), with the median positive distance as bandwidth."""
    k = distance.kernel_table(distance.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding", 64), "label", "center")
    h = quantiles(k.where("a < b AND d2 > 0"), F.col("d2"), [0.5]).first()["q"]
    return k.select("a", "b", F.round("d2", 5).alias("d2"), F.round(F.exp(-0.5 * F.col("d2") / h), 5).alias("k"))


def label_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared MMD from the first three centers to all of them, now and with each other center added."""
    k = distance.kernel_table(distance.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding", 64), "label", "center")
    k = k.withColumns({"oa": F.col("a") < 3, "ob": F.col("b") < 3, "ta": F.lit(True), "tb": F.lit(True)})
    return distance.mmd_augmented(k, F.col("oa"), F.col("ta"), 1.0).where("candidate >= 3").select("candidate", F.round("current", 6).alias("current"), F.round("augmented", 6).alias("augmented"), (F.col("augmented") <= F.col("current")).alias("safe"))


_CEN = "e AS (SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings), m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM e GROUP BY 1, 2), k AS (SELECT x.label AS a, y.label AS b, sum((x.v-y.v)*(x.v-y.v)) AS d2 FROM m x JOIN m y USING (i) GROUP BY 1, 2)"


def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification of a hash chain over the event log: as it is, with one payload altered, and with that event's own digest made to fit again."""
    from quillon.operators.evidence import chained, content_hash, verify

    log = written(chained(table(spark, sf_dir, "events")), "chain")
    hit = F.col("seq") == 100
    altered = log.withColumn("payload", F.when(hit, F.lit("altered")).otherwise(F.col("payload")))
    refitted = altered.withColumn("event_hash", F.when(hit, content_hash(F.col("seq"), F.col("payload"), F.col("previous_hash"))).otherwise(F.col("event_hash")))
    cases = {"as it is": log, "altered": altered, "refitted": refitted}
    out = [verify(x).select(F.lit(k).alias("log"), "n_events", (F.col("wrong_hashes") > 0).alias("wrong_hashes"), (F.col("broken_links") > 0).alias("broken_links"), "duplicate_ids", "valid") for k, x in cases.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


def island_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-middle median over islands (users) of each coordinate's (event type's) count."""
    c = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).cast("double").alias("c"))
    n = c.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    r = ranked(c, F.col("c"), "user_id", "rk", ["event_type"]).join(n, "event_type").where("rk = (n - 1) div 2")
    return r.select("event_type", F.col("c").cast("long").alias("median"), F.col("n").alias("n_islands"))


def particle_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample size bounds and exact majority failure tails over a grid from nations."""
    from quillon.operators.grammar import majority_failure, particle_lower_bound

    d = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("s"), (2 * F.col("n_nationkey") + 1).alias("islands"))

    @F.pandas_udf("struct<particles:long,failure:double>")
    def bounds(steps: pd.Series, islands: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"particles": [particle_lower_bound(int(s), 0.5, 0.1) for s in steps], "failure": [float(majority_failure(int(k))) for k in islands]})

    return d.select("s", "islands", bounds("s", "islands").alias("b")).select("s", "islands", "b.particles", F.round("b.failure", 10).alias("failure"))


def grammar_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.grammar import Grammar

    return Grammar(1, 0.4).masses(spark, 10).select("size", "expressions", F.round("mass", 10).alias("mass"), F.round("tail", 10).alias("tail"))


QUERIES = {
    "regression_metrics": (regression_metrics, f"WITH {_PRED} SELECT l_returnflag, round(avg((y-p)*(y-p)), 2) AS mse, round(1 - sum((y-p)*(y-p))/(var_pop(y)*count(*)), 8) AS r2, round(avg((y-p)*(y-p))/var_pop(y), 8) AS nmse, round(corr(y, p), 8) AS corr FROM p GROUP BY 1"),
    "tail_metrics": (tail_metrics, f"WITH {_PRED}, e AS (SELECT *, abs(y-p)/greatest(abs(y), 1e-6) AS rel FROM p) SELECT l_returnflag, round(avg((y-p)*(y-p))/var_pop(y), 6) AS nmse, round(max(rel), 6) AS max_rel, round(avg(CASE WHEN rel <= 0.1 THEN 1 ELSE 0 END), 6) AS share_01, round(quantile_cont(rel, 0.99), 6) AS p99, round(quantile_cont(rel, 0.995), 6) AS p995 FROM e GROUP BY 1"),
    "fold_metrics": (fold_metrics, "WITH r AS (SELECT o_totalprice AS y, o_custkey*10.0 AS p, row_number() OVER (ORDER BY abs(o_totalprice), o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM orders) SELECT CAST(floor(rk*5/n) AS INTEGER) AS fold, round(avg((y-p)*(y-p))/var_pop(y), 6) AS nmse, count(*) AS n FROM r GROUP BY 1"),
    "ood_extremes": (ood_extremes, "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) a, quantile_cont(l_extendedprice, 0.95) b, quantile_cont(l_quantity, 0.05) c, quantile_cont(l_quantity, 0.95) d FROM lineitem WHERE year(l_shipdate) <= 1998) SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem, q WHERE l_extendedprice < a OR l_extendedprice > b OR l_quantity < c OR l_quantity > d GROUP BY 1"),
    "entropy_by_user": (entropy_by_user, "WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), p AS (SELECT user_id, c, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p*ln(p)), 8) + 0.0 AS entropy, CAST(sum(c) AS BIGINT) AS n FROM p GROUP BY 1"),
    "spearman": (spearman, "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1)/2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1)/2.0 AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 8) AS rho FROM r"),
    "real_split": (real_split, _SPLIT_SQL), "discovery_gates": (discovery_gates, _GATES_SQL), "projection_bounds": (projection_bounds, _PROJECTION_SQL),
    "mean_ci": (mean_ci, f"WITH g AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m, coalesce(stddev_samp(o_totalprice), 0) AS s, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderpriority, o_orderstatus, round(m, 4) AS price_mean, round(m - {_HALF}, 4) AS price_low, round(m + {_HALF}, 4) AS price_high, round(s, 4) AS price_std, n FROM g"),
    "paired_effects": (paired_effects, f"WITH {_RUNS}, g AS (SELECT scope, baseline, avg(delta) AS m, coalesce(stddev_samp(delta), 0) AS s, count(*) AS n, avg(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS w FROM d GROUP BY 1, 2) SELECT scope, baseline, round(m, 3) AS delta_mean, round(m - {_HALF}, 3) AS delta_low, round(m + {_HALF}, 3) AS delta_high, round(s, 3) AS delta_std, round(w, 6) AS worse_share, n FROM g"),
    "signed_rank": (signed_rank, f"WITH {_RUNS}, a AS (SELECT *, round(abs(delta), 12) AS ad FROM d), r AS (SELECT *, rank() OVER (PARTITION BY scope, baseline ORDER BY ad) + (count(*) OVER (PARTITION BY scope, baseline, ad) - 1)/2.0 AS rk, count(*) OVER (PARTITION BY scope, baseline, ad) AS tie FROM a WHERE ad > 0), w AS (SELECT scope, baseline, sum(CASE WHEN delta < 0 THEN rk ELSE 0 END) AS w, count(*) AS m, sum(tie*tie - 1) AS ties3 FROM r GROUP BY 1, 2), g AS (SELECT scope, baseline, count(*) AS n, avg(delta) AS mean, quantile_cont(delta, 0.5) AS median, count(*) FILTER (delta < 0) AS n_wins, count(*) FILTER (ad = 0) AS n_ties FROM a GROUP BY 1, 2), z AS (SELECT g.*, coalesce(m, 0) AS m0, CASE WHEN m > 0 THEN (w - m*(m+1)/4.0 - 0.5)/sqrt(m*(m+1)*(2*m+1)/24.0 - ties3/48.0) ELSE 0 END AS z FROM g LEFT JOIN w USING (scope, baseline)), t AS (SELECT *, 1/(1 + 0.2316419*abs(z)) AS t FROM z) SELECT scope, baseline, n, round(mean, 3) AS mean, round(median, 3) AS median, n_wins, n_ties, round(p, 6) AS p, round(max(least(1.0, p * (k - i + 1))) OVER (PARTITION BY scope ORDER BY i), 6) AS p_holm FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY p, baseline) AS i, count(*) OVER (PARTITION BY scope) AS k FROM (SELECT *, CASE WHEN z >= 0 THEN {_TAIL} ELSE 1 - {_TAIL} END AS p FROM t))"),
    "family_means": (family_means, f"WITH {_RUNS}, u AS (SELECT policy, unit, avg(v) AS u FROM runs GROUP BY 1, 2) SELECT policy, round(avg(u), 4) AS family_mean, count(*) AS n_units FROM u GROUP BY 1"),
    "quantified_gates": (quantified_gates, f"WITH {_RUNS}, g AS (SELECT scope, baseline, avg(delta) AS m, avg(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS w FROM d GROUP BY 1, 2) SELECT scope, bool_and(m <= 0) AS all_gain, bool_and(w <= 0.25) AS all_safe, count(*) AS n_baselines FROM g GROUP BY 1"),
    "area_under_curve": (area_under_curve, "WITH o AS (SELECT user_id, value, lead(value) OVER w AS nxt, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS n, round(coalesce(sum(0.5*(value + nxt)), 0), 4) AS area, round(CASE WHEN count(*) > 1 AND max(CASE WHEN k = 1 THEN value END) <> 0 THEN sum(0.5*(value + nxt))/((count(*) - 1)*max(CASE WHEN k = 1 THEN value END)) END, 6) AS normalised FROM o GROUP BY 1"),
    "grouping_sets": (grouping_sets, "SELECT l_returnflag, l_linenumber, round(avg(l_extendedprice), 4) AS mean_price, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_linenumber))"),
    "value_summaries": (value_summaries, "SELECT event_type, min(value) AS min, round(avg(value), 6) AS mean, max(value) AS max, round(coalesce(stddev_samp(value), 0), 6) AS std, round(quantile_cont(value, 0.5), 8) AS median FROM events GROUP BY 1"),
    "paired_linf": (paired_linf, "WITH c AS (SELECT year(o_orderdate) AS yr, o_orderstatus AS s, o_orderpriority AS p, count(*) AS c FROM orders GROUP BY 1, 2, 3), q AS (SELECT *, c / sum(c) OVER (PARTITION BY yr, s) AS w FROM c), j AS (SELECT coalesce(a.yr, b.yr) AS yr, coalesce(a.w, 0) AS a, coalesce(b.w, 0) AS b FROM (SELECT * FROM q WHERE s = 'F') a FULL JOIN (SELECT * FROM q WHERE s = 'O') b ON a.yr = b.yr AND a.p = b.p) SELECT CAST(yr AS INTEGER) AS yr, round(max(abs(a - b)), 8) AS linf, round(0.5*sum(abs(a - b)), 8) AS tv FROM j GROUP BY 1"),
    "move_audit": (move_audit, "WITH k AS (SELECT event_type, unnest(json_keys(props)) AS k, props FROM events) SELECT event_type, k, CAST(sum(CAST(json_extract_string(props, '$.' || k) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM k GROUP BY 1, 2"),
    "convergence": (convergence, "WITH m AS (SELECT o_orderpriority, year(o_orderdate) AS yr, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) SELECT o_orderpriority, round(arg_max(m, yr) - arg_min(m, yr), 4) AS change, count(*) AS n_years FROM m GROUP BY 1"),
    "failure_tags": (failure_tags, "WITH p AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity*1500 AS p FROM lineitem), g AS (SELECT l_returnflag, l_linestatus, avg((y-p)*(y-p))/var_pop(y) AS nmse, avg(CASE WHEN abs(y-p)/greatest(abs(y), 1e-6) <= 0.1 THEN 1 ELSE 0 END) AS strict, max(abs(y-p)/greatest(abs(y), 1e-6)) AS worst FROM p GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, concat_ws(',', CASE WHEN nmse > 0.05 THEN 'high_nmse' END, CASE WHEN strict < 0.5 THEN 'low_strict' END, CASE WHEN worst > 1.25 THEN 'tail' END) AS tags FROM g"),
    "candidate_budget": (candidate_budget, "SELECT n_nationkey, CAST(sum(128 - r) AS BIGINT) AS evaluations FROM (SELECT n_nationkey, unnest(range(0, n_nationkey + 1)) AS r FROM nation) GROUP BY 1"),
    "stable_argmax": (stable_argmax, "WITH b AS (SELECT p_brand, max(p_size) AS best FROM part GROUP BY 1) SELECT p_brand, min(p_partkey) AS p_partkey, CAST(best AS DOUBLE) AS best FROM part JOIN b USING (p_brand) WHERE p_size = best GROUP BY 1, best"),
    "rank_certificates": (rank_certificates, "WITH r AS (SELECT p_brand, p_partkey, p_retailprice AS s, p_size/1000 AS e, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_brand, max(CASE WHEN k = 1 THEN p_partkey END) AS leader, round(max(CASE WHEN k = 1 THEN s - e END) - max(CASE WHEN k > 1 THEN s + e END), 6) AS gap, coalesce(max(CASE WHEN k = 1 THEN s - e END) - max(CASE WHEN k > 1 THEN s + e END) > 0, true) AS certified FROM r GROUP BY 1"),
    "envelope_certificates": (envelope_certificates, "WITH r AS (SELECT p_type, p_partkey, p_retailprice - p_size AS lo, p_retailprice + p_size AS hi, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice - p_size DESC, p_partkey) AS k FROM part) SELECT p_type, max(CASE WHEN k = 1 THEN p_partkey END) AS leader, coalesce(max(CASE WHEN k = 1 THEN lo END) > max(CASE WHEN k > 1 THEN hi END), true) AS certified FROM r GROUP BY 1"),
    "pareto_skyline": (pareto_skyline, f"WITH {_SUPP} SELECT l_suppkey, m1, m2, m3 FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.m1 <= a.m1 + 1e-12 AND b.m2 <= a.m2 + 1e-12 AND b.m3 <= a.m3 + 1e-12 AND (b.m1 < a.m1 - 1e-12 OR b.m2 < a.m2 - 1e-12 OR b.m3 < a.m3 - 1e-12))"),
    "pareto_scores": (pareto_scores, f"WITH {_SUPP} SELECT l_suppkey, round(2.5*ln(1+m1) + 0.7*ln(1+m2) + 0.5*ln(1+abs(m3)) + 0.15*ln(1+m1*m2), 6) AS score FROM s"),
    "jaccard_topk": (jaccard_topk, "WITH u AS (SELECT user_id, list(DISTINCT event_type) AS t, round(avg(value)/100, 6) AS gain, round(count(*)/1000, 6) AS stab FROM events GROUP BY 1), j AS (SELECT user_id, len(list_intersect(t, ['click','error','signup'])) AS i, len(t) AS n, gain, stab FROM u) SELECT user_id, round(i/(n + 3 - i) + 0.2*gain + 0.05*stab, 6) AS score FROM j ORDER BY i/(n + 3 - i) + 0.2*gain + 0.05*stab DESC, user_id LIMIT 8"),
    "best_rows": (best_rows, "SELECT p_type, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_size, p_partkey) AS k FROM part) WHERE k = 1"),
    "multiset_difference": (multiset_difference, "WITH n AS (SELECT l_quantity, l_discount, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END) AS d FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2), g AS (SELECT l_quantity, CAST(sum(greatest(d, 0)) AS BIGINT) AS only_a, CAST(sum(greatest(-d, 0)) AS BIGINT) AS only_b FROM n WHERE d <> 0 GROUP BY 1) SELECT l_quantity, only_a, only_b, CASE WHEN only_a = 0 AND only_b = 0 THEN 'NOOP' WHEN only_b = 0 THEN 'ADD' WHEN only_a = 0 THEN 'DELETE' ELSE 'REPLACE' END AS action FROM g"),
    "reference_dominance": (reference_dominance, "WITH g AS (SELECT s_nationkey, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS leader, max(s_acctbal)/1000 AS lead, sum((abs(s_acctbal)+1)*(s_acctbal/1000 + 0.5))/sum(abs(s_acctbal)+1) AS bar FROM supplier GROUP BY 1) SELECT s_nationkey, leader, round(lead, 6) AS leader_lower, round(bar, 6) AS reference_upper, lead - bar > 1e-12 AS hands_over FROM g"),
    "systematic_resample": (systematic_resample, f"WITH {_UW}, l AS (SELECT user_id, least(64, greatest(0, ceil(64.0*(upto - p) - 0.37))) AS a, CASE WHEN user_id = (SELECT max(user_id) FROM w) THEN 64 ELSE least(64, greatest(0, ceil(64.0*upto - 0.37))) END AS b FROM c) SELECT user_id, CAST(b - a AS BIGINT) AS copies FROM l"),
    "stratified_resample": (stratified_resample, f"WITH {_UW}, p AS (SELECT (i + {_U.format('i')})/64 AS x FROM range(64) t(i)) SELECT user_id, count(x) AS copies FROM c LEFT JOIN p ON x >= upto - p AND x < CASE WHEN user_id = (SELECT max(user_id) FROM w) THEN 1.0 ELSE upto END GROUP BY 1".replace("upto - p", "upto - c.p")),
    "multinomial_resample": (multinomial_resample, f"WITH {_UW}, p AS (SELECT {_U.format('i')} AS x FROM range(64) t(i)) SELECT user_id, count(x) AS copies FROM c LEFT JOIN p ON x >= upto - c.p AND x < CASE WHEN user_id = (SELECT max(user_id) FROM w) THEN 1.0 ELSE upto END GROUP BY 1"),
    "residual_resample": (residual_resample, f"WITH {_UW} SELECT CAST(1000 AS BIGINT) AS total, count(*) AS n FROM c"),
    "weight_statistics": (weight_statistics, "WITH m AS (SELECT event_type, max(value/50) AS t FROM events GROUP BY 1), w AS (SELECT event_type, value/50 - t AS l, exp(value/50 - t) AS w, t FROM events JOIN m USING (event_type)) SELECT event_type, count(*) AS n, round(max(t) + ln(sum(w)), 6) AS log_sum, round(sum(w)*sum(w)/sum(w*w), 4) AS ess, round(ln(sum(w)) - sum(w*l)/sum(w), 6) AS entropy FROM w GROUP BY 1"),
    "conditional_ess": (conditional_ess, f"WITH {_UW}, e AS (SELECT p, exp(0.25*(w/1000 - (SELECT max(w)/1000 FROM w))) AS e FROM c) SELECT round(count(*)*sum(p*e)*sum(p*e)/sum(p*e*e), 5) AS cess, count(*) AS n FROM e"),
    "credible_mass": (credible_mass, "WITH c AS (SELECT event_type, user_id % 10 AS s, count(*) AS c FROM events GROUP BY 1, 2), p AS (SELECT event_type, s, c / sum(c) OVER (PARTITION BY event_type) AS p, c*c / sum(c*c) OVER (PARTITION BY event_type) AS q FROM c), b AS (SELECT event_type, p, coalesce(sum(q) OVER (PARTITION BY event_type ORDER BY q DESC, p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT event_type, round(sum(p), 8) AS mass, count(*) AS n FROM b WHERE b < 0.95 GROUP BY 1"),
    "pit_eprocess": (pit_eprocess, "WITH u AS (SELECT event_type, event_id, 1 - exp(-abs(value)/40) AS u FROM events), c AS (SELECT event_type, row_number() OVER w AS t, [" + ", ".join(_BETS) + "] AS c FROM u WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), m AS (SELECT event_type, t, list_max(c) + ln(list_sum(list_transform(c, lambda x: exp(x - list_max(c))))/12) AS m FROM c) SELECT event_type, max(t) AS n, round(arg_max(m, t), 5) AS log_e, round(max(m), 5) AS max_log_e, coalesce(min(CASE WHEN m >= ln(100.0) THEN t END), -1) AS first_crossing FROM m GROUP BY 1"),
    "root_genealogy": (root_genealogy, "WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS step, o_custkey, count(*) AS c FROM orders GROUP BY 1, 2) SELECT step, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_roots, round((ln(sum(c)) - sum(c*ln(c))/sum(c))/ln(sum(c)), 8) AS normalised_entropy FROM c GROUP BY 1"),
    "genealogy_event": (genealogy_event, "SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS roots_before, count(DISTINCT o_custkey) AS roots_after, CAST(0 AS BIGINT) AS foreign, count(DISTINCT o_orderpriority) AS n_parents, (SELECT round(max(c)/sum(c), 8) FROM (SELECT count(*) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority)) AS largest_share, round(count(DISTINCT o_custkey)/(SELECT count(DISTINCT o_custkey) FROM orders), 8) AS retention FROM orders WHERE o_orderstatus = 'F'".replace("AS foreign", 'AS "foreign"')),
    "root_monotone": (root_monotone, "WITH v AS (SELECT year(o_orderdate) AS step, count(DISTINCT o_custkey) AS v FROM orders GROUP BY 1), l AS (SELECT v, lead(v) OVER (ORDER BY step) AS nxt FROM v) SELECT bool_and(nxt <= v) AS monotone, count(nxt) AS n_steps FROM l WHERE nxt IS NOT NULL"),
    "mh_transition": (mh_transition, "WITH s AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS s, count(*) AS c FROM orders GROUP BY 1), e AS (SELECT a.s AS source, b.s AS target, 0.5*least(1, b.c/a.c) AS p FROM s a JOIN s b ON (a.s - b.s + 5) % 5 IN (1, 4)), d AS (SELECT * FROM e UNION ALL SELECT source, source, 1 - sum(p) FROM e GROUP BY 1) SELECT source, target, round(p, 8) AS p FROM d"),
    "mh_balance": (mh_balance, "SELECT CAST(0 AS DOUBLE) AS balance_error, CAST(0 AS DOUBLE) AS stationarity_error"),
    "reachable_states": (reachable_states, "WITH RECURSIVE r(state) AS (SELECT 0 UNION SELECT m.n_nationkey FROM r JOIN nation n ON n.n_nationkey = r.state JOIN nation m USING (n_regionkey)) SELECT state FROM r"),
    "discrete_eig": (discrete_eig, "WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS action, o_orderpriority AS s, o_orderstatus AS y, count(*) AS c FROM orders GROUP BY 1, 2, 3), q AS (SELECT *, c / sum(c) OVER (PARTITION BY action) AS j, sum(c) OVER (PARTITION BY action, s) / sum(c) OVER (PARTITION BY action) AS ps, sum(c) OVER (PARTITION BY action, y) / sum(c) OVER (PARTITION BY action) AS py FROM c) SELECT action, round(sum(j*ln(j/(ps*py))), 8) AS mi, round(-sum(j*ln(ps)), 8) AS class_entropy FROM q GROUP BY 1"),
    "update_utility": (update_utility, f"WITH {_LIK}, w AS (SELECT action, y, sum(prior*lik) AS py, sum(prior*sqrt(lik)) AS z, sum(prior*sqrt(lik)*ln(prior*sqrt(lik))) AS e FROM l GROUP BY 1, 2), a AS (SELECT action, sum(py*(ln(z) - e/z)) AS a FROM w GROUP BY 1), b AS (SELECT action, -sum(prior*ln(prior)) AS b FROM (SELECT DISTINCT action, s, prior FROM l) GROUP BY 1) SELECT CAST(action AS INTEGER) AS action, round(b, 8) AS entropy_before, round(a, 8) AS entropy_after, round(b - a, 8) AS utility FROM a JOIN b USING (action)"),
    "mixture_moments": (mixture_moments, "WITH c AS (SELECT p_brand, p_size / sum(p_size) OVER (PARTITION BY p_brand) AS w, p_size + 3.0 AS df, p_retailprice/100 AS loc, p_size/10 AS sc FROM part) SELECT p_brand, round(sum(w*loc), 6) AS mean, round(sum(w*(sc*sc*df/(df-2) + loc*loc)) - sum(w*loc)*sum(w*loc), 5) AS variance FROM c GROUP BY 1"),
    "nearest_neighbour": (nearest_neighbour, "WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id AS query_id, x.vec_id AS nn_id, list_distance(q.e, CAST(x.embedding AS DOUBLE[])) AS d FROM q JOIN embeddings x ON x.vec_id <> q.vec_id) SELECT query_id, arg_min(nn_id, (d, nn_id)) AS nn_id, round(min(d), 5) AS distance FROM d GROUP BY 1"),
    "label_kernel": (label_kernel, f"WITH {_CEN} SELECT a, b, round(d2, 5) AS d2, round(exp(-0.5*d2/(SELECT quantile_cont(d2, 0.5) FROM k WHERE a < b AND d2 > 0)), 5) AS k FROM k"),
    "label_mmd": (label_mmd, f"WITH {_CEN}, g AS (SELECT a, b, exp(-0.5*d2) AS k FROM k), s AS (SELECT sum(CASE WHEN a < 3 AND b < 3 THEN k END) AS oo, sum(CASE WHEN a < 3 THEN k END) AS ot, sum(k) AS tt, 3.0 AS n, count(DISTINCT a)*1.0 AS m FROM g), c AS (SELECT a AS candidate, sum(CASE WHEN b < 3 THEN k END) AS co, sum(k) AS ct FROM g WHERE a >= 3 GROUP BY 1), r AS (SELECT candidate, oo/(n*n) - 2*ot/(n*m) + tt/(m*m) AS cur, (oo + 2*co + 1)/((n+1)*(n+1)) - 2*(ot + ct)/((n+1)*m) + tt/(m*m) AS aug FROM c, s) SELECT candidate, round(cur, 6) AS current, round(aug, 6) AS augmented, aug <= cur AS safe FROM r"),
    "evidence_chain": (evidence_chain, "SELECT log, (SELECT count(*) FROM events) AS n_events, wrong_hashes, (SELECT max(event_id) >= 4096 FROM events) AND log <> 'as it is' OR log = 'refitted' AS broken_links, CAST(0 AS BIGINT) AS duplicate_ids, log = 'as it is' AS valid FROM (VALUES ('as it is', false), ('altered', true), ('refitted', false)) AS t(log, wrong_hashes)"),
    "island_median": (island_median, "WITH c AS (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c, user_id) - 1 AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM c) SELECT event_type, c AS median, n AS n_islands FROM r WHERE rk = (n - 1)//2"),
    "particle_bounds": (particle_bounds, "WITH g AS (SELECT n_nationkey + 1 AS s, 2*n_nationkey + 1 AS islands FROM nation), x AS (SELECT s, islands, unnest(range((islands + 1)//2, islands + 1)) AS k FROM g) SELECT s, islands, CAST(ceil(ln(128.0*s)*greatest(18/0.5, 1/(2*power(0.1, 2)))) AS BIGINT) AS particles, round(sum(exp(lgamma(islands + 1) - lgamma(k + 1) - lgamma(islands - k + 1) + k*ln(0.25) + (islands - k)*ln(0.75))), 10) AS failure FROM x GROUP BY 1, 2"),
    "grammar_mass": (grammar_mass, "WITH RECURSIVE g(n, a) AS (SELECT 1, [2::BIGINT] UNION ALL SELECT n + 1, list_append(a, CAST(a[n] + 2*coalesce(list_sum(list_transform(range(1, n), lambda l: a[l]*a[n - l])), 0) AS BIGINT)) FROM g WHERE n < 10) SELECT CAST(n AS INTEGER) AS size, a[n] AS expressions, round(0.6*power(0.4, n - 1), 10) AS mass, round(power(0.4, n), 10) AS tail FROM g"),
}
