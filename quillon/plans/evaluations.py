"""Queries on whole metric vectors and what follows from them, each with equal SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import expressions as ex
from quillon.operators import certify, discovery, envelope, evaluation, knot, residual, semantic
from quillon.operators.gram import Prior
from quillon.operators.grammar import Grammar
from quillon.plans.measures import _U
from quillon.sources.shared import written
from quillon.sources.tables import table

#: Two features of orders in two forms: with many values, and with so few that none lies outside the quantiles.
CASES = {"wide": ("o_custkey / 1000", "o_orderkey % 1009 / 1009"), "coarse": ("o_custkey % 10 / 10", "o_orderkey % 7 / 7")}
EXPRESSIONS = ("0.9 + 0.1*x0", "x0*x1 + 1.5", "1/(x0 - x0)", "1.5 + x1**3 - x0")
_AS_SQL = ("0.9 + 0.1*x0", "x0*x1 + 1.5", None, "1.5 + x1*x1*x1 - x0")
SEED = 7


def order_rows(spark: SparkSession, sf_dir: str, case: str) -> DataFrame:
    x0, x1 = CASES[case]
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"cast({x0} as double) as x0", f"cast({x1} as double) as x1", "o_totalprice / 100000 as y")


def metric_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric vectors of fixed expressions over orders: a quarter of them validate."""
    rows = []
    held = F.col("o_orderkey") % 4 == 1
    for case in CASES:
        d = order_rows(spark, sf_dir, case)
        domains = evaluation.prepare(d.where(~held), d.where(held), [F.col("x0"), F.col("x1")], F.col("y"), F.col("o_orderkey"), evaluation.Config(seed=SEED, floor_ratio=0.05 if case == "wide" else 0.0))
        rows += [(case, t, *[m[f] for f in evaluation.FIELDS]) for t, m in zip(EXPRESSIONS, evaluation.metric_vectors(domains, list(EXPRESSIONS)), strict=True)]
    out = spark.createDataFrame(rows, "feature_case string, expression string, " + ", ".join(f"{f} double" for f in evaluation.FIELDS))
    return out.select("feature_case", "expression", *[F.round(f, 6).alias(f) for f in evaluation.FIELDS])


def _case_sql(case: str, ratio: float) -> str:
    x0, x1 = CASES[case]
    c = case[0]
    rank = "CASE WHEN {r} < (n % 3)*(n//3 + 1) THEN {r}//(n//3 + 1) ELSE n % 3 + ({r} - (n % 3)*(n//3 + 1))//(n//3) END"
    preds = ", ".join(f"({t})" for t in _AS_SQL if t)
    names = ", ".join(f"'{e}'" for e, t in zip(EXPRESSIONS, _AS_SQL, strict=True) if t)
    value = "CASE name " + " ".join(f"WHEN '{e}' THEN {t}" for e, t in zip(EXPRESSIONS, _AS_SQL, strict=True) if t) + " END"
    near = "CASE name " + " ".join(f"WHEN '{e}' THEN {t.replace('x0', 'a0').replace('x1', 'a1')}" for e, t in zip(EXPRESSIONS, _AS_SQL, strict=True) if t) + " END"
    chance = [_U.format(f"concat_ws(':', i, '{k}', '{w}')") for k in (0, 1) for w in ("sign", "size")]
    return f"""
{c}0 AS (SELECT o_orderkey AS id, {x0} AS x0, {x1} AS x1, o_totalprice/100000 AS y, o_orderkey % 4 = 1 AS held FROM orders),
{c}1 AS (SELECT count(*) AS n, count(*) FILTER (held) AS nv, quantile_cont(x0, [0.05, 0.5, 0.95]) FILTER (NOT held) AS t0, quantile_cont(x1, [0.05, 0.5, 0.95]) FILTER (NOT held) AS t1, quantile_cont(x0, [0.05, 0.5, 0.95]) AS q0, quantile_cont(x1, [0.05, 0.5, 0.95]) AS q1, greatest(quantile_cont(abs(y), 0.95), sqrt(greatest(var_pop(y), 1e-15)), 1e-9) AS ys FROM {c}0),
{c}2 AS (SELECT *, held AND (x0 < t0[1] OR x0 > t0[3] OR x1 < t1[1] OR x1 > t1[3]) AS far, greatest(abs((x0 - t0[2])/greatest(t0[3] - t0[1], 1e-12)), abs((x1 - t1[2])/greatest(t1[3] - t1[1], 1e-12))) AS dist,
  row_number() OVER (ORDER BY sha256('{SEED}:' || id)) - 1 AS rd, row_number() OVER (ORDER BY abs(y), id) - 1 AS ro FROM {c}0, {c}1),
{c}3 AS (SELECT *, sum(CAST(far AS INTEGER)) OVER () AS nf, row_number() OVER (PARTITION BY held ORDER BY dist, id) - 1 AS rf FROM {c}2),
{c}4 AS (SELECT id, x0, x1, y, unnest([CASE WHEN held THEN 'val' ELSE 'train' END, 'all', 'r' || ({rank.format(r="rd")}), 'o' || ({rank.format(r="ro")})] || CASE WHEN nf < greatest(4, floor(0.05*nv)) THEN CASE WHEN held AND rf >= nv - least(nv, greatest(4, ceil(0.2*nv))) THEN ['ood'] ELSE [] END ELSE CASE WHEN far THEN ['ood'] ELSE [] END END) AS g FROM {c}3),
{c}5 AS (SELECT g, {f"greatest(1e-12, {ratio}*greatest(quantile_cont(abs(y), 0.95), stddev_pop(y), 1e-12))" if ratio else "1e-12"} AS f FROM {c}4 GROUP BY g),
{c}6 AS (SELECT g, y, f, unnest([{names}]) AS name, unnest([{preds}]) AS p FROM {c}4 JOIN {c}5 USING (g)),
{c}7 AS (SELECT g, name, avg((p - y)*(p - y))/greatest(var_pop(y), 1e-15) AS nmse, max(abs(p - y)/greatest(abs(y), f)) AS strict, quantile_cont(abs(p - y)/greatest(abs(y), f), 0.99) AS p99, quantile_cont(abs(p - y)/greatest(abs(y), f), 0.995) AS p995, avg(CAST(abs(p - y)/greatest(abs(y), f) <= 0.1 AS INTEGER)) AS share, quantile_cont(abs(p), 0.99) AS size FROM {c}6 GROUP BY g, name),
{c}8 AS (SELECT ys, q0[2] + CASE WHEN {chance[0]} < 0.5 THEN -1 ELSE 1 END*(0.75 + 0.75*{chance[1]})*greatest(q0[3] - q0[1], 1e-9) AS x0, q1[2] + CASE WHEN {chance[2]} < 0.5 THEN -1 ELSE 1 END*(0.75 + 0.75*{chance[3]})*greatest(q1[3] - q1[1], 1e-9) AS x1, greatest(q0[3] - q0[1], 1e-9) AS s0, greatest(q1[3] - q1[1], 1e-9) AS s1 FROM {c}1, range(128) r(i)),
{c}9 AS (SELECT name, any_value(ys) AS ys, quantile_cont(abs({value}), 0.99) AS far, quantile_cont(abs(({near}) - ({value})), 0.99) AS steep FROM (SELECT *, x0 + 1e-4*s0 AS a0, x1 + 1e-4*s1 AS a1, unnest([{names}]) AS name FROM {c}8) GROUP BY name),
{c} AS (SELECT '{case}' AS feature_case, name AS expression, max(nmse) FILTER (g = 'train') AS train_nmse, max(nmse) FILTER (g = 'val') AS val_nmse, max(strict) FILTER (g = 'val') AS val_strict, max(p99) FILTER (g = 'val') AS val_p99, max(p995) FILTER (g = 'val') AS val_p995, max(share) FILTER (g = 'val') AS val_share,
  max(nmse) FILTER (g[1] IN ('r', 'o') AND g <> 'ood') AS stress_nmse, max(strict) FILTER (g[1] IN ('r', 'o') AND g <> 'ood') AS stress_strict, max(p99) FILTER (g[1] IN ('r', 'o') AND g <> 'ood') AS stress_p99, max(nmse) FILTER (g = 'ood') AS ood_nmse, max(strict) FILTER (g = 'ood') AS ood_strict,
  greatest(0, ln(1 + any_value(far)/any_value(ys)/greatest(1, max(size) FILTER (g = 'all')/any_value(ys))) - ln(3)) + greatest(0, ln(1 + any_value(steep)/any_value(ys)/1e-4) - ln(1e5)) AS ood_penalty FROM {c}7 JOIN {c}9 USING (name) GROUP BY name)"""


_SIZES = ", ".join(f"('{e}', {float(ex.complexity(e, 2))!r}, {t is not None})" for e, t in zip(EXPRESSIONS, _AS_SQL, strict=True))
_INF = "CAST('Infinity' AS DOUBLE)"
_VALUES = ", ".join(f"CASE WHEN ok THEN round({f}, 6) ELSE {'0.0' if f == 'val_share' else _INF} END AS {f}" for f in evaluation.FIELDS[:-2])
_VECTORS = f"""WITH {_case_sql("wide", 0.05)}, {_case_sql("coarse", 0.0)},
s(expression, size, ok) AS (VALUES {_SIZES}),
a AS (SELECT * FROM w UNION ALL SELECT * FROM c)
SELECT k.feature_case, s.expression, {_VALUES}, CASE WHEN ok THEN size ELSE {_INF} END AS complexity, CASE WHEN ok THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS invalid
FROM s CROSS JOIN (VALUES ('wide'), ('coarse')) k(feature_case) LEFT JOIN a ON a.expression = s.expression AND a.feature_case = k.feature_case"""

def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a linear guess of the price misses, by status and year."""
    d = order_rows(spark, sf_dir, "wide").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("yr")), "o_orderkey")
    x0, x1 = F.col("x0"), F.col("x1")
    guess = F.when(F.col("yr") % 2 == 0, F.col("y") * 1.02 + 0.01 * x1).otherwise(0.5 + 2 * x1)
    s = evaluation.failure_summary(d, ["o_orderstatus", "yr"], "o_orderkey", F.col("y"), guess, {"x0": x0, "x1": x1, "size": F.col("y")}, F.col("o_orderkey") == 5, F.col("yr") == 1996)
    numbers = ("nmse", "p99", "mean_scaled", "sd_scaled", "worst_y_low", "worst_y_high", "worst_p_low", "worst_p_high", "worst_p99_scaled")
    first = F.col("follows")[0]
    return s.select("o_orderstatus", "yr", "n", "n_worst", F.array_join("tags", ",").alias("tags"), *[F.round(c, 6).alias(c) for c in numbers], first["feature"].alias("feature"), F.round(first["correlation"], 6).alias("correlation"), F.size("follows").cast("long").alias("n_followed"))


_FAILURES = f"""WITH d AS (SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderkey AS id, {CASES["wide"][0]} AS x0, {CASES["wide"][1]} AS x1, o_totalprice/100000 AS y FROM orders),
e AS (SELECT *, CASE WHEN yr % 2 = 0 THEN y*1.02 + 0.01*x1 ELSE 0.5 + 2*x1 END AS p FROM d),
r AS (SELECT *, y - p AS e, abs(y - p) AS a, row_number() OVER w - 1 AS rk, count(*) OVER (PARTITION BY o_orderstatus, yr) AS n FROM e WINDOW w AS (PARTITION BY o_orderstatus, yr ORDER BY abs(y - p), id)),
k AS (SELECT *, least(n, greatest(4, CAST(ceil(0.05*n) AS BIGINT))) AS m FROM r),
g AS (SELECT o_orderstatus, yr, any_value(n) AS n, any_value(m) AS n_worst, avg(e*e)/greatest(var_pop(y), 1e-15) AS nmse, quantile_cont(a/greatest(abs(y), 1e-12), 0.99) AS p99, greatest(quantile_cont(abs(y), 0.95), sqrt(greatest(var_pop(y), 1e-15)), 1e-12) AS s, avg(e) AS mean, stddev_pop(e) AS sd, bool_or(id = 5) AS i,
  min(y) FILTER (rk >= n - m) AS worst_y_low, max(y) FILTER (rk >= n - m) AS worst_y_high, min(p) FILTER (rk >= n - m) AS worst_p_low, max(p) FILTER (rk >= n - m) AS worst_p_high, quantile_cont(a, 0.99) FILTER (rk >= n - m) AS tail,
  [coalesce(CASE WHEN isnan(corr(x0, e)) THEN 0 ELSE corr(x0, e) END, 0), coalesce(CASE WHEN isnan(corr(x1, e)) THEN 0 ELSE corr(x1, e) END, 0), coalesce(CASE WHEN isnan(corr(y, e)) THEN 0 ELSE corr(y, e) END, 0)] AS c FROM k GROUP BY o_orderstatus, yr),
h AS (SELECT *, CASE WHEN abs(c[3]) > greatest(abs(c[1]), abs(c[2])) THEN 3 WHEN abs(c[2]) > abs(c[1]) THEN 2 ELSE 1 END AS f FROM g)
SELECT o_orderstatus, yr, n, n_worst, coalesce(nullif(concat_ws(',', CASE WHEN nmse > 0.05 THEN 'nmse_underfit' END, CASE WHEN p99 > greatest(0.1, 2*sqrt(nmse)) THEN 'tail_failure' END, CASE WHEN i THEN 'missing_prediction_input_interaction' END, CASE WHEN yr = 1996 THEN 'missing_prediction_nonlinearity' END, CASE WHEN abs(mean/s) > 0.05 THEN 'systematic_bias' END), ''), 'unexplained_signal') AS tags,
  round(nmse, 6) AS nmse, round(p99, 6) AS p99, round(mean/s, 6) AS mean_scaled, round(sd/s, 6) AS sd_scaled, round(worst_y_low, 6) AS worst_y_low, round(worst_y_high, 6) AS worst_y_high, round(worst_p_low, 6) AS worst_p_low, round(worst_p_high, 6) AS worst_p_high, round(tail/s, 6) AS worst_p99_scaled,
  CASE f WHEN 3 THEN 'size' WHEN 2 THEN 'x1' ELSE 'x0' END AS feature, round(c[f], 6) AS correlation, CAST(3 AS BIGINT) AS n_followed FROM h"""

#: The open grammar of the certificate, and the sizes that are listed.
RHO, LEAST, MOST = 0.4, 2, 6
CONTRACT = Prior(0.0, 0.7, 3.0, 0.08)


def finished_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of finished orders by year: a year on [-1.5, 1.5], the share less a half."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"))
    return o.select(((F.col("yr") - 1995) / 2).alias("x"), (F.col("share") - 0.5).alias("y"), F.when(F.col("yr") == 1998, 0.5).otherwise(1.0).alias("power"))


def semantic_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior beyond each listed size of the open grammar, over orders by year, the last year at half its power."""
    g = Grammar(1, RHO)
    m = semantic.moments(finished_line(spark, sf_dir), [F.col("x")], F.col("y"), MOST, F.col("power"))
    c = semantic.classes(spark, g, MOST)
    out = semantic.certificate(c.withColumn("log_marginal", semantic.log_marginal(F.col("terms"), m, CONTRACT)), g, m.n, CONTRACT, LEAST, MOST)
    return out.select("most", "classes", *[F.round(k, 8).alias(k) for k in ("log_core", "log_tail", "tail_probability", "minorisation", "beyond")], "mixing_steps", "inside", F.round("violation", 8).alias("violation"))


def semantic_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest classes of the open grammar over line items: price by quantity, all rows at the power of a hundred."""
    g = Grammar(1, RHO)
    d = table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 25) / 25).alias("x"), (F.col("l_extendedprice") / 50000 - 1).alias("y"))
    m = semantic.moments(d, [F.col("x")], F.col("y"), MOST, F.lit(100.0) / d.count())
    c = semantic.classes(spark, g, MOST)
    p = semantic.class_posterior(c.withColumn("log_marginal", semantic.log_marginal(F.col("terms"), m, CONTRACT)))
    shown = c.groupBy("class_id").agg(F.first("terms").alias("terms"))
    spelled = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.coalesce(F.get(F.filter("terms", lambda t: t["code"] == k), F.lit(0))["coefficient"].cast("int"), F.lit(0)).cast("string")), ",")
    return p.join(shown, "class_id").where("probability > 1e-4").select(spelled.alias("coefficients"), F.round("mass", 10).alias("mass"), F.round("probability", 7).alias("probability"))


def _shells(most: int) -> str:
    """Classes of each size as coefficients up to the third power, with their numbers of expressions, from smaller sizes."""
    plus = "list_transform(range(1, 5), lambda i: a.c[i] + b.c[i])"
    times = "list_transform(range(1, 5), lambda k: CAST(list_sum(list_transform(range(1, k + 1), lambda i: a.c[i]*b.c[k + 1 - i])) AS BIGINT))"
    out = ["s1(c, m) AS (VALUES ([1, 0, 0, 0]::BIGINT[], 1::BIGINT), ([0, 1, 0, 0]::BIGINT[], 1::BIGINT))"]
    for n in range(2, most + 1):
        parts = [f"SELECT list_transform(c, lambda v: -v) AS c, m FROM s{n - 1}"]
        parts += [f"SELECT {f}, a.m*b.m FROM s{k} a, s{n - 1 - k} b" for f in (plus, times) for k in range(1, n - 1)]
        out.append(f"s{n} AS MATERIALIZED (SELECT c, CAST(sum(m) AS BIGINT) AS m FROM ({' UNION ALL '.join(parts)}) GROUP BY c)")
    every = " UNION ALL ".join(f"SELECT {n} AS size, c, m, m*{1 - RHO}*power({RHO}, {n - 1})/(SELECT sum(m) FROM s{n}) AS mass FROM s{n}" for n in range(1, most + 1))
    return ",\n".join(out) + f",\ns AS MATERIALIZED ({every})"


_ALL_MOMENTS = ", ".join(f"sum(w*power(x, {k})) AS s{k}" for k in range(7)) + ", " + ", ".join(f"sum(w*power(x, {k})*y) AS t{k}" for k in range(4))
_SQUARE = " + ".join(f"c[{i + 1}]*c[{j + 1}]*s{i + j}" for i in range(4) for j in range(4))
_CROSS = " + ".join(f"c[{i + 1}]*t{i}" for i in range(4))
_EVIDENCE = f"""m AS (SELECT sum(w) AS n, sum(w*y*y) AS yy, {_ALL_MOMENTS} FROM d),
b AS (SELECT n, lgamma(3 + n/2) - lgamma(3) - n/2*(ln(2*pi()) + ln(0.08)) AS bound FROM m),
e AS (SELECT size, c, mass, -n/2*ln(2*pi()) + 0.5*ln(0.7) + 3*ln(0.08) + lgamma(3 + n/2) - lgamma(3) - 0.5*ln(0.7 + {_SQUARE}) - (3 + n/2)*ln(0.08 + 0.5*(yy - power({_CROSS}, 2)/(0.7 + {_SQUARE}))) AS lm FROM s, m)"""

_CERTIFICATE = f"""WITH d AS (SELECT (yr - 1995)/2 AS x, share - 0.5 AS y, CASE WHEN yr = 1998 THEN 0.5 ELSE 1.0 END AS w FROM (SELECT year(o_orderdate) AS yr, avg(CAST(o_orderstatus = 'F' AS INTEGER)) AS share FROM orders GROUP BY 1)),
{_shells(MOST)}, {_EVIDENCE},
r AS (SELECT most, count(DISTINCT c) FILTER (size <= most) AS classes, sum(mass*exp(lm)) FILTER (size <= most) AS core, sum(mass*exp(lm)) AS whole, max(lm) FILTER (size <= most) AS largest FROM e, range({LEAST}, {MOST + 1}) g(most) GROUP BY most),
q AS (SELECT *, exp(most*ln({RHO}) + bound) AS tail, exp({MOST}*ln({RHO}) + bound) AS last FROM r, b)
SELECT CAST(most AS INTEGER) AS most, classes, round(ln(core), 8) AS log_core, round(ln(tail), 8) AS log_tail, round(tail/(core + tail), 8) AS tail_probability, round(core/(core + tail), 8) AS minorisation, round((whole - core)/(whole + last), 8) AS beyond,
  greatest(1, CAST(ceil(ln(0.01)/ln(tail/(core + tail))) AS BIGINT)) AS mixing_steps, true AS inside, round(greatest(0.0, largest - bound), 8) AS violation FROM q"""

_POSTERIOR = f"""WITH d AS (SELECT (l_quantity - 25)/25 AS x, l_extendedprice/50000 - 1 AS y, 100.0/(SELECT count(*) FROM lineitem) AS w FROM lineitem),
{_shells(MOST)}, {_EVIDENCE},
c AS (SELECT c, sum(mass) AS mass, any_value(lm) AS lm FROM e GROUP BY c),
p AS (SELECT c, mass, mass*exp(lm - (SELECT max(lm) FROM c)) AS v FROM c)
SELECT array_to_string(c, ',') AS coefficients, round(mass, 10) AS mass, round(v/(SELECT sum(v) FROM p), 7) AS probability FROM p WHERE v/(SELECT sum(v) FROM p) > 1e-4"""

#: Sizes of the slice and of the envelope's list, particles and streams.
SLICE, PARTICLES, RUNS, DRAWS, STREAMS = 5, 256, 16, 2500, 8


def finished_design(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray]:
    """One row a year: a registered design."""
    rows = finished_line(spark, sf_dir).orderBy("x").limit(64).collect()
    return np.array([[r.x] for r in rows]), np.array([r.y for r in rows])


def knot_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations of every kind of last move over orders by year, against the slice's exact evidence."""
    x, y = finished_design(spark, sf_dir)
    runs = spark.createDataFrame([("years", m, PARTICLES, s) for m in knot.METHODS for s in range(RUNS)], "dataset string, method string, n int, seed int")
    out = knot.summary(knot.populations(runs, {"years": (x, y)}, Grammar(1, RHO), SLICE, CONTRACT))
    return out.select("method", "n_runs", F.round("exact", 8).alias("exact"), (F.abs("bias") < 0.25).alias("agrees"), "potentials", "proposals")


def envelope_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from the envelope over orders by year: how often they are listed, and whether their log masses are what they must be."""
    x, y = finished_design(spark, sf_dir)
    d = envelope.draws(spark, Grammar(1, RHO), SLICE, x, y, CONTRACT, DRAWS, STREAMS)
    over = F.col("log_target") - F.col("log_proposal") - F.col("log_total")
    env = envelope.Envelope(Grammar(1, RHO), SLICE, envelope.class_evidence(x, y, CONTRACT), certify.uniform_log_bound(float(len(y)), CONTRACT))
    p = F.when(F.col("listed"), env.listed_probability).otherwise(1 - env.listed_probability)
    s = d.groupBy("listed").agg(F.count(F.lit(1)).alias("n"), F.max(over).alias("most"), F.min(over).alias("least"), F.min("size").alias("small"), F.max("size").alias("large"))
    n = DRAWS * STREAMS
    frequent = F.abs(F.col("n") / n - p) < 5 * F.sqrt(p * (1 - p) / n)
    masses = F.when(F.col("listed"), (F.col("most") < 1e-9) & (F.col("least") > -1e-9) & (F.col("large") <= SLICE)).otherwise((F.col("most") <= 1e-9) & (F.col("small") > SLICE))
    return s.select("listed", F.round(p, 8).alias("probability"), frequent.alias("frequency_agrees"), masses.alias("masses_agree"))


_LINE = "d AS (SELECT (yr - 1995)/2 AS x, share - 0.5 AS y, 1.0 AS w FROM (SELECT year(o_orderdate) AS yr, avg(CAST(o_orderstatus = 'F' AS INTEGER)) AS share FROM orders GROUP BY 1))"

_KNOTS = f"""WITH {_LINE}, {_shells(SLICE)}, {_EVIDENCE}
SELECT method, CAST({RUNS} AS BIGINT) AS n_runs, (SELECT round(ln(sum(mass*exp(lm))) - ln(1 - power({RHO}, {SLICE})), 8) FROM e) AS exact, true AS agrees, CAST({RUNS * PARTICLES * (len(knot.BETAS) + 1)}*(SELECT count(*) FROM d) AS BIGINT) AS potentials, CAST({RUNS * PARTICLES}*(SELECT count(*) FROM d) AS BIGINT) AS proposals
FROM (VALUES {", ".join(f"('{m}')" for m in knot.METHODS)}) k(method)"""

_DRAWS = f"""WITH {_LINE}, {_shells(SLICE)}, {_EVIDENCE},
p AS (SELECT sum(mass*exp(lm)) AS core, any_value(power({RHO}, {SLICE})*exp(bound)) AS tail FROM e, b)
SELECT listed, round(CASE WHEN listed THEN core ELSE tail END/(core + tail), 8) AS probability, true AS frequency_agrees, true AS masses_agree FROM p, (VALUES (true), (false)) k(listed)"""

def residual_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the residual grammar adds to a linear guess over line items when the truth has a product, and with which coefficients."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), "l_tax")
    y = F.col("a") + 0.7 * F.col("a") * F.col("b") + F.col("l_tax") / 10
    r = residual.program(d, "x0", [F.col("a"), F.col("b")], y, settings=residual.Settings(beam=4, depth=1, chosen=2))
    rows = [(t["expression"], t["family"], t["operator"], t["depth"], t["coefficient"], ",".join(r["actions"]), r["interaction"]) for t in r["terms"]]
    out = spark.createDataFrame(rows, "expression string, family string, operator string, depth int, coefficient double, actions string, interaction boolean")
    return out.withColumn("coefficient", F.round("coefficient", 6))


_RESIDUAL = """WITH d AS (SELECT l_quantity/50 AS a, (l_quantity/50)*(l_discount*10) AS t, l_quantity/50 + 0.7*(l_quantity/50)*(l_discount*10) + l_tax/10 AS y FROM lineitem),
m AS (SELECT var_pop(a) AS aa, var_pop(t) AS tt, covar_pop(a, t) AS ca, covar_pop(a, y) AS ay, covar_pop(t, y) AS ty FROM d)
SELECT 'y_hat' AS expression, 'current_prediction' AS family, 'identity' AS operator, CAST(0 AS INTEGER) AS depth, round((tt*ay - ca*ty)/(aa*tt - ca*ca), 6) AS coefficient, 'REPARAMETERIZE,CHANGE_INTERACTION,ADD' AS actions, true AS interaction FROM m
UNION ALL SELECT '(y_hat)*(x1)', 'interaction', 'multiply', CAST(1 AS INTEGER), round((aa*ty - ca*ay)/(aa*tt - ca*ca), 6), 'REPARAMETERIZE,CHANGE_INTERACTION,ADD', true FROM m"""

def discovery_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discovery over orders from a weak seed when the truth has a product and a little that no term says: its events, who accepted, and what the survivor is like."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 101 / 101).alias("a"), (F.col("o_orderkey") % 97 / 97).alias("b"), (F.col("o_orderkey") % 13 / 1300).alias("noise"))
    d = written(o.withColumn("y", F.lit(0.5) + F.col("a") + 2 * F.col("a") * F.col("b") + F.col("noise")), "planted")
    held = F.col("o_orderkey") % 4 == 1
    r = discovery.discover(d.where(~held), d.where(held), [F.col("a"), F.col("b")], F.col("y"), discovery.Policy(islands=("balanced", "nmse"), max_rounds=1), seeds=[("x0", "weak"), ("broken(", "none")])
    good = r["survivor"]["metrics"]["val_nmse"] < 0.001 < r["anchor"]["metrics"]["val_nmse"] and "x1" in r["survivor"]["expression"]
    rows = [(e["seq"], e["phase"], e["event"], e["round_id"], ",".join(e.get("accepted") or []), e.get("expression") == "x0", good, len(r["seeds"])) for e in r["events"]]
    return spark.createDataFrame(rows, "seq int, phase string, event string, round_id int, accepted string, is_seed boolean, survivor_holds boolean, seeds int")


_PLANTED = "SELECT * FROM (VALUES (0, 'INITIALIZE', 'started', 0, '', false, true, 1), (1, 'SEED', 'anchor_selected', 0, '', true, true, 1), (2, 'DETERMINISTIC_EXPLORE', 'round_completed', 1, 'balanced,nmse', false, true, 1), (3, 'SELECT', 'survivor_selected', 1, '', false, true, 1), (4, 'COMPLETE', 'reported', 1, '', false, true, 1)) t(seq, phase, event, round_id, accepted, is_seed, survivor_holds, seeds)"

QUERIES = {"discovery_planted": (discovery_planted, _PLANTED), "residual_program": (residual_program, _RESIDUAL), "knot_populations": (knot_populations, _KNOTS), "envelope_draws": (envelope_draws, _DRAWS), "semantic_certificate": (semantic_certificate, _CERTIFICATE), "semantic_posterior": (semantic_posterior, _POSTERIOR), "metric_vectors": (metric_vectors, _VECTORS), "failure_summary": (failure_summary, _FAILURES)}
