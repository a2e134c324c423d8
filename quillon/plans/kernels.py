"""Queries whose numbers come from small-array kernels on statistics of whole tables; SQL has no words for them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import acquisition, discovery, discrepancy, gram, grammar, information, prequential, search, smc
from quillon.operators.gram import Prior, generic_bank
from quillon.plans.data import X, terms, z_terms
from quillon.sources.shared import written
from quillon.sources.tables import table

ACTIONS = np.array([[a, b, 0.0] for a in (-1.5, -0.5, 0.5, 1.5) for b in (-1.0, 1.0)])
TARGETS = np.array([[a, 0.0, 0.0] for a in (-1.0, 0.0, 1.0)])


def posteriors(spark: SparkSession, sf_dir: str) -> tuple[list, gram.Stats]:
    """The bank's posterior on yearly means of line items: a registered design of few rows from whole-table aggregates."""
    d = gram.standardised(yearly(spark, sf_dir), [*X, "y"])
    s = gram.gram(d, terms(), F.col("y"))
    return gram.bank_posterior(generic_bank(3), s, Prior()), s


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a month and flag: means of whole groups."""
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mo"), "l_returnflag").agg(*[F.avg(c).alias(c) for c in X], F.avg("l_extendedprice").alias("y"))


def class_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, _ = posteriors(spark, sf_dir)
    groups = information.operational_classes(posts, ACTIONS, 32)
    rows = [(k, posts[i].structure.name, float(posts[i].probability)) for k, g in enumerate(groups) for i in g]
    return spark.createDataFrame(rows, "class_id int, structure string, probability double")


def acquisition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score of every candidate action, with error and certified ranking."""
    posts, s = posteriors(spark, sf_dir)
    groups = information.operational_classes(posts, ACTIONS, 4096)
    parts = information.grouped_components(posts, groups, ACTIONS)
    score, err, order, sure = information.eig_until_ranked(parts)
    epig = information.class_epig(posts, groups, ACTIONS, TARGETS)
    epi = information.epistemic_variance(posts, ACTIONS)
    qbc = information.committee_disagreement(posts, ACTIONS, 32, 7)
    excess = information.residual_excess(posts, s, Prior())
    rows = []
    for a in range(len(ACTIONS)):
        lo, hi = information.eig_bounds(parts[a])
        rows.append((a, float(score[a]), float(err[a]), float(lo), float(hi), float(epig[a]), float(epi[a]), float(qbc[a]), float(excess), order, bool(sure)))
    return spark.createDataFrame(rows, "action int, class_eig double, error double, lower double, upper double, epig double, epistemic double, disagreement double, excess double, quadrature int, certified boolean")


def predictive_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, _ = posteriors(spark, sf_dir)
    d = information.predictive_moments(information.component_rows(spark, posts, ACTIONS), "action")
    return d.select("action", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def _predictive_sql() -> str:
    """As for the bank's posterior, with each action's design row beside the sums: elimination leaves minus its location and minus its spread."""
    names, every = list(z_terms()), [*z_terms().values(), "y"]
    sums = ", ".join("[" + ", ".join(f"sum(({every[min(i, j)]})*({every[max(i, j)]}))" for j in range(len(every))) + "]" for i in range(len(every)))
    bank = ", ".join(f"('{b.name}', {[names.index(t) + 1 for t in b.terms]})" for b in generic_bank(3))
    actions = ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {a[2]}::DOUBLE)" for k, a in enumerate(ACTIONS.tolist()))
    cols = (*X, "y")
    return f"""WITH RECURSIVE q AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in X)}, avg(l_extendedprice) AS y FROM lineitem GROUP BY year(l_shipdate), month(l_shipdate), lineitem.l_returnflag),
st AS (SELECT {", ".join(f"avg({c}) AS m{k}, stddev_pop({c}) AS s{k}" for k, c in enumerate(cols))} FROM q), z AS (SELECT {", ".join(f"({c} - m{k})/s{k} AS {'y' if c == 'y' else f'x{k}'}" for k, c in enumerate(cols))} FROM q, st),
g AS MATERIALIZED (SELECT count(*) AS n, [{sums}] AS g FROM z), b(structure, idx) AS (VALUES {bank}), a(action, x0, x1, x2) AS (VALUES {actions}), v AS (SELECT action, [{", ".join(every[:-1])}] AS v FROM a),
e(structure, action, n, k, size, m, log_det) AS (
  SELECT structure, action, n, 1, len(idx), list_append(list_append(list_transform(idx, lambda i: list_append(list_append(list_transform(idx, lambda j: g[i][j] + CASE WHEN i = j THEN 1.0 ELSE 0.0 END), g[i][{len(every)}]), v[i])), list_append(list_append(list_transform(idx, lambda j: g[j][{len(every)}]), g[{len(every)}][{len(every)}]), 0.0)), list_append(list_append(list_transform(idx, lambda j: v[j]), 0.0), 0.0)), CAST(0 AS DOUBLE) FROM b, g, v
  UNION ALL SELECT structure, action, n, k + 1, size, list_transform(range(1, size + 3), lambda i: CASE WHEN i <= k THEN m[i] ELSE list_transform(range(1, size + 3), lambda j: m[i][j] - m[i][k]/m[k][k]*m[k][j]) END), log_det + ln(m[k][k]) FROM e WHERE k <= size),
r AS (SELECT structure, action, n, 3 + n/2 AS shape, 1 + 0.5*m[size + 1][size + 1] AS scale, log_det, -m[size + 1][size + 2] AS loc, -m[size + 2][size + 2] AS spread FROM e WHERE k = size + 1),
w AS (SELECT *, -0.5*log_det - shape*ln(scale) AS ev FROM r), p AS (SELECT *, exp(ev - max(ev) OVER (PARTITION BY action)) AS w, scale/shape*(1 + spread)*shape/(shape - 1) AS var FROM w)
SELECT CAST(action AS INTEGER) AS action, round(sum(w*loc)/sum(w), 6) AS mean, round(sum(w*(var + loc*loc))/sum(w) - power(sum(w*loc)/sum(w), 2), 6) AS variance FROM p GROUP BY action"""


POWERS = (0.25, 0.5, 1.0)


def calibrated_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prequential loss of each likelihood power over the months: statistics before each month by a scan, nothing collected but the means."""
    d = gram.standardised(yearly(spark, sf_dir), [*X, "y"]).groupBy("yr", "mo").agg(*[F.avg(c).alias(c) for c in [*X, "y"]]).withColumn("at", (F.col("yr") * 12 + F.col("mo")).cast("long"))
    p = prequential.power_losses(d, F.col("at"), "at", terms(), F.col("y"), generic_bank(3), Prior(), POWERS)
    means = p.agg(*[F.avg(f"loss_{k}").alias(f"m{k}") for k in range(len(POWERS))])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(e).alias("power"), F.col(f"m{k}").alias("loss")) for k, e in enumerate(POWERS)])).alias("e")).select("e.*")
    least = means.select(F.least(*[F.col(f"m{k}") for k in range(len(POWERS))]).alias("least"))
    rows = rows.crossJoin(F.broadcast(least)).withColumn("tied", F.col("loss") <= F.col("least") + 1e-12 * F.greatest(F.lit(1.0), F.abs("least")))
    best = rows.where("tied").agg(F.max("power").alias("best"))
    return rows.crossJoin(F.broadcast(best)).select("power", F.round("loss", 8).alias("loss"), (F.col("power") == F.col("best")).alias("chosen"))


def _power_sql() -> str:
    """Sums before each month by windows, and elimination for each month, power and structure."""
    names, every = list(z_terms()), [*z_terms().values(), "y"]
    sums = ", ".join("[" + ", ".join(f"coalesce(sum(({every[min(i, j)]})*({every[max(i, j)]})) OVER w, 0)" for j in range(len(every))) + "]" for i in range(len(every)))
    bank = ", ".join(f"('{b.name}', {[names.index(t) + 1 for t in b.terms]})" for b in generic_bank(3))
    cols, last = (*X, "y"), len(every)
    return f"""WITH RECURSIVE q AS (SELECT year(l_shipdate) AS yr, month(l_shipdate) AS mo, {", ".join(f"avg({c}) AS {c}" for c in X)}, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2, lineitem.l_returnflag),
st AS (SELECT {", ".join(f"avg({c}) AS m{k}, stddev_pop({c}) AS s{k}" for k, c in enumerate(cols))} FROM q), z AS (SELECT yr*12 + mo AS t, {", ".join(f"avg(({c} - m{k})/s{k}) AS {'y' if c == 'y' else f'x{k}'}" for k, c in enumerate(cols))} FROM q, st GROUP BY 1),
g AS MATERIALIZED (SELECT t, y, count(*) OVER w AS n, [{", ".join(every[:-1])}] AS v, [{sums}] AS g FROM z WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b(structure, idx) AS (VALUES {bank}), h(eta) AS (VALUES {", ".join(f"({e}::DOUBLE)" for e in POWERS)}),
e(structure, t, eta, y, n, k, size, m, log_det) AS (
  SELECT structure, t, eta, y, n, 1, len(idx), list_append(list_append(list_transform(idx, lambda i: list_append(list_append(list_transform(idx, lambda j: eta*g[i][j] + CASE WHEN i = j THEN 1.0 ELSE 0.0 END), eta*g[i][{last}]), v[i])), list_append(list_append(list_transform(idx, lambda j: eta*g[j][{last}]), eta*g[{last}][{last}]), 0.0)), list_append(list_append(list_transform(idx, lambda j: v[j]), 0.0), 0.0)), CAST(0 AS DOUBLE) FROM b, g, h
  UNION ALL SELECT structure, t, eta, y, n, k + 1, size, list_transform(range(1, size + 3), lambda i: CASE WHEN i <= k THEN m[i] ELSE list_transform(range(1, size + 3), lambda j: m[i][j] - m[i][k]/m[k][k]*m[k][j]) END), log_det + ln(m[k][k]) FROM e WHERE k <= size),
r AS (SELECT structure, t, eta, y, 3 + eta*n/2 AS shape, 1 + 0.5*m[size + 1][size + 1] AS scale, log_det, -m[size + 1][size + 2] AS loc, -m[size + 2][size + 2] AS spread FROM e WHERE k = size + 1),
u AS (SELECT *, shape + 10 AS far FROM r),
w AS (SELECT *, -0.5*log_det - shape*ln(scale) AS ev, ln(far) - 0.5/far - 1/(12*power(far, 2)) + 1/(120*power(far, 4)) - 1/(252*power(far, 6)) + 1/(240*power(far, 8)) - list_sum(list_transform(range(0, 10), lambda i: 1/(shape + i))) AS psi FROM u),
p AS (SELECT *, exp(ev - max(ev) OVER (PARTITION BY t, eta)) AS w, 0.5*(ln(2*pi()) + ln(scale) - psi + shape/scale*power(y - loc, 2) + spread) AS loss FROM w),
s AS (SELECT t, eta, sum(w*loss)/sum(w) AS loss FROM p GROUP BY t, eta), a AS (SELECT eta AS power, avg(loss) AS loss FROM s GROUP BY eta)
SELECT power, round(loss, 8) AS loss, power = (SELECT max(power) FROM a WHERE loss <= (SELECT min(loss) FROM a) + 1e-12*greatest(1.0, abs((SELECT min(loss) FROM a)))) AS chosen FROM a"""


def adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adequacy e-process of a linear structure against an orthogonal kernel discrepancy, over the months."""
    rows = gram.standardised(yearly(spark, sf_dir), [*X, "y"]).groupBy("yr", "mo").agg(F.avg("l_quantity").alias("x"), F.avg("y").alias("y")).orderBy("yr", "mo").collect()
    x, y = np.array([[r.x] for r in rows]), np.array([r.y for r in rows])
    lin = np.column_stack((np.ones(len(x)), x))
    basis = discrepancy.projected_basis(x, lin)
    log_e, first = discrepancy.adequacy_eprocess([np.ones((len(x), 1)), lin], basis, y, Prior())
    return spark.createDataFrame([(t, float(v), t == first) for t, v in enumerate(log_e)], "round int, log_e double, crosses boolean")


def smc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations of three sizes and two seeds against the exact posterior."""
    rows = gram.standardised(yearly(spark, sf_dir), [*X, "y"]).groupBy("yr").agg(*[F.avg(c).alias(c) for c in [*X, "y"]]).orderBy("yr").collect()
    x, y = np.array([[r[c] for c in X] for r in rows]), np.array([r["y"] for r in rows])
    runs = spark.createDataFrame([("years", n, s) for n in (64, 128) for s in (1, 2)], "dataset string, n int, seed int")
    return smc.population_summary(smc.populations(runs, {"years": (x, y)}, generic_bank(3), Prior()))


def lasso_poly4(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = search.PolynomialLasso(4, 0.01).fit(table(spark, sf_dir, "lineitem"), [F.col("l_quantity"), F.col("l_discount")], F.col("l_extendedprice"))
    return spark.createDataFrame([("lasso", m.best_expression())], "engine string, expression string")


def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("y"))
    m = search.TreeSearch(iterations=6).fit(d, [F.col("l_quantity"), F.col("l_discount")], F.col("y"))
    return spark.createDataFrame([(t, s if np.isfinite(s) else None) for t, s in sorted(m.scores.items())], "expression string, score double")


def exploration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_extendedprice") / 1e5).alias("y"))
    r = search.explore(d, [F.col("a"), F.col("b")], F.col("y"))
    return spark.createDataFrame([(k, t, float(v)) for k, (t, v) in enumerate(r["trace"])], "step int, term string, cv_nmse double")


def grammar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic classes of the open grammar up to five nodes, with mass and multiplicity."""
    return grammar.class_masses(grammar.class_rows(spark, grammar.Grammar(1, 0.4), 5))


def acquisition_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning curves of every policy on monthly means: 32 initial rows, 128 in the pool, the rest for validation, by hash order."""
    d = gram.standardised(yearly(spark, sf_dir), [*X, "y"])
    rows = d.withColumn("h", F.sha2(F.concat_ws(":", "yr", "mo", "l_returnflag"), 256)).orderBy("h").collect()
    x, y = np.array([[r[c] for c in X] for r in rows]), np.array([r["y"] for r in rows])
    n = min(128, len(y) // 2)
    data = {"months": ((x[:32], y[:32]), (x[32 : 32 + n], y[32 : 32 + n]), (x[32 + n :], y[32 + n :]))}
    runs = spark.createDataFrame([("months", p, s) for p in acquisition.POLICIES for s in (1, 2)], "dataset string, policy string, seed int")
    return acquisition.replay(runs, data, generic_bank(3), Prior(), 32)


def discovery_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of one discovery over monthly means: seeds, rounds of all islands, the survivor."""
    d = written(gram.standardised(yearly(spark, sf_dir), [*X, "y"]), "months")
    held = F.pmod(F.xxhash64("yr", "mo", "l_returnflag"), F.lit(4)) == 0
    r = discovery.discover(d.where(~held), d.where(held), [F.col(X[0]), F.col(X[1])], F.col("y"), discovery.Policy(islands=("balanced", "low_complexity"), max_rounds=2))
    return spark.createDataFrame([(e["seq"], e["phase"], e["event"], e["round_id"], e.get("expression")) for e in r["events"]], "seq int, phase string, event string, round_id int, expression string")


QUERIES = {
    "discovery_run": (discovery_run, None),
    "acquisition_runs": (acquisition_runs, None),
    "class_partition": (class_partition, None), "acquisition_scores": (acquisition_scores, None), "predictive_table": (predictive_table, _predictive_sql()), "calibrated_power": (calibrated_power, _power_sql()),
    "adequacy_eprocess": (adequacy, None), "smc_runs": (smc_runs, None), "lasso_poly4": (lasso_poly4, None), "tree_search": (tree_search, None), "exploration_terms": (exploration, None), "grammar_classes": (grammar_classes, None),
}
