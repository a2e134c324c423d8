"""Queries on what comes in an order: prequential scores, ancestries, matchings without replacement; each with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import certify, distance, gram, prequential, sequential
from quillon.operators.ordered import ranked
from quillon.plans.measures import _BETS
from quillon.sources.shared import written
from quillon.sources.tables import table

#: Structures over one feature whose posteriors SQL can spell out.
LINES = [gram.Structure("constant", ("1",), 0.5), gram.Structure("slope", ("x",), 0.2), gram.Structure("line", ("1", "x"), 0.3)]


def event_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their place in the month as a feature, from -1 to 1, and their value as target."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200) / 1296000 - 1
    return table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("x"), (F.col("value") / 40).alias("y"))


def user_pits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events scored in order of time; those of the first three days come first and are not scored."""
    x = F.col("x")
    return prequential.predictive_pits(event_line(spark, sf_dir), x, "event_id", {"1": F.lit(1.0), "x": x}, F.col("y"), LINES, gram.Prior(), x < -0.8, ["user_id"])


def prequential_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user: rows scored, mean transform, sum of log scores, and the e-process against calibration."""
    pits = written(user_pits(spark, sf_dir), "pits")
    e = sequential.pit_eprocess(pits, "user_id", F.col("order"), "event_id", F.col("pit"))
    s = pits.groupBy("user_id").agg(F.round(F.avg("pit"), 6).alias("mean_pit"), F.round(F.sum("log_score"), 5).alias("log_score"), F.max("n_before").alias("most_before"))
    return s.join(e, "user_id").select("user_id", "n", "mean_pit", "log_score", "most_before", F.round("log_e", 5).alias("log_e"), F.round("max_log_e", 5).alias("max_log_e"), "first_crossing")


def _t_cdf(t: str, nu: str) -> str:
    """Student's t distribution function for whole degrees of freedom of 3 or more, as a finite sum."""
    c2 = f"({nu}/({nu} + ({t})*({t})))"
    even = f"0.5*sin(atan(({t})/sqrt({nu})))*list_sum(list_transform(range(0, {nu}//2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + k*ln({c2}))))"
    odd = f"(atan(({t})/sqrt({nu})) + 0.5*sin(2*atan(({t})/sqrt({nu})))*list_sum(list_transform(range(0, ({nu} - 1)//2), lambda k: exp(0.5*ln(pi()) - ln(2) + lgamma(k + 1) - lgamma(k + 1.5) + k*ln({c2})))))/pi()"
    return f"(0.5 + CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)"


#: Sums before each row, the three posteriors spelled out, and their mixture.
_PITS = f"""
v AS (SELECT user_id, event_id, (epoch_us(ts)/1e6 - 1704067200)/1296000 - 1 AS x, value/40 AS y FROM events),
o AS (SELECT *, x < -0.8 AS f FROM v),
s AS (SELECT user_id, event_id, x, y, f, count(*) OVER w AS n, coalesce(sum(x) OVER w, 0) AS sx, coalesce(sum(x*x) OVER w, 0) AS sxx, coalesce(sum(y) OVER w, 0) AS sy, coalesce(sum(x*y) OVER w, 0) AS sxy, coalesce(sum(y*y) OVER w, 0) AS syy
  FROM o WINDOW w AS (PARTITION BY user_id ORDER BY NOT f, x, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, (1 + n)*(1 + sxx) - sx*sx AS det FROM s WHERE NOT f),
m AS (
  SELECT *, ln(0.5) AS lp, ln(1 + n) AS ld, sy*sy/(1 + n) AS fit, sy/(1 + n) AS loc, 1.0/(1 + n) AS spread FROM q
  UNION ALL SELECT *, ln(0.2), ln(1 + sxx), sxy*sxy/(1 + sxx), x*sxy/(1 + sxx), x*x/(1 + sxx) FROM q
  UNION ALL SELECT *, ln(0.3), ln(det), (sy*((1 + sxx)*sy - sx*sxy) + sxy*((1 + n)*sxy - sx*sy))/det, ((1 + sxx)*sy - sx*sxy + x*((1 + n)*sxy - sx*sy))/det, ((1 + sxx) - 2*x*sx + x*x*(1 + n))/det FROM q),
b AS (SELECT user_id, event_id, x, y, n, 6 + n AS nu, loc, lp - 0.5*ld - (3 + n/2)*ln(1 + 0.5*(syy - fit)) AS lw, sqrt((1 + 0.5*(syy - fit))/(3 + n/2)*(1 + spread)) AS sc FROM m),
k AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY event_id)) AS w FROM b),
p AS (SELECT user_id, event_id, x, n, least(1 - 1e-12, greatest(1e-12, sum(w*{_t_cdf("(y - loc)/sc", "nu")})/sum(w))) AS pit,
  ln(sum(w*exp(lgamma((nu + 1)/2) - lgamma(nu/2) - 0.5*ln(nu*pi()) - ln(sc) - (nu + 1)/2*ln(1 + (y - loc)*(y - loc)/(sc*sc*nu))))/sum(w)) AS score FROM k GROUP BY user_id, event_id, x, n)"""

_CALIBRATION = f"""WITH {_PITS},
u AS (SELECT user_id, event_id, x, pit AS u FROM p),
c AS (SELECT user_id, row_number() OVER w AS t, [{", ".join(_BETS)}] AS c FROM u WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id)),
e AS (SELECT user_id, t, list_max(c) + ln(list_sum(list_transform(c, lambda x: exp(x - list_max(c))))/12) AS m FROM c),
f AS (SELECT user_id, max(t) AS n, round(arg_max(m, t), 5) AS log_e, round(max(m), 5) AS max_log_e, coalesce(min(CASE WHEN m >= ln(100.0) THEN t END), -1) AS first_crossing FROM e GROUP BY 1)
SELECT user_id, f.n, round(avg(pit), 6) AS mean_pit, round(sum(score), 5) AS log_score, max(p.n) AS most_before, log_e, max_log_e, first_crossing FROM p JOIN f USING (user_id) GROUP BY ALL"""

def cdf_enclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enclosures of t probabilities of event values, by user: sums of the middles, and whether all are narrow."""
    d = table(spark, sf_dir, "events").select("user_id", ((F.col("value") - 40) / 20).alias("z"), (F.col("user_id") % 5 + 3).alias("nu"))
    e = certify.enclosed_t_cdf(d, F.col("z"), F.col("nu"))
    width = F.col("upper") - F.col("lower")
    return e.groupBy("user_id").agg(F.count("lower").alias("n"), F.round(F.sum((F.col("lower") + F.col("upper")) / 2), 7).alias("total"), ((F.max(width) < 1e-11) & (F.min(width) >= 0)).alias("narrow"))


_ENCLOSURES = f"""WITH d AS (SELECT user_id, (value - 40)/20 AS z, user_id % 5 + 3 AS nu FROM events) SELECT user_id, count(*) AS n, round(sum({_t_cdf("z", "nu")}), 7) AS total, true AS narrow FROM d GROUP BY user_id"""


def bridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as particles, by type: weights after one bridge, as entropy and largest weight, and the evidence's increment."""
    d = table(spark, sf_dir, "events").select("event_type", "event_id", (-F.col("value") / 100).alias("w"), (F.col("user_id") % 7 / 5).alias("now"), (F.col("user_id") % 11 / 4).alias("later"))
    b = sequential.bridge_update(d, ["event_type"], F.when(F.col("event_id") % 13 == 0, float("-inf")).otherwise(F.col("w")), F.col("now"), F.col("later"))
    v = F.exp("log_weight_next")
    return b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 9).alias("total"), F.round(F.max("log_weight_next"), 8).alias("largest"), F.round(-F.sum(F.when(v > 0, v * F.col("log_weight_next"))), 8).alias("entropy"), F.round(F.max("log_increment"), 8).alias("log_increment"))


_BRIDGE = "WITH d AS (SELECT event_type, CASE WHEN event_id % 13 = 0 THEN 0 ELSE exp(-value/100) END AS w, exp(user_id % 11/4 - user_id % 7/5) AS g FROM events), s AS (SELECT *, w*g/sum(w*g) OVER (PARTITION BY event_type) AS v FROM d) SELECT event_type, count(*) AS n, round(sum(v), 9) AS total, round(ln(max(v)), 8) AS largest, round(-sum(CASE WHEN v > 0 THEN v*ln(v) END), 8) AS entropy, round(ln(sum(w*g)/sum(w)), 8) AS log_increment FROM s GROUP BY event_type"


def ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of six-hour windows as children of users of the window before: (step, user_id, parent), the parent by a rule on ranks."""
    e = table(spark, sf_dir, "events").select(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 - 1704067200) / 21600).alias("w"), "user_id").distinct()
    at = e.select("w").distinct().withColumn("step", F.rank().over(Window.orderBy("w")).cast("long"))  # as many rows as windows of time
    u = written(ranked(e.join(F.broadcast(at), "w").select("step", "user_id"), F.col("user_id"), "user_id", "rk", ["step"]), "users")
    n = u.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    parents = u.select((F.col("step") + 1).alias("step"), F.col("user_id").alias("parent"), F.col("rk").alias("pk"))
    asked = u.join(n.select((F.col("step") + 1).alias("step"), "n"), "step").select("step", "user_id", ((F.col("rk") * F.col("rk") + F.col("step")) % F.col("n")).alias("pk"))
    return asked.join(parents, ["step", "pk"]).select("step", "user_id", "parent")


def genealogy_recomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of every step recomposed from the maps, for the log as it is and for one in which a parent at step 9 is unknown."""
    maps = written(ancestry(spark, sf_dir), "maps")
    tracked = written(sequential.recomposed(maps, "step", "user_id", "parent"), "roots")
    whole = maps.join(tracked, ["step", "user_id"])
    broken = whole.withColumn("parent", F.when((F.col("step") == 9) & (F.col("user_id") % 2 == 1), F.lit(-1)).otherwise(F.col("parent")))
    out = [sequential.genealogy_check(m, "step", "user_id", "parent", "root").withColumn("log", F.lit(k)) for k, m in (("as it is", whole), ("altered", broken))]
    sums = tracked.groupBy("step").agg(F.sum(F.col("root") * (F.col("user_id") + 1)).alias("root_sum"))
    return out[0].unionByName(out[1]).join(sums, "step").select("log", "step", "n", "n_roots", "n_broken", "n_wrong", "root_sum")


_ANCESTRY = """
e AS (SELECT DISTINCT CAST(floor((epoch_us(ts)/1000000 - 1704067200)/21600) AS BIGINT) AS w, user_id FROM events),
u AS (SELECT dense_rank() OVER (ORDER BY w) AS step, user_id, row_number() OVER (PARTITION BY w ORDER BY user_id) - 1 AS rk, count(*) OVER (PARTITION BY w) AS n FROM e),
m AS (SELECT DISTINCT c.step, c.user_id, p.user_id AS parent FROM u c JOIN u p ON p.step = c.step - 1 AND p.rk = (c.rk*c.rk + c.step) % p.n),
l AS (SELECT 'as it is' AS log, * FROM m UNION ALL SELECT 'altered', step, user_id, CASE WHEN step = 9 AND user_id % 2 = 1 THEN -1 ELSE parent END FROM m)"""

_GENEALOGY = f"""WITH RECURSIVE {_ANCESTRY},
r(log, step, user_id, root) AS (SELECT log, step, user_id, CASE WHEN parent = -1 THEN NULL ELSE parent END FROM l WHERE step = 2 UNION ALL SELECT l.log, l.step, l.user_id, CASE WHEN l.parent = -1 THEN NULL ELSE r.root END FROM r JOIN l ON l.log = r.log AND l.step = r.step + 1 AND (l.parent = r.user_id OR l.parent = -1 AND r.user_id = (SELECT min(x.user_id) FROM l x WHERE x.step = r.step AND x.log = r.log))),
t AS (SELECT step, user_id, root FROM r WHERE log = 'as it is'),
s AS (SELECT step, sum(root*(user_id + 1)) AS root_sum FROM t GROUP BY step)
SELECT r.log, r.step, count(*) AS n, count(DISTINCT r.root) AS n_roots, CAST(sum(CAST(r.root IS NULL AS INTEGER)) AS BIGINT) AS n_broken, CAST(sum(CAST(r.root IS DISTINCT FROM t.root AS INTEGER)) AS BIGINT) AS n_wrong, CAST(any_value(root_sum) AS BIGINT) AS root_sum
FROM r JOIN t USING (step, user_id) JOIN s USING (step) GROUP BY r.log, r.step"""


def matched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every vector whose id is divisible by 20, takes turns by id over all other vectors, each of which is taken once."""
    d = table(spark, sf_dir, "embeddings")
    return distance.matched(d, d.where("vec_id % 20 = 0"), "vec_id", "embedding").select("query_id", "pool_id", F.round("distance", 5).alias("distance"))


_MATCHED = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS k FROM e WHERE vec_id % 20 = 0),
d AS MATERIALIZED (SELECT k, q.vec_id AS query_id, x.vec_id AS pool_id, list_distance(q.e, x.e) AS dist FROM q JOIN e x ON x.vec_id <> q.vec_id),
r(k, query_id, pool_id, dist, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST([] AS BIGINT[])
  UNION ALL SELECT k + 1, query_id, pool_id, dist, list_append(used, pool_id) FROM (SELECT r.k, r.used, any_value(d.query_id) AS query_id, arg_min(d.pool_id, (d.dist, d.pool_id)) AS pool_id, min(d.dist) AS dist FROM r JOIN d ON d.k = r.k + 1 WHERE NOT list_contains(r.used, d.pool_id) GROUP BY r.k, r.used))
SELECT query_id, pool_id, round(dist, 5) AS distance FROM r WHERE k > 0"""

QUERIES = {
    "bridge_weights": (bridge_weights, _BRIDGE),
    "cdf_enclosures": (cdf_enclosures, _ENCLOSURES),
    "genealogy_recomposed": (genealogy_recomposed, _GENEALOGY),
    "matched_vectors": (matched_vectors, _MATCHED),
    "prequential_calibration": (prequential_calibration, _CALIBRATION),
}
