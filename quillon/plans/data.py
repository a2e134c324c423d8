"""Queries on ingest, roles, designs and statistics, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.columns import abspow, finite, numeric, poly, seeded_hex, sigmoid, signpow, uniform, unsigned64
from quillon.operators import gram, roles
from quillon.sources.tables import table

SEED = 7


def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regression frame of orders: unique id, year as group, total price as target."""
    return table(spark, sf_dir, "orders").withColumn("grp", F.year("o_orderdate"))


def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = finite(numeric("o_totalprice")) & finite(numeric("o_custkey"))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(good.cast("long")).alias("n_finite"), F.sum((~good).cast("long")).alias("n_dropped"))


def hashed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.hash_roles(r1(spark, sf_dir), "o_orderkey", SEED)


def role_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_roles(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"), F.sum("o_orderkey").alias("sum_key"))


_HASHED = """h AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || CAST(o_orderkey AS VARCHAR))) - 1 AS rk, count(*) OVER () AS n FROM orders),
r AS (SELECT *, CASE WHEN rk < round_even(0.60 * n, 0) THEN 'development' WHEN rk < round_even(0.75 * n, 0) THEN 'validation' WHEN rk < round_even(0.90 * n, 0) THEN 'acquisition-pool' ELSE 'untouched-heldout' END AS role FROM h)"""


def role_split_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = r1(spark, sf_dir).withColumn("role", roles.group_roles(F.col("grp"), (1995, 1996, 1997, 1998), 1999, 2000, 2001))
    return d.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("grp").alias("n_groups"), F.round(F.avg("o_totalprice"), 4).alias("mean_y"))


def budget_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.budget_sample(table(spark, sf_dir, "orders"), "o_orderkey", 50, SEED).select("o_orderkey", "o_totalprice")


def selection_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = roles.selection_view(hashed_roles(spark, sf_dir), "o_totalprice")
    return v.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("n_targets"))


def pool_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hashed_roles(spark, sf_dir)
    chosen = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return roles.acquire(d, chosen, "o_custkey").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_y"))


def row_overlap_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("role", roles.group_roles(F.year("l_shipdate"), (1995, 1996, 1997, 1998), 1999, 2000, 2001)).where("role IS NOT NULL")
    return roles.shared_rows(d, ["l_quantity", "l_discount", "l_tax"])


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *rest)
    kept = roles.keep_first(d, ["l_orderkey", "l_linenumber"], [*rest, "l_returnflag"])
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("l_partkey").alias("sum_part"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


X = ("l_quantity", "l_discount", "l_tax")


def terms() -> dict:
    xs = [F.col(c) for c in X]
    names = ("intercept", "x0", "x1", "x2", "x0_sq", "x1_sq", "x2_sq", "x0_x1", "x0_x2", "x1_x2", "x0_cube", "x1_cube", "x2_cube")
    return {n: gram.term(n, xs) for n in names}


_TERMS = {
    "intercept": "1.0", "x0": "l_quantity", "x1": "l_discount", "x2": "l_tax", "x0_sq": "l_quantity*l_quantity", "x1_sq": "l_discount*l_discount", "x2_sq": "l_tax*l_tax", "x0_x1": "l_quantity*l_discount", "x0_x2": "l_quantity*l_tax", "x1_x2": "l_discount*l_tax",
    "x0_cube": "l_quantity*l_quantity*l_quantity", "x1_cube": "l_discount*l_discount*l_discount", "x2_cube": "l_tax*l_tax*l_tax",
}


def design_matrix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram.design_stats(table(spark, sf_dir, "lineitem"), terms()).select("term", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = gram.standardised(table(spark, sf_dir, "lineitem"), [*X, "l_extendedprice"], F.year("l_shipdate") <= 1998)
    return d.groupBy("l_returnflag", "l_linestatus").agg(*[F.round(F.avg(c), 6).alias(f"z_{c}") for c in (*X, "l_extendedprice")], F.count(F.lit(1)).alias("n"))


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries per row, which stay in range as rows grow."""
    t = {k: v for k, v in terms().items() if k in ("intercept", "x0", "x1", "x2")}
    s = gram.gram(table(spark, sf_dir, "lineitem"), t, F.col("l_extendedprice"))
    rows = [(a, b, float(s.xx[i, j] / s.n)) for i, a in enumerate(s.terms) for j, b in enumerate(s.terms) if i <= j] + [(a, "y", float(s.xy[i] / s.n)) for i, a in enumerate(s.terms)]
    return spark.createDataFrame(rows, "a string, b string, v double").select("a", "b", F.round("v", 5).alias("v"))


_T4 = [("intercept", "1.0"), ("x0", "l_quantity"), ("x1", "l_discount"), ("x2", "l_tax")]
_GRAM = " UNION ALL ".join([f"SELECT '{a}' AS a, '{b}' AS b, round(avg(({ea})*({eb})), 5) AS v FROM lineitem" for i, (a, ea) in enumerate(_T4) for j, (b, eb) in enumerate(_T4) if i <= j] + [f"SELECT '{a}', 'y', round(avg(({e})*l_extendedprice), 5) FROM lineitem" for a, e in _T4])


def ridge_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intercept and slope by year, the slope with a penalty of 1."""
    d = table(spark, sf_dir, "lineitem")
    s = gram.grams(d, {"intercept": F.lit(1.0), "x0": F.col("l_quantity")}, F.col("l_extendedprice"), F.year("l_shipdate"))
    rows = [(int(k), *map(float, gram.ridge(v, 1.0))) for k, v in s.items()]
    return spark.createDataFrame(rows, "yr int, b0 double, b1 double").select("yr", F.round("b0", 3).alias("b0"), F.round("b1", 5).alias("b1"))


def intercept_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log evidence of the intercept-only structure on the standardised target, by closed form."""
    d = gram.standardised(table(spark, sf_dir, "lineitem"), ["l_extendedprice"])
    s = gram.gram(d, {"intercept": F.lit(1.0)}, F.col("l_extendedprice"))
    p = gram.conjugate(gram.Structure("intercept", ("intercept",), 1.0), s, gram.Prior())
    return spark.createDataFrame([(p.structure.name, round(p.log_evidence / s.n, 8), int(s.n))], "structure string, log_evidence_per_row double, n long")


def bank_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six nested structures on the standardised line items, ranked: one scan for the scales, one for all statistics."""
    d = gram.standardised(table(spark, sf_dir, "lineitem").select(*X, "l_extendedprice").where(finite("l_extendedprice")), [*X, "l_extendedprice"])
    bank = gram.generic_bank(len(X))
    s = gram.gram(d, terms(), F.col("l_extendedprice"))
    rows = [(p.structure.name, len(p.structure.terms), float(p.log_evidence), float(p.probability), float(p.shape), float(p.scale)) for p in gram.bank_posterior(bank, s, gram.Prior())]
    out = spark.createDataFrame(rows, "structure string, n_terms int, log_evidence double, probability double, shape double, scale double")
    return out.select("structure", "n_terms", *[F.round(c, k).alias(c) for c, k in (("log_evidence", 4), ("probability", 6), ("shape", 1), ("scale", 4))])


def z_terms() -> dict[str, str]:
    """The terms as SQL over x0, x1, x2."""
    return {"intercept": "1.0", **{n: e.replace("l_quantity", "x0").replace("l_discount", "x1").replace("l_tax", "x2") for n, e in _TERMS.items() if n != "intercept"}}


def _bank_sql() -> str:
    """Sums of products of all terms, and Gaussian elimination of each structure's part: pivots give the determinant, what is left of y'y the scale."""
    names, every = list(z_terms()), [*z_terms().values(), "y"]
    sums = ", ".join("[" + ", ".join(f"sum(({every[min(i, j)]})*({every[max(i, j)]}))" for j in range(len(every))) + "]" for i in range(len(every)))
    rows = ", ".join(f"('{b.name}', {[names.index(t) + 1 for t in b.terms] + [len(every)]})" for b in gram.generic_bank(len(X)))
    scales = ", ".join(f"avg({c}) AS m{k}, stddev_pop({c}) AS s{k}" for k, c in enumerate((*X, "l_extendedprice")))
    z = ", ".join(f"({c} - m{k})/s{k} AS {'y' if k == len(X) else f'x{k}'}" for k, c in enumerate((*X, "l_extendedprice")))
    return f"""WITH RECURSIVE st AS (SELECT {scales} FROM lineitem), z AS (SELECT {z} FROM lineitem, st), g AS MATERIALIZED (SELECT count(*) AS n, [{sums}] AS g FROM z),
b(structure, idx) AS (VALUES {rows}),
e(structure, n, k, size, m, log_det) AS (
  SELECT structure, n, 1, len(idx), list_transform(idx, lambda i: list_transform(idx, lambda j: g[i][j] + CASE WHEN i = j AND i <> {len(every)} THEN 1.0 ELSE 0.0 END)), CAST(0 AS DOUBLE) FROM b, g
  UNION ALL SELECT structure, n, k + 1, size, list_transform(range(1, size + 1), lambda i: CASE WHEN i <= k THEN m[i] ELSE list_transform(range(1, size + 1), lambda j: m[i][j] - m[i][k]/m[k][k]*m[k][j]) END), log_det + ln(m[k][k]) FROM e WHERE k < size),
r AS (SELECT structure, size - 1 AS n_terms, n, 3 + n/2 AS shape, 1 + 0.5*m[size][size] AS scale, log_det FROM e WHERE k = size),
v AS (SELECT *, -n/2*ln(2*pi()) - 0.5*log_det - shape*ln(scale) + lgamma(shape) - lgamma(3) AS ev FROM r)
SELECT structure, CAST(n_terms AS INTEGER) AS n_terms, round(ev, 4) AS log_evidence, round(exp(ev - (SELECT max(ev) FROM v))/(SELECT sum(exp(ev - (SELECT max(ev) FROM v))) FROM v), 6) AS probability, round(shape, 1) AS shape, round(scale, 4) AS scale FROM v"""


def expression_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.functions.expressions import compile_expression

    e = compile_expression("x0*x1 + sin(x2) - 0.5*x0**2/(1 + abs(x1))", [F.col(c) for c in X])
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(e), 6).alias("mean_e"), F.round(F.min(e), 6).alias("min_e"), F.round(F.max(e), 6).alias("max_e"))


def guarded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of many candidates in one aggregate; a single row outside a domain voids the whole candidate."""
    from quillon.functions.expressions import score_candidates

    d = table(spark, sf_dir, "lineitem")
    return score_candidates(d, CANDIDATES, [F.col(c) for c in X], F.col("l_extendedprice") / 1000).select("candidate", F.round("mse", 5).alias("mse"), "valid")


CANDIDATES = ["x0", "x0*x1", "log(x1)", "exp(x0)", "sin(x0)+cos(x1)", "x0**2/50", "1.5*x0 - x1"]
_CANDIDATES = [("x0", "l_quantity", "true"), ("x0*x1", "l_quantity*l_discount", "true"), ("log(x1)", "CASE WHEN l_discount > 1e-6 THEN ln(l_discount) END", "l_discount > 1e-6"), ("exp(x0)", "CASE WHEN abs(l_quantity) <= 20 THEN exp(l_quantity) END", "abs(l_quantity) <= 20"), ("sin(x0)+cos(x1)", "sin(l_quantity)+cos(l_discount)", "true"), ("x0**2/50", "l_quantity*l_quantity/50", "true"), ("1.5*x0 - x1", "1.5*l_quantity - l_discount", "true")]


def scalar_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal") / 1000
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(abspow(x, 1.5), 6).alias("abspow"), F.round(signpow(x, 2.0), 6).alias("signpow"), F.round(sigmoid(x), 8).alias("sigmoid"))


def polynomial_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = poly([(2, (1, 0)), (-3, (1, 1)), (1, (0, 2)), (5, (0, 0))], [F.col("l_discount"), F.col("l_tax")])
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg(p), 8).alias("mean_p"), F.round(F.max(p), 8).alias("max_p"))


def derived_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and uniforms from the first eight bytes of SHA-256."""
    d = table(spark, sf_dir, "supplier").withColumn("h", F.sha2(F.concat(F.lit("quillon:7:"), F.col("s_suppkey").cast("string"), F.lit(":random")), 256))
    return d.select("s_suppkey", unsigned64(F.col("h")).cast("string").alias("seed"), F.round(uniform(F.col("h")), 10).alias("u"), F.substring(seeded_hex(SEED, F.col("s_suppkey").cast("string")), 1, 12).alias("prefix"))


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the ordered parts of each order."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("ids"))
    return d.select("l_orderkey", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("commitment"))


def normalise_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text repair of expressions: ^ to **, prefixes off, implicit products."""
    from quillon.functions.expressions import normalise_column

    raw = F.concat(F.lit("np.sin(x0)^2 + "), F.col("p_size").cast("string"), F.lit("x1  -  math.abs(x"), (F.col("p_size") % 7).cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", normalise_column(raw).alias("expression"))


QUERIES = {
    "finite_filter": (finite_filter, "SELECT o_orderstatus, count(*) AS n_rows, count(*) FILTER (isfinite(o_totalprice)) AS n_finite, count(*) FILTER (o_totalprice IS NULL OR NOT isfinite(o_totalprice)) AS n_dropped FROM orders GROUP BY 1"),
    "role_split_hash": (role_split_hash, f"WITH {_HASHED} SELECT role, count(*) AS n, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, CAST(sum(o_orderkey) AS BIGINT) AS sum_key FROM r GROUP BY role"),
    "role_split_group": (role_split_group, "SELECT CASE WHEN year(o_orderdate) <= 1998 THEN 'development' WHEN year(o_orderdate) = 1999 THEN 'validation' WHEN year(o_orderdate) = 2000 THEN 'acquisition-pool' WHEN year(o_orderdate) = 2001 THEN 'untouched-heldout' END AS role, count(*) AS n, count(DISTINCT year(o_orderdate)) AS n_groups, round(avg(o_totalprice), 4) AS mean_y FROM orders GROUP BY 1"),
    "budget_sample_hash": (budget_sample_hash, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('7:' || CAST(o_orderkey AS VARCHAR)) LIMIT 50"),
    "selection_view": (selection_view, f"WITH {_HASHED} SELECT role, count(*) AS n, count(CASE WHEN role <> 'acquisition-pool' THEN o_totalprice END) AS n_targets FROM r WHERE role <> 'untouched-heldout' GROUP BY role"),
    "pool_reveal": (pool_reveal, f"WITH {_HASHED} SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_y FROM r WHERE role = 'acquisition-pool' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1"),
    "row_overlap_roles": (row_overlap_roles, "WITH d AS (SELECT DISTINCT l_quantity, l_discount, l_tax, CASE WHEN year(l_shipdate) <= 1998 THEN 'development' WHEN year(l_shipdate) = 1999 THEN 'validation' WHEN year(l_shipdate) = 2000 THEN 'acquisition-pool' WHEN year(l_shipdate) = 2001 THEN 'untouched-heldout' END AS role FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2001) SELECT a.role AS role_a, b.role AS role_b, count(*) AS n_shared FROM d a JOIN d b USING (l_quantity, l_discount, l_tax) WHERE a.role < b.role GROUP BY 1, 2"),
    "dedup_keep_first": (dedup_keep_first, "WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS k FROM lineitem) SELECT l_returnflag, count(*) AS n_kept, CAST(sum(l_partkey) AS BIGINT) AS sum_part, round(sum(l_quantity), 2) AS sum_qty FROM d WHERE k = 1 GROUP BY 1"),
    "design_matrix_stats": (design_matrix_stats, " UNION ALL ".join(f"SELECT '{n}' AS term, {'0.0' if n == 'intercept' else f'round(avg({e}), 6)'} AS mean, {'1.0' if n == 'intercept' else f'round(stddev_pop({e}), 6)'} AS scale FROM {'(SELECT 1)' if n == 'intercept' else 'lineitem'}" for n, e in _TERMS.items()).replace("0.0 AS mean, 1.0 AS scale", "CAST(0 AS DOUBLE) AS mean, CAST(1 AS DOUBLE) AS scale")),
    "standardize": (standardize, "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m{k}, stddev_pop({c}) AS s{k}" for k, c in enumerate((*X, "l_extendedprice"))) + " FROM lineitem WHERE year(l_shipdate) <= 1998) SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(avg(({c} - m{k}) / s{k}), 6) AS z_{c}" for k, c in enumerate((*X, "l_extendedprice"))) + ", count(*) AS n FROM lineitem, s GROUP BY 1, 2"),
    "gram_matrix": (gram_matrix, _GRAM),
    "ridge_closed_form": (ridge_closed_form, "WITH s AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, count(*) AS n, sum(l_quantity) AS sx, sum(l_quantity*l_quantity) + 1 AS sxx, sum(l_extendedprice) AS sy, sum(l_quantity*l_extendedprice) AS sxy FROM lineitem GROUP BY 1) SELECT yr, round((sy*sxx - sx*sxy) / (n*sxx - sx*sx), 3) AS b0, round((n*sxy - sx*sy) / (n*sxx - sx*sx), 5) AS b1 FROM s"),
    "intercept_evidence": (intercept_evidence, "WITH s AS (SELECT count(*) AS n FROM lineitem), p AS (SELECT n, 3 + n/2.0 AS a, 1 + 0.5*n AS b FROM s) SELECT 'intercept' AS structure, round((-n/2.0*ln(2*pi()) - 0.5*ln(1.0 + n) - a*ln(b) + lgamma(a) - lgamma(3)) / n, 8) AS log_evidence_per_row, n FROM p"),
    "bank_posterior": (bank_posterior, _bank_sql()),
    "expression_eval": (expression_eval, "WITH e AS (SELECT l_returnflag, l_quantity*l_discount + sin(l_tax) - 0.5*l_quantity*l_quantity/(1 + abs(l_discount)) AS e FROM lineitem) SELECT l_returnflag, round(avg(e), 6) AS mean_e, round(min(e), 6) AS min_e, round(max(e), 6) AS max_e FROM e GROUP BY 1"),
    "guarded_candidates": (guarded_candidates, " UNION ALL ".join(f"SELECT '{n}' AS candidate, CASE WHEN bool_and({ok}) THEN round(avg(power(({e}) - l_extendedprice/1000, 2)), 5) END AS mse, bool_and({ok}) AS valid FROM lineitem" for n, e, ok in _CANDIDATES)),
    "scalar_powers": (scalar_powers, "SELECT c_custkey, round(power(abs(c_acctbal/1000), 1.5), 6) AS abspow, round(sign(c_acctbal)*power(abs(c_acctbal/1000), 2.0), 6) AS signpow, round(1/(1+exp(-least(greatest(c_acctbal/1000, -40), 40))), 8) AS sigmoid FROM customer"),
    "polynomial_eval": (polynomial_eval, "SELECT l_linenumber, round(avg(2*l_discount - 3*l_discount*l_tax + l_tax*l_tax + 5), 8) AS mean_p, round(max(2*l_discount - 3*l_discount*l_tax + l_tax*l_tax + 5), 8) AS max_p FROM lineitem GROUP BY 1"),
    "derived_seed": (derived_seed, "SELECT s_suppkey, CAST(CAST('0x' || substr(sha256('quillon:7:' || CAST(s_suppkey AS VARCHAR) || ':random'), 1, 16) AS UBIGINT) AS VARCHAR) AS seed, round(CAST(CAST('0x' || substr(sha256('quillon:7:' || CAST(s_suppkey AS VARCHAR) || ':random'), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0, 10) AS u, substr(sha256('7:' || CAST(s_suppkey AS VARCHAR)), 1, 12) AS prefix FROM supplier"),
    "commitments": (commitments, "SELECT l_orderkey, count(*) AS n, sha256(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)) AS commitment FROM lineitem GROUP BY 1"),
    "normalise_expressions": (normalise_expressions, "SELECT p_partkey, 'sin(x0)**2 + ' || CAST(p_size AS VARCHAR) || '*x1 - Abs(x' || CAST(p_size % 7 AS VARCHAR) || ')' AS expression FROM part"),
}
