"""Queries on workbooks, logged events, choices and edits, each with equal SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import expressions as ex
from quillon.operators import certify, distance, evidence, grammar, information, metrics, ranking, refine, roles, sequential
from quillon.plans.measures import _LIK, _likelihoods
from quillon.sources import tables, workbooks
from quillon.sources.shared import shared_dir
from quillon.sources.tables import table


def workbook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts put into workbooks of some hundred rows, and read back from their bytes."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", F.floor(F.col("p_partkey") / 500).alias("book"))
    sheet = workbooks.with_header(workbooks.rows(workbooks.as_workbooks(p, "book"), "Sheet1"), ["p_retailprice", "p_partkey", "p_name", "p_size"])
    return sheet.select(F.regexp_extract("path", r"book=(\d+)", 1).cast("long").alias("book"), "row", F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice")).groupBy("book").agg(
        F.count(F.lit(1)).alias("n"), F.max("row").alias("last_row"), F.sum("p_partkey").alias("keys"), F.sum("p_size").alias("sizes"), F.round(F.sum("p_retailprice"), 4).alias("prices"), F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name")
    )


_WORKBOOKS = "SELECT CAST(floor(p_partkey/500) AS BIGINT) AS book, count(*) AS n, count(*) + 1 AS last_row, CAST(sum(p_partkey) AS BIGINT) AS keys, CAST(sum(p_size) AS BIGINT) AS sizes, round(sum(p_retailprice), 4) AS prices, min(p_name) AS first_name, max(p_name) AS last_name FROM part GROUP BY 1"


def event_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of fields rebuilt from the payloads of logged events, by type."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("hypothesis_id"), "event_type", F.col("props").alias("payload"))
    out = None
    for t in ("click", "error", "purchase", "signup", "view"):
        part = evidence.payload_table(e, t).groupBy("hypothesis_id").agg(F.count("k").alias("n"), F.sum(F.col("k").cast("long")).alias("k_sum")).withColumn("event_type", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out.select("event_type", F.col("hypothesis_id").cast("long").alias("user_id"), "n", "k_sum")


_EVENT_TABLES = "SELECT event_type, user_id, count(json_extract(props, '$.k')) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1, 2"


def class_update_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop of class entropy by a tempered update when priorities are structures and several of them one class."""
    d = _likelihoods(spark, sf_dir).withColumn("cls", F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), "high").when(F.col("o_orderpriority").startswith("3"), "medium").otherwise("low"))
    u = information.update_utility(d, ["action"], "o_orderpriority", "o_orderstatus", "prior", "lik", 0.5, "cls")
    return u.select("action", *[F.round(c, 8).alias(c) for c in ("entropy_before", "entropy_after", "utility")])


_CLASS_UTILITY = f"""WITH {_LIK}, k AS (SELECT *, CASE WHEN s[1] IN ('1', '2') THEN 'high' WHEN s[1] = '3' THEN 'medium' ELSE 'low' END AS cls FROM l),
j AS (SELECT action, y, cls, sum(prior*lik) AS j, sum(prior*sqrt(lik)) AS w FROM k GROUP BY 1, 2, 3),
o AS (SELECT action, y, sum(j) AS py, sum(w) AS z, sum(w*ln(w)) AS e FROM j GROUP BY 1, 2), a AS (SELECT action, sum(py*(ln(z) - e/z)) AS a FROM o GROUP BY 1),
p AS (SELECT action, cls, sum(prior) AS p FROM (SELECT DISTINCT action, s, cls, prior FROM k) GROUP BY 1, 2), b AS (SELECT action, -sum(p*ln(p)) AS b FROM p GROUP BY 1)
SELECT CAST(action AS INTEGER) AS action, round(b, 8) AS entropy_before, round(a, 8) AS entropy_after, round(b - a, 8) AS utility FROM a JOIN b USING (action)"""


def least_favourable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand the likelihood power under which its mean score is least; scores of some powers tie."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_size").alias("m"), F.count(F.lit(1)).alias("n"))
    s = p.select("p_brand", "m", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75, 1.0)))).alias("power")).withColumn("score", F.abs(F.round(F.col("m")) % 4 - F.floor(F.col("power") * 3)))
    return ranking.least_favourable(s, ["p_brand"], "power", "score").select("p_brand", "power", "least")


_LEAST = "WITH p AS (SELECT p_brand, avg(p_size) AS m FROM part GROUP BY 1), s AS (SELECT p_brand, w, abs(round(m) % 4 - floor(w*3)) AS s FROM p, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) k(w)) SELECT p_brand, arg_min(w, (s, w)) AS power, min(s) AS least FROM s GROUP BY 1"


def engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type the best part by price, size and name, and the median price."""
    d = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")))
    return ranking.best_with_median(d, ["p_type"], "p_retailprice", "p_size", "name", ["p_partkey"]).select("p_type", "p_partkey", F.round("median", 6).alias("median"), "n")


_ENGINES = "SELECT p_type, arg_min(p_partkey, (p_retailprice, p_size, p_name || '#' || p_partkey)) AS p_partkey, round(quantile_cont(p_retailprice, 0.5), 6) AS median, count(*) AS n FROM part GROUP BY 1"


def top_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty cheapest names, of parts of one type and size only the cheapest."""
    d = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("digest"), "p_retailprice", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"))
    return ranking.top_distinct(d, "digest", "p_retailprice", "name", 20).select("digest", "name", "p_retailprice")


_TOP = "WITH d AS (SELECT p_type || '/' || p_size AS digest, p_retailprice, p_name || '#' || p_partkey AS name FROM part QUALIFY row_number() OVER (PARTITION BY p_type || '/' || p_size ORDER BY p_retailprice, p_name || '#' || p_partkey) = 1) SELECT digest, name, p_retailprice FROM d ORDER BY p_retailprice, name LIMIT 20"

#: Edits of expressions with a number of a part in them, and what they are.
EDITS = [
    ("x0 + {n}*x1", "x0 + {n}*x1", "NOOP"), ("{n}*x1 + x0", "x0 + x1*{n}", "NOOP"), ("x0*{n}", "x0*{n}.5", "REPARAMETERIZE"), ("x0 + {n}", "x0 + {n} + sin(x1)", "ADD"), ("sin(x0)", "cos(x0)", "CHANGE_OPERATOR"),
    ("sin(x0)", "sin(x0*x1)", "CHANGE_INTERACTION"), ("sin(x0)", "x1**2 + {n}", "REPLACE"), ("x0", "sin(x0)", "ADD"), ("sin(x0*x1)", "x0*x1", "DELETE"), ("sin(", "x0", None),
]


def edit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of expressions, one for each part, by label and by the label that was planted."""
    pick = F.col("p_partkey") % len(EDITS)
    n = F.col("p_size").cast("string")
    text = lambda k: F.element_at(F.array(*[F.lit(e[k]) for e in EDITS]), (pick + 1).cast("int"))
    d = table(spark, sf_dir, "part").select(F.regexp_replace(text(0), r"\{n\}", n).alias("a"), F.regexp_replace(text(1), r"\{n\}", n).alias("b"), text(2).alias("planted"))
    return ranking.edits(d, "a", "b", 2).groupBy("planted", "action").agg(F.count(F.lit(1)).alias("n"))


_EDITS = "WITH k(i, planted) AS (VALUES " + ", ".join(f"({k}, {'NULL' if e[2] is None else repr(e[2])})" for k, e in enumerate(EDITS)) + f") SELECT planted, planted AS action, count(*) AS n FROM part JOIN k ON i = p_partkey % {len(EDITS)} GROUP BY 1, 2"


def complete_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metropolis-Hastings over order priorities with every other state proposed alike, and with proposals by a prior."""
    s = table(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("state")).agg(F.count(F.lit(1)).alias("c")).select("state", F.ln("c").alias("log_target"), F.col("state").cast("double").alias("prior"))
    out = None
    for kind in ("uniform", "prior"):
        m = sequential.mh_transition(s, sequential.complete_proposals(s, kind, "prior")).withColumn("kind", F.lit(kind))
        out = m if out is None else out.unionByName(m)
    return out.select("kind", "source", "target", F.round("p", 8).alias("p"))


_COMPLETE = "WITH s AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS s, count(*) AS c FROM orders GROUP BY 1), e AS (SELECT 'uniform' AS kind, a.s AS source, b.s AS target, 1.0/((SELECT count(*) FROM s) - 1)*least(1.0, b.c/a.c) AS p FROM s a JOIN s b ON a.s <> b.s UNION ALL SELECT 'prior', a.s, b.s, b.s/(SELECT sum(s) FROM s)*least(1.0, b.c*a.s/(a.c*b.s)) FROM s a JOIN s b ON a.s <> b.s), d AS (SELECT * FROM e UNION ALL SELECT kind, source, source, 1 - sum(p) FROM e GROUP BY 1, 2) SELECT kind, source, target, round(p, 8) AS p FROM d"


def target_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers about the targets' means, over scales that fall back to all points where the targets don't vary."""
    d = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7 == 0).alias("t"), (F.col("s_acctbal") / 1000).alias("a"), F.when(F.col("s_suppkey") % 7 == 0, 2.0).otherwise(F.col("s_nationkey").cast("double")).alias("b"), F.lit(5.0).alias("c"))
    out = distance.standardised_by_targets(d, ["a", "b", "c"], F.col("t"))
    return out.select("s_suppkey", *[F.round(c, 8).alias(c) for c in ("a", "b", "c")])


_SCALES = "WITH d AS (SELECT s_suppkey, s_suppkey % 7 = 0 AS t, s_acctbal/1000 AS a, CASE WHEN s_suppkey % 7 = 0 THEN 2.0 ELSE s_nationkey END AS b FROM supplier), m AS (SELECT avg(a) FILTER (t) AS ma, avg(b) FILTER (t) AS mb FROM d), k AS (SELECT sqrt(avg((a - ma)*(a - ma)) FILTER (t)) AS sa, sqrt(avg((b - mb)*(b - mb))) AS sb FROM d, m) SELECT s_suppkey, round((a - ma)/sa, 8) AS a, round((b - mb)/sb, 8) AS b, CAST(0 AS DOUBLE) AS c FROM d, m, k"


def binned_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass of parts in classes of two binned coordinates, by their share of the price; null where an interval crosses an edge."""
    p = table(spark, sf_dir, "part")
    total = p.agg(F.sum("p_retailprice").alias("t"))
    d = p.crossJoin(F.broadcast(total)).select(F.col("p_partkey").alias("state"), (F.col("p_retailprice") / F.col("t")).alias("mass"), F.explode(F.array(F.struct(F.lit(0).alias("coordinate"), F.col("p_size").cast("double").alias("v")), F.struct(F.lit(1).alias("coordinate"), (F.col("p_partkey") % 40).cast("double").alias("v")))).alias("e"))
    s = d.select("state", "mass", "e.coordinate", (F.col("e.v") - 0.75).alias("lower"), (F.col("e.v") + 0.75).alias("upper"))
    return certify.class_masses(certify.BinnedClasses((10.5, 20.5, 30.5)), s).select("class_id", F.round("mass", 9).alias("mass"))


_BINNED = "WITH w AS (SELECT p_partkey, p_size AS a, p_partkey % 40 AS c, p_retailprice/(SELECT sum(p_retailprice) FROM part) AS mass FROM part), z AS (SELECT mass, " + ", ".join(f"CAST({v} - 0.75 >= 10.5 AS INT) + CAST({v} - 0.75 >= 20.5 AS INT) + CAST({v} - 0.75 >= 30.5 AS INT) AS l{v}, CAST({v} + 0.75 >= 10.5 AS INT) + CAST({v} + 0.75 >= 20.5 AS INT) + CAST({v} + 0.75 >= 30.5 AS INT) AS h{v}" for v in ("a", "c")) + " FROM w) SELECT CASE WHEN la = ha AND lc = hc THEN la || ',' || lc END AS class_id, round(sum(mass), 9) AS mass FROM z GROUP BY 1"

def paired_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned and accepted line items of a part side by side: lines as budget, mean discount as error."""
    d = table(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')").groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("units"), F.round(F.avg("l_discount"), 8).alias("error"))
    p = metrics.paired_methods(d, ["l_partkey"], "l_returnflag", "A", "R", ["lines", "units"], ["error"])
    return p.select("l_partkey", "lines_base", "lines_candidate", "lines_matched", "units_matched", F.round("error_improvement", 8).alias("improvement"))


_PAIRED = "WITH d AS (SELECT l_partkey, l_returnflag AS f, count(*) AS n, round(sum(l_quantity), 2) AS u, round(avg(l_discount), 8) AS e FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2) SELECT a.l_partkey, a.n AS lines_base, b.n AS lines_candidate, a.n = b.n AS lines_matched, a.u = b.u AS units_matched, round(a.e - b.e, 8) AS improvement FROM d a JOIN d b ON a.l_partkey = b.l_partkey AND a.f = 'A' AND b.f = 'R'"


def floored_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference dominance whose bar is zero at least: utilities that updating can only lose hand over only above it."""
    d = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") / 1000 - 9).alias("lo"), (F.col("s_acctbal") / 1000 - 8.5).alias("hi"), (F.abs("s_acctbal") + 1).alias("ref"))
    return ranking.reference_dominance(d, ["s_nationkey"], "s_suppkey", "lo", "hi", "ref", True).select("s_nationkey", "leader", F.round("leader_lower", 6).alias("leader_lower"), F.round("reference_upper", 6).alias("reference_upper"), "hands_over")


_FLOORED = "WITH d AS (SELECT s_nationkey, s_suppkey, s_acctbal/1000 - 9 AS lo, s_acctbal/1000 - 8.5 AS hi, abs(s_acctbal) + 1 AS ref FROM supplier), a AS (SELECT s_nationkey, arg_max(s_suppkey, (lo, -s_suppkey)) AS leader, max(lo) AS l, greatest(0, sum(ref*hi)/sum(ref)) AS bar, max(greatest(abs(lo), abs(hi))) AS size FROM d GROUP BY 1) SELECT s_nationkey, leader, round(l, 6) AS leader_lower, round(bar, 6) AS reference_upper, l - bar > 256*2.220446049250313e-16*greatest(1, size) AS hands_over FROM a"

#: Expressions with what is known of each: allowed for discovery, for hypotheses, operations, tree rows, complexity, canonical form, polynomial.
FACTS = [
    ("x0 + x1", True, True, 1, 3, 1.1, "x0 + x1", "1*x1^1 + 1*x0^1"), ("x1+x0", True, True, 1, 3, 1.1, "x0 + x1", "1*x1^1 + 1*x0^1"), ("2*x0 - x1**2", True, True, 3, 7, 3.55, "2*x0 + -1*x1**2", "-1*x1^2 + 2*x0^1"),
    ("(x0 + 1)*(x0 - 1)", True, True, 3, 7, 3.55, "(-1 + x0)*(1 + x0)", "-1 + 1*x0^2"), ("x0**2 - 1", True, True, 2, 5, 2.55, "-1 + x0**2", "-1 + 1*x0^2"), ("sin(x0)*x1", True, True, 2, 4, 2.15, "sin(x0)*x1", None),
    ("log10(x0)", False, True, None, None, None, None, None), ("abspow(x0, 2)", True, False, 1, 3, 1.3, "abspow(x0,2)", None), ("x0 +", False, False, None, None, None, None, None), ("x5 + 1", False, False, None, None, None, None, None),
    ("x0^2 + 3x1", True, True, 3, 7, 3.55, "x0**2 + 3*x1", "3*x1^1 + 1*x0^2"), ("np.tanh(x0)", True, True, 1, 2, 1.1, "tanh(x0)", None), ("-(x0 - x1)", True, True, 2, 4, 2.15, "-1*x0 + x1", "1*x1^1 + -1*x0^1"), ("x1 - x0", True, True, 1, 3, 1.1, "-1*x0 + x1", "1*x1^1 + -1*x0^1"),
]


def expression_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of expressions, one for each part, with how many parts have it."""
    text = F.element_at(F.array(*[F.lit(f[0]) for f in FACTS]), (F.col("p_partkey") % len(FACTS) + 1).cast("int"))
    d = table(spark, sf_dir, "part").groupBy(text.alias("expression")).agg(F.count(F.lit(1)).alias("n"))
    return ex.facts(d, "expression", 2).withColumn("complexity", F.round("complexity", 6))


def _value(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) + "::DOUBLE" if isinstance(v, float) else repr(v)


_FACTS = "WITH k(i, expression, discovery, hypothesis, operations, nodes, complexity, canonical, polynomial) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_value, f))})" for i, f in enumerate(FACTS)) + f") SELECT expression, count(*) AS n, discovery, hypothesis, CAST(operations AS INTEGER) AS operations, CAST(nodes AS INTEGER) AS nodes, complexity, canonical, polynomial FROM part JOIN k ON i = p_partkey % {len(FACTS)} GROUP BY ALL"

RHO, COUNTS = 0.4, (2, 2, 10, 26, 114)


def grammar_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions of the open grammar by size and rank, one for each part, with their prior and polynomial."""
    size = (F.col("p_size") % len(COUNTS) + 1).cast("int")
    d = table(spark, sf_dir, "part").select(size.alias("size"), (F.col("p_partkey") % F.element_at(F.array(*map(F.lit, COUNTS)), size)).alias("rank"))
    d = d.groupBy("size", "rank").agg(F.count(F.lit(1)).alias("n"))
    return grammar.unranked(d, "size", "rank", 1, RHO).withColumn("prior", F.round("prior", 12))


def _ranked_shells() -> str:
    """Expressions of each size in rank order, from those of smaller sizes; coefficients up to the third power beside them."""
    plus, times = "list_transform(range(1, 5), lambda i: a.c[i] + b.c[i])", "list_transform(range(1, 5), lambda k: CAST(list_sum(list_transform(range(1, k + 1), lambda i: a.c[i]*b.c[k + 1 - i])) AS BIGINT))"
    out = ["e1(r, txt, c) AS (VALUES (0::BIGINT, '1', [1, 0, 0, 0]::BIGINT[]), (1::BIGINT, 'x0', [0, 1, 0, 0]::BIGINT[]))"]
    for n in range(2, len(COUNTS) + 1):
        parts = [f"SELECT 0 AS o, 0 AS k, r AS ra, 0 AS rb, '-(' || txt || ')' AS txt, list_transform(c, lambda v: -v) AS c FROM e{n - 1}"]
        parts += [f"SELECT {o}, {k}, a.r, b.r, '(' || a.txt || ' {op} ' || b.txt || ')', {f} FROM e{k} a, e{n - 1 - k} b" for o, op, f in ((1, "+", plus), (2, "*", times)) for k in range(1, n - 1)]
        out.append(f"e{n} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o, k, ra, rb) - 1 AS r, txt, c FROM ({' UNION ALL '.join(parts)}))")
    return ", ".join(out)


_POLY = "coalesce(nullif(concat_ws(' + ', " + ", ".join(f"CASE WHEN c[{k + 1}] <> 0 THEN c[{k + 1}] || '{f'*x0^{k}' if k else ''}' END" for k in range(4)) + "), ''), '0')"
_RANKS = f"WITH {_ranked_shells()}, e AS (" + " UNION ALL ".join(f"SELECT {n} AS size, r, txt, c, {1 - RHO}*power({RHO}, {n - 1})/(SELECT count(*) FROM e{n}) AS prior FROM e{n}" for n in range(1, len(COUNTS) + 1)) + f"), p AS (SELECT p_size % {len(COUNTS)} + 1 AS size, p_partkey FROM part), q AS (SELECT size, p_partkey % (SELECT count(*) FROM e WHERE e.size = p.size) AS rank, count(*) AS n FROM p GROUP BY 1, 2) SELECT CAST(q.size AS INTEGER) AS size, rank, n, txt AS expression, round(prior, 12) AS prior, {_POLY} AS polynomial FROM q JOIN e ON e.size = q.size AND e.r = q.rank"


def source_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as yearly delimited files, white-space separated text and JSON lines, read back by each scan, and changed by an upsert: rows and totals by year."""
    base = f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("yr"))
    years = sorted(r.yr for r in o.select("yr").distinct().collect())
    for y in years:
        o.where(F.col("yr") == y).drop("yr").write.csv(f"{base}/years/{y}.csv", header=True)
    o.select(F.concat_ws("   ", F.lit(""), F.col("yr").cast("string"), F.col("o_orderkey").cast("string"), F.col("price").cast("string"))).write.text(f"{base}/plain")
    o.write.json(f"{base}/lines")
    registry = tables.Registry()
    registry.add(" Orders ", lambda s, root: tables.finalise(tables.union_years(s, {y: f"{root}/years/{y}.csv" for y in years}), ["o_orderkey"], "price"))
    delimited = registry.load(spark, "ORDERS", base).select(F.col("group").alias("yr"), "o_orderkey", "price")
    plain = tables.read_columns(spark, f"{base}/plain", ["yr", "o_orderkey", "price"])
    lines = tables.read_json_lines(spark, f"{base}/lines", "o_orderkey long, price double, yr int", strict=True)
    newer = o.where("o_orderkey % 3 = 0").withColumn("price", F.col("price") + 1)
    every = [("delimited", delimited), ("columns", plain), ("json", lines), ("upsert", tables.upsert(lines, newer.select(lines.columns), "o_orderkey"))]
    out = None
    for name, d in every:
        part = d.groupBy(F.col("yr").cast("int").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("price").cast("double")), 2).alias("total"), F.sum(F.col("o_orderkey").cast("long")).alias("keys")).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_TRIPS = "SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n, round(sum(o_totalprice + CASE WHEN source = 'upsert' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END), 2) AS total, CAST(sum(o_orderkey) AS BIGINT) AS keys, source FROM orders, (VALUES ('delimited'), ('columns'), ('json'), ('upsert')) k(source) GROUP BY 1, source"

def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of small parts, staged with larger ones that aren't there, and promoted by brands that were confirmed: the forty best."""
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", (F.col("p_size") % 20).cast("string")).alias("entry_id"), F.col("p_brand").alias("hypothesis_id"), F.round("p_retailprice", 2).alias("gain"), "p_partkey", "p_size")
    store = p.where("p_size <= 10").groupBy("entry_id").agg(F.count(F.lit(1)).cast("int").alias("successes"), F.max("gain").alias("gain"))
    fresh = p.where("p_size > 40").groupBy("entry_id").agg(F.lit(0).alias("successes"), F.min("gain").alias("gain"))
    staged = p.where("p_size between 11 and 40")
    confirmed = p.where("p_partkey % 5 = 0").select("hypothesis_id")
    return evidence.promote(evidence.stage(store, fresh, "entry_id"), staged, confirmed, 40).select("entry_id", F.col("successes").cast("long").alias("successes"), "gain")


_PROMOTION = "WITH p AS (SELECT p_type || '/' || p_size % 20 AS id, p_brand AS h, round(p_retailprice, 2) AS g, p_partkey, p_size FROM part), s AS (SELECT id, count(*) AS c, max(g) AS g FROM p WHERE p_size <= 10 GROUP BY 1), f AS (SELECT id, 0 AS c, min(g) AS g FROM p WHERE p_size > 40 AND id NOT IN (SELECT id FROM s) GROUP BY 1), n AS (SELECT id, 1 AS c, g FROM p WHERE p_size BETWEEN 11 AND 40 AND h IN (SELECT h FROM p WHERE p_partkey % 5 = 0)), a AS (SELECT * FROM s UNION ALL SELECT * FROM f UNION ALL SELECT * FROM n) SELECT id AS entry_id, CAST(sum(c) AS BIGINT) AS successes, max(g) AS gain FROM a GROUP BY id ORDER BY 2 DESC, 3 DESC, 1 LIMIT 40"

PAIRS = [("x0", "x0 + 0*x1"), ("x0", "2*x0"), ("x0", "x0 + 0.05*x1"), ("x0*x1", "x0"), ("x0**2", "x0"), ("x1", "1 - x1"), ("x0", "x1")]
_PAIRS_SQL = ["a", "2*a", "a + 0.05*b", "a", "a", "1 - b", "b"]
_FIRST_SQL = ["a", "a", "a", "a*b", "a*a", "b", "a"]


def term_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of terms over line items: absolute correlation, error of the best scaling, and which terms of two models are matched with each other."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    xs = [F.col("a"), F.col("b")]
    got = refine.similarity(d, PAIRS, xs)
    matched = refine.semantic_matches(d, ["x0", "x0*x1", "x1"], ["x1*x0", "3*x1", "x0**2"], xs)
    rows = [(a, b, s.corr, s.nrmse) for (a, b), s in zip(PAIRS, got, strict=True)] + [(f"matched {i}", str(j), 1.0, 0.0) for i, j in matched]
    return spark.createDataFrame(rows, "a string, b string, corr double, nrmse double").select("a", "b", F.round("corr", 6).alias("corr"), F.round("nrmse", 5).alias("nrmse"))


_SIMILARITY = "WITH d AS (SELECT l_quantity/50 AS a, l_discount*10 AS b FROM lineitem) " + " UNION ALL ".join(f"SELECT '{p[0]}' AS a, '{p[1]}' AS b, round(abs(corr({f}, {q})), 6) AS corr, round(sqrt(greatest(0, 1 - power(avg(({f})*({q})), 2)/(avg(({f})*({f}))*avg(({q})*({q}))))), 5) AS nrmse FROM d" for p, f, q in zip(PAIRS, _FIRST_SQL, _PAIRS_SQL, strict=True)) + " UNION ALL VALUES ('matched 1', '0', 1.0::DOUBLE, 0.0::DOUBLE), ('matched 2', '1', 1.0::DOUBLE, 0.0::DOUBLE)"


def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search objective of a guess by flag, under every profile: squared error and a capped tail over that of the mean."""
    y, p = F.col("y"), F.col("p")
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 50000).alias("y"), (F.col("l_quantity") / 35).alias("p"))
    means = d.groupBy("l_returnflag").agg(F.avg("y").alias("m"))
    own = metrics.tail_block(d, y, p, ["l_returnflag"], 1e-12).select("l_returnflag", "nmse", "p99")
    flat = metrics.tail_block(d.join(F.broadcast(means), "l_returnflag"), y, F.col("m"), ["l_returnflag"], 1e-12).select("l_returnflag", F.col("p99").alias("flat"))
    out = own.join(flat, "l_returnflag")
    kinds = ("balanced", "nmse", "tail", "low_complexity", "novelty")
    return out.select("l_returnflag", *[F.round(metrics.objective(F.col("nmse"), F.col("p99"), F.col("flat"), k, 0.08), 6).alias(k) for k in kinds])


_OBJECTIVES = "WITH d AS (SELECT l_returnflag, l_extendedprice/50000 AS y, l_quantity/35 AS p, avg(l_extendedprice/50000) OVER (PARTITION BY l_returnflag) AS m FROM lineitem), a AS (SELECT l_returnflag, avg((y - p)*(y - p))/greatest(var_pop(y), 1e-12) AS e, quantile_cont(abs(y - p)/greatest(abs(y), 1e-12), 0.99) AS q, quantile_cont(abs(y - m)/greatest(abs(y), 1e-12), 0.99) AS f FROM d GROUP BY 1), b AS (SELECT l_returnflag, e, 0.08*least(100, q/greatest(1, f)) AS t FROM a) SELECT l_returnflag, round(e + t, 6) AS balanced, round(e + 0.25*t, 6) AS nmse, round(e + 3*t, 6) AS tail, round(e + 0.5*t, 6) AS low_complexity, round(e + t, 6) AS novelty FROM b"


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of orders by their keys: of all columns, of what may be seen, and of a table with one value changed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 5, F.lit("?")).otherwise(F.col("o_orderstatus")))
    whole, other = (roles.fingerprint(d, "o_orderkey", ["o_custkey", "o_orderstatus"]) for d in (o, changed))
    seen, same = (roles.covariate_fingerprint(d, "o_orderkey", ["o_custkey"]) for d in (o, changed))
    return spark.createDataFrame([("whole", whole, whole == other), ("seen", seen, seen == same)], "kind string, fingerprint string, same_after_change boolean")


_FINGERPRINT = "WITH r AS (SELECT o_orderkey, sha256(o_custkey || chr(31) || o_orderstatus) AS w, sha256(o_custkey::VARCHAR) AS s FROM orders), b AS (SELECT o_orderkey // 4096 AS b, sha256(string_agg(w, '' ORDER BY o_orderkey, w)) AS w, sha256(string_agg(s, '' ORDER BY o_orderkey, s)) AS s, count(*) AS n FROM r GROUP BY 1), t AS (SELECT sum(n) AS n, string_agg(w, '' ORDER BY b) AS w, string_agg(s, '' ORDER BY b) AS s FROM b) SELECT 'whole' AS kind, sha256(n || '|o_custkey,o_orderstatus|' || w) AS fingerprint, false AS same_after_change FROM t UNION ALL SELECT 'seen', sha256(n || '|o_custkey|' || s), true FROM t"

QUERIES = {
    "promotion": (promotion, _PROMOTION), "term_similarity": (term_similarity, _SIMILARITY), "objectives": (objectives, _OBJECTIVES), "table_fingerprint": (table_fingerprint, _FINGERPRINT),
    "expression_facts": (expression_facts, _FACTS), "grammar_ranks": (grammar_ranks, _RANKS), "source_round_trips": (source_round_trips, _TRIPS),
    "paired_budgets": (paired_budgets, _PAIRED), "floored_dominance": (floored_dominance, _FLOORED),
    "workbook_scan": (workbook_scan, _WORKBOOKS), "event_tables": (event_tables, _EVENT_TABLES), "class_update_utility": (class_update_utility, _CLASS_UTILITY), "least_favourable": (least_favourable, _LEAST),
    "engine_summary": (engine_summary, _ENGINES), "top_distinct": (top_distinct, _TOP), "edit_labels": (edit_labels, _EDITS), "complete_transition": (complete_transition, _COMPLETE), "target_scales": (target_scales, _SCALES), "binned_classes": (binned_classes, _BINNED),
}
