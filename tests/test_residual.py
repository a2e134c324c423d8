"""The residual grammar against planted laws and array fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import residual


def table(spark, law, n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 2))
    rows = [(k, *map(float, x[k]), float(law(*x[k]))) for k in range(n)]
    return x, spark.createDataFrame(rows, "id long, a double, b double, y double")


def cols():
    return [F.col("a"), F.col("b")], F.col("y")


def test_interaction_of_depth_one(spark):
    """A product with the prediction is found, its coefficient too, and the structure is said to miss an interaction."""
    _, df = table(spark, lambda a, b: a + 0.7 * a * b)
    r = residual.program(df, "x0", *cols())
    assert r["steps"][0]["expression"] in ("(y_hat)*(x1)", "(x1)*(y_hat)") and len(r["steps"]) == 1
    by = {t["expression"]: t["coefficient"] for t in r["terms"]}
    assert by["y_hat"] == pytest.approx(1.0, abs=1e-6) and by[r["steps"][0]["expression"]] == pytest.approx(0.7, abs=1e-6)
    assert r["nmse"] < 1e-12 < r["identity_nmse"] and r["interaction"] and not r["nonlinear"]
    assert r["actions"] == ["CHANGE_INTERACTION", "ADD"] or r["actions"][0] == "REPARAMETERIZE"
    f = residual.failures(df, "id", "x0", *cols(), r).first()
    assert "missing_prediction_input_interaction" in f.tags and "nmse_underfit" in f.tags


def test_depth_two(spark):
    """sin of a product needs two steps of growth."""
    _, df = table(spark, lambda a, b: b + 2 * np.sin(a * b))
    deep = residual.program(df, "x1", *cols(), settings=residual.Settings(tail_weight=0.0))
    flat = residual.program(df, "x1", *cols(), settings=residual.Settings(tail_weight=0.0, depth=1))
    assert any("sin" in s["expression"] and "*" in s["expression"] for s in deep["steps"]) and deep["nmse"] < 1e-9 < flat["nmse"]
    assert [t["depth"] for t in deep["trace"]] == [0, 1, 2] and deep["generated"] <= 128


@pytest.mark.parametrize("text,law", [("cube", lambda a, b: a + 0.3 * b**3), ("signed_log", lambda a, b: a + np.sign(b) * np.log1p(abs(b))), ("saturate", lambda a, b: a + b / (1 + abs(b)))])
def test_unary_terms(spark, text, law):
    _, df = table(spark, law)
    r = residual.program(df, "x0", *cols(), settings=residual.Settings(tail_weight=0.0, depth=1))
    assert r["terms"][1]["operator"] == text and r["nmse"] < 1e-9


def test_intermediates_and_duplicates(spark):
    """Parts of the model are symbols; what equals another term on the probe rows isn't one; what isn't finite or doesn't vary neither."""
    _, df = table(spark, lambda a, b: a * a + 3 * np.sin(b))
    b = residual.Builder(df, "x0**2 + sin(x1)", *cols(), residual.Settings(), "balanced")
    assert b.shown[:3] == ["y_hat", "x0", "x1"] and "(sin(x1))" in b.shown
    n = len(b.terms)
    k = b.shown.index("x0")
    trees = [("multiply", k, 1), ("multiply", 1, k), ("square", ("square", k)), ("safe_ratio", k, k), ("saturate", k), ("tanh", k)]
    more = b.admitted([residual.Term(t, "f", 1) for t in trees])
    assert [t.tree for t in more] == [("square", ("square", k)), ("safe_ratio", k, k), ("tanh", k)]
    grown = k
    for _ in range(7):
        grown = ("cube", ("cube", grown))
    assert b.admitted([residual.Term(grown, "f", 1), residual.Term(k, "f", 1)]) == [] and len(b.terms) == n
    r = residual.program(df, "x0**2 + sin(x1)", *cols(), settings=residual.Settings(tail_weight=0.0))
    assert "(sin(x1))" in r["steps"][0]["expression"] and "DELETE" in r["actions"] and r["nmse"] < 1e-9


def test_copies_and_rare_values(spark):
    """Many copies of few rows don't fill the probe, and what differs on rare rows only isn't taken for the same."""
    grid = spark.range(400 * 120).select((F.col("id") % 20 / 20).alias("a"), (F.floor(F.col("id") / 20) % 20 / 20).alias("b"))
    few = grid.withColumn("y", F.col("a") + 0.7 * F.col("a") * F.col("b"))
    b = residual.Builder(few, "x0", *cols(), residual.Settings(), "balanced")
    assert [t.tree for t in b.terms] == [0, 2] and len(np.unique(b.probe, axis=0)) == len(b.probe) == residual.PROBE
    r = residual.program(few, "x0", *cols(), settings=residual.Settings(beam=4, depth=1, chosen=2))
    assert [s["expression"] for s in r["steps"]] == ["(y_hat)*(x1)"] and r["terms"][1]["coefficient"] == pytest.approx(0.7, abs=1e-6) and r["nmse"] < 1e-12
    rare = spark.range(20000).select("id", (F.col("id") % 997 / 997).alias("a"), (F.col("id") == 77).cast("double").alias("b"), (F.col("id") == 4242).cast("double").alias("c"))
    rare = rare.select("*", (F.col("a") + F.col("c")).alias("e"), (2 * F.col("b") - 1).alias("f"), F.lit(3.0).alias("g"), (F.col("a") + 5 * F.col("c")).alias("y"))
    b = residual.Builder(rare, "x0", [F.col(c) for c in "agbcef"], F.col("y"), residual.Settings(), "balanced")
    assert [b.shown[t.tree] for t in b.terms] == ["y_hat", "x2", "x3", "x4"]
    assert len(residual.Builder(rare, "x0", [F.col(c) for c in "agbcef"], F.col("y"), residual.Settings(most_terms=3), "balanced").terms) == 3


def test_fits_equal_arrays(spark):
    """Fold-wise fits from matrices against fits of arrays; wide values are clipped at twenty times their .999 quantile."""
    x, df = table(spark, lambda a, b: a + 0.5 * b * b + 0.1 * np.cos(9 * a))
    b = residual.Builder(df, "x0", *cols(), residual.Settings(), "balanced")
    t = [b.terms[0], *b.admitted([residual.Term(("multiply", 2, 2), "interaction", 1)])]
    by = b.grams(t)
    got, fits = residual.cross_validated(by, [1, 2], 3, 1e-8)
    rows = b.rows.select("fold", "b0", "b2", "y").collect()
    fold, a, c, y = (np.array([r[k] for r in rows]) for k in ("fold", "b0", "b2", "y"))
    want = []
    for f in sorted(by):
        m = np.column_stack((np.ones(len(a)), a, c * c))
        beta = np.linalg.lstsq(m[fold != f], y[fold != f], rcond=None)[0]
        want.append(np.mean((y[fold == f] - m[fold == f] @ beta) ** 2) / np.var(y[fold == f]))
    assert got == pytest.approx(np.mean(want), rel=1e-6)
    huge = spark.createDataFrame([(k, float(k % 50), 1.0 if k else 1e12, float(k % 50)) for k in range(2000)], "id long, a double, b double, y double")
    term = residual.Builder(huge, "x0", *cols(), residual.Settings(), "balanced").terms[-1]
    q = np.quantile(np.array([1e12] + [1.0] * 1999), 0.999)
    assert term.high == pytest.approx(max(1e5, 20 * q))
    with pytest.raises(ValueError):
        residual.program(df, "1.5", *cols())


def test_actions():
    row = {"expression": "sin(y_hat)", "family": "nonlinear_transform"}
    assert residual.suggested([row], 0.1, 0.0, ["x0"]) == ["REPLACE", "CHANGE_OPERATOR"]
    assert residual.suggested([], 1.0, 0.0, ["x0"]) == ["REPARAMETERIZE"]
    assert residual.suggested([{"expression": "x0", "family": "raw_variable"}], 1.0, 0.0, ["x0"]) == ["ADD"]
    assert residual.suggested([{"expression": "(x1)*(x0)", "family": "interaction"}], 1.0, 0.0, ["x0"]) == ["ADD"]


def test_tails_and_screens(spark):
    """Quantiles of relative errors by fold within a thousandth; screens over several partitions."""
    rng = np.random.default_rng(4)
    z, y, fold = rng.normal(size=(900, 2)), rng.normal(3, 1, 900), np.arange(900) % 3
    df = spark.createDataFrame([(int(f), float(v), *map(float, r)) for f, v, r in zip(fold, y, z, strict=True)], "fold int, y double, z0 double, z1 double").repartition(5)
    by = residual.wide_grams(df, [F.col("z0"), F.col("z1"), F.col("y")], "fold")
    fits = [residual.cross_validated(by, c, 3, 1e-8)[1] for c in ([1], [1, 2])]
    got = residual.tails(df, 2, [[0], [0, 1]], fits, by)

    def p99(p, at):
        return np.quantile(np.abs(p - y[at]) / np.abs(y[at]), 0.99, method="lower")

    for k, c in enumerate(([0], [0, 1])):
        want = []
        for f in range(3):
            at = fold == f
            want.append(p99(fits[k][f][0] + z[at][:, c] @ fits[k][f][1:], at) / max(1.0, p99(np.full(at.sum(), y[at].mean()), at)))
        assert got[k] == pytest.approx(np.mean(want), rel=2e-3)
    s = residual.screened(df, [F.col("z0"), F.log(F.col("z1")), F.lit(2.0), F.when(F.col("y") > 3, F.col("y"))])
    assert s[0].ok and s[0].mean == pytest.approx(z[:, 0].mean()) and s[0].sd == pytest.approx(z[:, 0].std()) and s[0].largest == pytest.approx(np.abs(z[:, 0]).max())
    assert [x.ok for x in s] == [True, False, True, False] and s[2].sd == 0
    assert not residual.screened(df.limit(0), [F.col("y")])[0].ok
