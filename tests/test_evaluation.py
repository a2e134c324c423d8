"""Metric vectors and failure summaries against doing it with arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import discovery, evaluation


def block(y, p, floor):
    rel = np.abs(p - y) / np.maximum(np.abs(y), floor)
    return {"nmse": np.mean((p - y) ** 2) / max(np.var(y), 1e-15), "strict": rel.max(), "p99": np.quantile(rel, 0.99), "p995": np.quantile(rel, 0.995), "share": np.mean(rel <= 0.1)}


def frames(spark, n, seed=0, levels=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) if levels is None else rng.integers(0, levels, (n, 2)).astype(float)
    y = 1 + x[:, 0] - 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.1, n)
    rows = [(k, *map(float, x[k]), float(y[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    held = F.col("id") % 3 == 0
    return x, y, df.where(~held), df.where(held)


def vectors(train, valid, texts, **config):
    d = evaluation.prepare(train, valid, [F.col("a"), F.col("b")], F.col("y"), F.col("id"), evaluation.Config(**config))
    return d, evaluation.metric_vectors(d, texts)


@pytest.mark.parametrize("n,levels", [(240, None), (240, 3), (3600, None)])
def test_metric_vectors(spark, n, levels):
    x, y, train, valid = frames(spark, n, n, levels)
    d, got = vectors(train, valid, ["1 + x0", "x0*x1", "1/(x0 - x0)", "sqrt(x0)"], floor_ratio=0.1)
    held = np.arange(n) % 3 == 0
    low, high, mid = (np.quantile(x[~held], q, axis=0) for q in (0.05, 0.95, 0.5))
    extreme = held & np.any((x < low) | (x > high), axis=1)
    if extreme.sum() < max(4, int(0.05 * held.sum())):
        assert levels is not None
        far = np.max(np.abs((x - mid) / np.maximum(high - low, 1e-12)), axis=1)
        order = sorted(np.flatnonzero(held), key=lambda k: (far[k], k))
        outside = np.array(order[-max(4, math.ceil(0.2 * held.sum())) :])
    else:
        assert levels is None
        outside = np.flatnonzero(extreme)
    assert {r["_id"] for r in d.rows.where("array_contains(_domains, 'ood')").collect()} == set(outside.tolist())
    by_size = np.array_split(np.argsort(np.abs(y)), 3)
    folds = [np.array([r["_id"] for r in d.rows.where(f"array_contains(_domains, 'r{k}')").collect()]) for k in range(3)]
    assert sorted(map(len, folds)) == [len(p) for p in np.array_split(np.arange(n), 3)][::-1] and len(np.unique(np.concatenate(folds))) == n
    for m, p in zip(got, (1 + x[:, 0], x[:, 0] * x[:, 1]), strict=False):
        def of(at, p=p):
            return block(y[at], p[at], max(1e-12, 0.1 * max(np.quantile(np.abs(y[at]), 0.95), np.std(y[at]), 1e-12)))

        val, stress, ood = of(held), [of(f) for f in (*by_size, *folds)], of(outside)
        want = {"train_nmse": of(~held)["nmse"], **{f"val_{k}": v for k, v in val.items()}, "stress_nmse": max(s["nmse"] for s in stress), "stress_strict": max(s["strict"] for s in stress), "stress_p99": max(s["p99"] for s in stress), "ood_nmse": ood["nmse"], "ood_strict": ood["strict"], "invalid": 0.0}
        for k, v in want.items():
            assert m[k] == pytest.approx(v, rel=1e-9), k
    assert got[2]["invalid"] == 1 and got[2]["val_nmse"] == math.inf and got[2]["val_share"] == 0.0
    assert levels is None and got[3]["invalid"] == 1 or levels is not None


def test_tails_differ_by_domain(spark):
    """An expression that fails on large targets alone has a worse stress tail than validation tail."""
    _, _, train, valid = frames(spark, 600, 5)
    _, (m,) = vectors(train, valid.where("abs(y) < 1"), ["1 + x0"])
    assert m["stress_nmse"] > m["val_nmse"] and m["stress_strict"] >= m["val_strict"] and m["ood_nmse"] != m["val_nmse"]


def test_few_rows(spark):
    """Under four rows the stress domain is all rows; both tables are needed."""
    _, _, train, valid = frames(spark, 3)
    _, (m,) = vectors(train, valid, ["x0"])
    assert math.isfinite(m["stress_nmse"]) and math.isfinite(m["ood_nmse"])
    with pytest.raises(ValueError):
        vectors(train, valid.limit(0), ["x0"])
    assert evaluation.metric_vectors(evaluation.prepare(train, valid, [F.col("a")], F.col("y")), []) == []


def test_penalty():
    flat, steep = np.ones(200), np.linspace(0, 1, 200)
    assert evaluation.penalty(flat, flat, 1.0, 1.0) == 0.0
    assert evaluation.penalty(100 * flat, 100 * flat, 1.0, 1.0) == pytest.approx(math.log1p(100) - math.log(3))
    assert evaluation.penalty(flat, flat + 100 * steep, 1.0, 1.0) == pytest.approx(math.log1p(np.quantile(100 * steep, 0.99) / 1e-4) - math.log(1e5))
    assert evaluation.penalty(flat, np.append(flat[1:], np.nan), 1.0, 1.0) == math.inf


@pytest.mark.parametrize("n,parts", [(10, 3), (9, 3), (4, 4), (23, 5)])
def test_split(spark, n, parts):
    got = [r.p for r in spark.range(n).select(evaluation.split(F.col("id"), n, parts).alias("p"), "id").orderBy("id").collect()]
    assert got == [k for k, a in enumerate(np.array_split(np.arange(n), parts)) for _ in a]


def test_evaluated_states(spark):
    """Several expressions from one pass, what can't be read among them."""
    _, _, train, valid = frames(spark, 120)
    xs = [F.col("a"), F.col("b")]
    states = discovery.evaluated(evaluation.prepare(train, valid, xs, F.col("y")), [("x0", "s"), ("broken(", "s"), ("x0", "again"), ("1 + x0 - 0.5*x1**2", "law")])
    assert states[1] is None and states[0].digest == states[2].digest and states[3].metrics["val_nmse"] < 0.1 < states[0].metrics["val_nmse"]
    assert set(states[0].metrics) == set(discovery.METRICS) and states[0].metrics["stress_p99"] != states[0].metrics["val_p99"]


def test_failures(spark):
    """Tags, the worst slice with ties, features that the residual follows; rows that aren't numbers are left out."""
    rows = [("a", k, float(k % 7), 10.0 + k, 10.0 + k - (3.0 if k % 10 == 0 else 0.0)) for k in range(60)] + [("b", 100, 1.0, 2.0, 2.0), ("b", 101, None, 2.5, 2.5), ("b", 102, 1.0, None, 2.0), ("b", 103, 1.0, 2.0, math.nan)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, p double")
    got = {r.g: r for r in evaluation.failure_summary(df, ["g"], "id", F.col("y"), F.col("p"), {"x": F.col("x"), "y": F.col("y")}, interaction=F.col("id") == 100).collect()}
    a, b = got["a"], got["b"]
    assert (a.n, a.n_worst, b.n, b.n_worst) == (60, 4, 2, 2)
    assert (a.worst_y_low, a.worst_y_high) == (30.0, 60.0)  # of six equal errors those of the larger ids
    assert a.tags == ["tail_failure"] and b.tags == ["missing_prediction_input_interaction"]
    assert a.mean_scaled == pytest.approx(0.3 / np.quantile(np.arange(10.0, 70.0), 0.95)) and len(a.follows) == 2
    assert b.nmse == 0.0 and [f.correlation for f in b.follows] == [0.0, 0.0]
