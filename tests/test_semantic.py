"""Semantic certificates against listing every expression."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import certify, discrepancy, grammar, semantic
from quillon.operators.gram import Prior, Stats, Structure, conjugate
from quillon.operators.grammar import Grammar

PRIOR = Prior(0.0, 0.7, 3.0, 0.08)


def responses(d, n=7, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1.4, 1.4, (n, d))
    return x, 0.15 + 0.7 * x[:, 0] + 0.2 * x[:, -1] ** 2 + rng.normal(0, 0.1, n)


def listed(g, most, evidence):
    """Log of the sum over all expressions up to a size of prior times evidence."""
    return np.logaddexp.reduce([math.log(g.prior(n)) + evidence(e) for n in range(1, most + 1) for e in g.expressions(n)])


@pytest.mark.parametrize("d,most", [(1, 6), (2, 4)])
def test_evidence_from_moments(spark, d, most):
    """Weighted rows: one aggregate and Columns against a fit for each expression."""
    x, y = responses(d)
    w = np.linspace(0.2, 1.0, len(y))
    df = spark.createDataFrame([(*map(float, r), float(v), float(p)) for r, v, p in zip(x, y, w, strict=True)], ", ".join(f"x{k} double" for k in range(d)) + ", y double, w double")
    g = Grammar(d, 0.4)
    m = semantic.moments(df, [F.col(f"x{k}") for k in range(d)], F.col("y"), most, F.col("w"))
    table = semantic.classes(spark, g, most).withColumn("log_marginal", semantic.log_marginal(F.col("terms"), m, PRIOR))
    got = {r["most"]: r for r in semantic.certificate(table, g, m.n, PRIOR, 1, most).collect()}

    def evidence(e):
        f = grammar.evaluate(e, x)
        return conjugate(Structure("f", ("f",), 1.0), Stats(("f",), float(w.sum()), np.array([[w @ (f * f)]]), np.array([w @ (f * y)]), float(w @ (y * y))), PRIOR).log_evidence

    bound = certify.uniform_log_bound(float(w.sum()), PRIOR)
    for n, r in got.items():
        core = listed(g, n, evidence)
        tail = n * math.log(0.4) + bound
        assert r.log_core == pytest.approx(core, abs=1e-10) and r.log_tail == pytest.approx(tail, abs=1e-12)
        assert r.tail_probability == pytest.approx(math.exp(tail - np.logaddexp(core, tail))) and r.inside and r.violation == 0
        assert r.mixing_steps == max(1, math.ceil(math.log(0.01) / math.log(r.tail_probability)))
    assert got[most].beyond == 0 and got[1].beyond > 0
    assert all(got[n].beyond <= got[n].tail_probability for n in got)
    share = {r.class_id: r.probability for r in semantic.class_posterior(table).collect()}
    assert sum(share.values()) == pytest.approx(1.0) and len(share) == table.select("class_id").distinct().count()


def test_evidence_with_discrepancies(spark):
    """Spike and two kernels, projected off each expression's function."""
    x, y = responses(1)
    g, most, kernels = Grammar(1, 0.4), 4, [semantic.Kernel("short", 0.5, 0.6), semantic.Kernel("long", 0.5, 1.3)]
    table = semantic.with_components(semantic.classes(spark, g, most), x, y, PRIOR, kernels, 0.3, 1.2)
    core = semantic.certificate(table, g, float(len(y)), PRIOR, most, most).first()

    def evidence(e):
        f = grammar.evaluate(e, x)[:, None]
        logs = [math.log(0.3) + semantic.grid_log_marginal(f, y, np.ones(len(y)), np.array([0.7]), PRIOR)]
        for k in kernels:
            b = discrepancy.projected_basis(x, f, 1.0, k.lengthscale2)
            logs.append(math.log(0.7 * k.share) + semantic.grid_log_marginal(np.column_stack((f, b)), y, np.ones(len(y)), np.array([0.7, *[1.2] * b.shape[1]]), PRIOR))
        return np.logaddexp.reduce(logs)

    assert core.log_core == pytest.approx(listed(g, most, evidence), abs=1e-10) and core.violation == 0
    plain = semantic.with_components(semantic.classes(spark, g, most), x, y, PRIOR, [], 1.0, 1.2)
    m = semantic.moments(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:, 0], y, strict=True)], "x double, y double"), [F.col("x")], F.col("y"), most)
    both = plain.withColumn("native", semantic.log_marginal(F.col("terms"), m, PRIOR)).collect()
    assert all(r.native == pytest.approx(r.log_marginal, abs=1e-9) for r in both)
    with pytest.raises(ValueError):
        semantic.with_components(table, x, y[:-1], PRIOR, kernels, 0.3, 1.2)
    with pytest.raises(ValueError):
        semantic.with_components(table, x, y, PRIOR, kernels[:1], 0.3, 1.2)


def test_nothing_observed(spark):
    """An empty table leaves the prior."""
    g = Grammar(1, 0.4)
    m = semantic.moments(spark.createDataFrame([], "x double, y double"), [F.col("x")], F.col("y"), 3)
    table = semantic.classes(spark, g, 3).withColumn("log_marginal", semantic.log_marginal(F.col("terms"), m, PRIOR))
    r = semantic.certificate(table, g, 0.0, PRIOR, 3, 3).first()
    assert m.n == 0 and r.tail_probability <= 0.4**3 + 1e-12


def test_joint_posterior(spark):
    """Classes and components together sum to one, and to the classes' own probabilities."""
    x, y = responses(1)
    g, kernels = Grammar(1, 0.4), [semantic.Kernel("short", 0.5, 0.6), semantic.Kernel("long", 0.5, 1.3)]
    table = semantic.classes(spark, g, 3)
    joint = semantic.class_posterior(semantic.with_components(table, x, y, PRIOR, kernels, 0.3, 1.2, joint=True)).collect()
    alone = {r.class_id: r.probability for r in semantic.class_posterior(semantic.with_components(table, x, y, PRIOR, kernels, 0.3, 1.2)).collect()}
    assert {r.component for r in joint} == {"none", "short", "long"} and sum(r.probability for r in joint) == pytest.approx(1.0)
    for k, p in alone.items():
        assert sum(r.probability for r in joint if r.class_id == k) == pytest.approx(p, abs=1e-12)
