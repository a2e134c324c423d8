"""Refinement of expressions and the open-grammar populations against exact answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import grammar, openmc, refine
from quillon.operators.gram import Prior


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(-2, 2, 200), rng.uniform(-2, 2, 200)
    return spark.createDataFrame([(float(p), float(q), float(2 * p - 0.5 * p * q + math.sin(1.5 * q))) for p, q in zip(a, b, strict=True)], "a double, b double, y double")


@pytest.fixture
def xs(spark):
    return [F.col("a"), F.col("b")]


def test_amplitudes_constants_and_pruning(frame, xs):
    text, error = refine.fit_amplitudes(frame, "x0 + x0*x1 + sin(1.5*x1)", xs, F.col("y"))
    assert error < 1e-9
    text, error = refine.refit_constants(frame, "2.0*x0 - 0.5*x0*x1 + sin(1.2*x1)", xs, F.col("y"))
    assert error < 0.01
    text, error, dropped = refine.prune(frame, "x0 + x0*x1 + sin(1.5*x1) + x1**2", xs, F.col("y"))
    assert dropped == ["x1 ** 2"] and error < 1e-6
    effects = refine.ablation(frame, "x0 + x0*x1 + sin(1.5*x1) + x1**2", xs, F.col("y"))
    assert [e["measurable"] for e in effects] == [True, True, True, False]


def test_matching_and_domains(frame, xs):
    assert sorted(refine.semantic_matches(frame, ["x0", "x1*x0"], ["3*x0*x1", "2*x0 + 0.001*x1"], xs)) == [(0, 1), (1, 0)]
    m = refine.domain_metrics(frame, frame, "2*x0 - 0.5*x0*x1 + sin(1.5*x1)", xs, F.col("y"))
    assert m["val_nmse"] < 1e-9 and m["stress_nmse"] < 1e-9 and m["ood_nmse"] < 1e-9
    assert refine.domain_metrics(frame, frame, "log(x0)", xs, F.col("y"))["val_nmse"] == math.inf
    assert refine.summands("x0 - (x1 - 2)", 2) == ["x0", "-(x1)", "2"]


@pytest.mark.parametrize("kind", ["plain", "waste_free", "full"])
def test_open_populations(kind):
    g = grammar.Grammar(1, 0.4)
    x = np.linspace(-1, 1, 6)[:, None]
    y = 0.3 + 1.5 * x[:, 0]
    got = openmc.run(g, x, y, Prior(scale=0.5), 200, 3, kind)
    want = openmc.exact(g, x, y, Prior(scale=0.5), 6)
    tv = 0.5 * sum(abs(got["classes"].get(k, 0) - p) for k, p in want["classes"].items())
    assert tv < 0.35 and 0 < got["acceptance"] < 1 and got["roots"] <= 200
    assert abs(got["log_evidence"] - want["log_evidence"]) < 1.0
