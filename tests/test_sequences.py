"""Prequential scores, recomposed ancestries and matchings by turns against doing it row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import special
from quillon.operators import distance, gram, prequential, sequential
from quillon.operators.gram import Prior, generic_bank


def refitted(rows, bank, prior):
    """Every row by a fit of the rows before it: (id, n, transform, log score) of those not initial; rows in order."""
    names = tuple(dict.fromkeys(t for b in bank for t in b.terms))
    first = [r for r in rows if r[3]]
    out, seen = [], list(first)
    for r in (r for r in rows if not r[3]):
        x = np.array([q[1] for q in seen]).reshape(len(seen), -1)
        y = np.array([q[2] for q in seen])
        z = gram.design_rows(x, names) if seen else np.zeros((0, len(names)))
        posts = gram.bank_posterior(bank, gram.Stats(names, float(len(seen)), z.T @ z, z.T @ y, float(y @ y)), prior)
        at, yy = np.array([r[1]]), np.array([r[2]])
        out.append((r[0], len(seen), float(gram.mixture_cdf(posts, at, yy)[0]), float(gram.mixture_logpdf(posts, at, yy)[0])))
        seen.append(r)
    return out


def frame(spark, rows):
    """(key, id, t, x0, x1, y, initial)."""
    return spark.createDataFrame(rows, "key string, id long, t double, x0 double, x1 double, y double, initial boolean")


def scored(df, keys, block_rows):
    terms = {t: gram.term(t, [F.col("x0"), F.col("x1")]) for b in generic_bank(2) for t in b.terms}
    return prequential.predictive_pits(df, F.col("t"), "id", terms, F.col("y"), generic_bank(2), Prior(), F.col("initial"), keys, block_rows=block_rows)


@pytest.mark.parametrize("block_rows", [7, 65_536])
def test_prequential_equals_refitting(spark, block_rows):
    """A hot key over many blocks, small keys, a null key, tied and null places, rows that count for nothing."""
    rng = random.Random(9)
    rows = []
    for k in range(140):
        key = "hot" if k % 3 else rng.choice(["a", "b", None])
        x = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((key, k, None if k == 70 else rng.choice([rng.random(), 0.5]), *x, 0.4 - x[0] + x[1] * x[1] + rng.gauss(0, 0.3), k % 11 == 0))
    odd = [("hot", 900, 0.2, None, 0.1, 0.3, False), ("hot", 901, 0.2, 0.1, 0.1, float("nan"), False), ("a", 902, 0.1, float("inf"), 0.1, 0.2, True)]
    got = {r.id: r for r in scored(frame(spark, rows + odd), ["key"], block_rows).collect()}
    for key in ("hot", "a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-math.inf if r[2] is None else r[2], r[1]))
        want = refitted([(r[1], r[3:5], r[5], r[6]) for r in mine], generic_bank(2), Prior())
        for i, n, pit, score in want:
            r = got.pop(i)
            assert r.key == key and r.n_before == n
            assert r.pit == pytest.approx(pit, abs=1e-9) and r.log_score == pytest.approx(score, abs=1e-8)
    assert not got


def test_prequential_does_not_look_ahead(spark):
    """Rows of a prefix have the same scores whatever follows."""
    base = [(None, k, float(k), 0.1 * k, 0.0, 0.3 + 0.02 * k, True) for k in range(6)]
    later = [(None, 10 + k, 10.0 + k, 0.1 * k, 0.0, -0.1 + 0.04 * k, False) for k in range(8)]
    other = [(*r[:5], 99.0, False) for r in later[4:]]
    one, two = ({r.id: (r.pit, r.log_score) for r in scored(frame(spark, base + x), [], 3).collect()} for x in (later, later[:4] + other))
    assert len(one) == 8 and all(one[k] == two[k] for k in range(10, 14)) and one[15] != two[15]
    assert scored(frame(spark, []), [], 3).collect() == []


def test_student_cdf_arrays():
    rng = np.random.default_rng(1)
    z, df = np.concatenate((rng.normal(0, 3, 300), [0.0, 1e-9, -1e-9, 50.0, -50.0, 1e150])), np.concatenate((rng.uniform(0.5, 400, 300), [1.0, 3.0, 3.0, 5.0, 900.0, 2.0]))
    assert np.allclose(special.t_cdf_array(z, df), special.t_cdf(z, df), rtol=1e-8, atol=1e-300)  # the scalar one loses digits near 0
    # Closed forms for 1 and 2 degrees of freedom.
    assert np.allclose(special.t_cdf_array(z[:50], np.ones(50)), 0.5 + np.arctan(z[:50]) / np.pi, atol=1e-14)
    assert np.allclose(special.t_cdf_array(z[:50], np.full(50, 2.0)), 0.5 + z[:50] / (2 * np.sqrt(2 + z[:50] ** 2)), atol=1e-14)


@pytest.mark.parametrize("steps", [1, 2, 7, 16, 33])
def test_recomposed_roots(spark, steps):
    """Pointer doubling against following the maps one step at a time, with a hot parent and broken lines."""
    rng = random.Random(steps)
    maps, before = [], {k: k for k in range(20)}
    for s in range(5, 5 + steps):
        now = {}
        for c in range(20):
            p = 3 if rng.random() < 0.3 else rng.randrange(20)
            if s == 7 and c == 4:
                p = 999
            maps.append((s, c, p, before.get(p)))
            now[c] = before.get(p)
        before = now
    df = spark.createDataFrame(maps, "step int, child long, parent long, root long")
    got = sorted(map(tuple, sequential.recomposed(df, "step", "child", "parent").collect()), key=str)
    want = sorted(((s, c, r) for s, c, _, r in maps), key=str)
    # A parent of the first step is a root whether it is known or not.
    assert got == want
    check = {r["step"]: r for r in sequential.genealogy_check(df, "step", "child", "parent", "root").collect()}
    assert all(check[s].n == 20 and check[s].n_wrong == 0 for s in check)
    assert sum(r.n_broken for r in check.values()) == sum(r is None for *_, r in maps)
    wrong = df.withColumn("root", F.when(F.col("child") == 6, -5).otherwise(F.col("root")))
    assert all(r.n_wrong == 1 for r in sequential.genealogy_check(wrong, "step", "child", "parent", "root").collect())


def test_recomposed_of_nothing(spark):
    assert sequential.recomposed(spark.createDataFrame([], "step int, child long, parent long"), "step", "child", "parent").collect() == []


@pytest.mark.parametrize("page,block", [(1, 1000), (2, 9), (16, 1000)])
def test_matching_by_turns(spark, page, block):
    """Points on a small grid, so that nearly all queries want the same few rows and ties are everywhere."""
    rng = np.random.default_rng(page)
    v = rng.integers(0, 4, (60, 2)).astype(float)
    rows = [(k, v[k].tolist(), None) for k in range(60)] + [(100, None, None), (101, [1.0, None], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, extra int")
    pool, queries = df.where("id >= 25"), df.where("id < 25")
    got = {r.query_id: (r.pool_id, r.distance) for r in distance.matched(pool, queries, "id", "v", page=page, block=block).collect()}
    want = distance.greedy_nearest(v[25:], v[:25])
    assert got == {q: (25 + p, float(np.sqrt(((v[25 + p] - v[q]) ** 2).sum()))) for q, p in enumerate(want)}


def test_matching_beyond_the_pool(spark):
    """Queries that come too late get no row; a query is not its own row; turns may differ from ids."""
    df = spark.createDataFrame([(k, [float(k)], -k) for k in range(6)], "id long, v array<double>, turn long")
    got = sorted((r.query_id, r.pool_id) for r in distance.matched(df.where("id in (0, 1)"), df, "id", "v", "turn", page=1).collect())
    assert got == [(4, 0), (5, 1)]
    got = sorted((r.query_id, r.pool_id) for r in distance.matched(df, df.where("id in (2, 3)"), "id", "v").collect())
    assert got == [(2, 1), (3, 2)]
    assert distance.matched(df.limit(0), df, "id", "v").collect() == []


def test_power_losses_equal_refitting(spark):
    """Mean losses of the scan against the kernel over explicit prefixes."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 2))
    y = x[:, 0] + 0.2 * rng.normal(size=30)
    bank, powers = generic_bank(2), (0.3, 1.0)
    names = tuple(dict.fromkeys(t for b in bank for t in b.terms))
    z = gram.design_rows(x, names)
    prefixes = [gram.Stats(names, float(t), z[:t].T @ z[:t], z[:t].T @ y[:t], float(y[:t] @ y[:t])) for t in range(30)]
    want = gram.calibrated_power(bank, prefixes, list(x), list(y), Prior(), powers)
    df = spark.createDataFrame([(k, float(k), *map(float, x[k]), float(y[k])) for k in range(30)], "id long, t double, x0 double, x1 double, y double")
    terms = {t: gram.term(t, [F.col("x0"), F.col("x1")]) for t in names}
    got = prequential.power_losses(df, F.col("t"), "id", terms, F.col("y"), bank, Prior(), powers, block_rows=8).agg(F.avg("loss_0"), F.avg("loss_1")).first()
    assert list(got) == pytest.approx([want[e] for e in powers], abs=1e-9)


def test_evidence_by_quadrature():
    """The closed form of the evidence against integrating the noise numerically."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(25, 2))
    y = 0.5 * x[:, 0] + 0.3 * rng.normal(size=25)
    for prior in (Prior(), Prior(0.3, 2.0, 1.5, 0.4)):
        for b in generic_bank(2):
            z = gram.design_rows(x, b.terms)
            s = gram.Stats(b.terms, 25.0, z.T @ z, z.T @ y, float(y @ y))
            assert gram.quadrature_log_evidence(b, s, prior) == pytest.approx(gram.conjugate(b, s, prior).log_evidence, abs=1e-8)
