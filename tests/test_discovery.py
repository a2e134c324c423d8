"""Discovery, gates, locked state, splits, closed bounds and certified choices."""

import json
import math
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import columns, expressions, special
from quillon.operators import acquisition, certify, discovery, discrepancy, evidence, gram, information, metrics, roles, search
from quillon.operators.gram import Prior
from quillon.sources import state


def test_locked_files(tmp_path):
    f = state.Lines(tmp_path / "a" / "rows.jsonl")
    threads = [threading.Thread(target=lambda k=k: [f.append({"k": k, "n": n}) for n in range(20)]) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(f.read()) == 80
    assert f.update(lambda rows: ([r for r in rows if r["k"]], len(rows))) == 80 and len(f.read()) == 60
    f.rewrite([{"x": 1}])
    assert f.read() == [{"x": 1}] and sorted(p.name for p in (tmp_path / "a").iterdir()) == ["rows.jsonl"]
    state.write_json(tmp_path / "d.json", {"b": 1})
    with pytest.raises(ValueError):
        state.write_json(tmp_path / "d.json", {"b": math.nan})
    assert json.loads((tmp_path / "d.json").read_text()) == {"b": 1}
    lock = tmp_path / "x.lock"
    lock.write_text("1")
    with pytest.raises(TimeoutError), state.file_lock(tmp_path / "x", timeout=0.1):
        pass
    os.utime(lock, (time.time() - 500, time.time() - 500))
    with state.file_lock(tmp_path / "x", timeout=0.1):
        assert lock.exists()
    assert not lock.exists()


def test_log_has_one_writer_at_a_time(tmp_path):
    threads = [threading.Thread(target=lambda: [evidence.Log(tmp_path / "log").append("h", "NOTE", {"n": n}) for n in range(5)]) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert evidence.Log(tmp_path / "log").verify() == {"valid": True, "events": 20}


def test_chain_shows_tampering(spark, monkeypatch):
    monkeypatch.setattr(evidence, "BLOCK", 10)
    log = evidence.chained(spark.range(35).select(F.col("id").alias("event_id"), F.lit("t").alias("event_type"), F.col("id").alias("user_id"), F.lit("{}").alias("props"))).cache()
    assert evidence.verify(log).first().valid
    hit = F.col("seq") == 12
    altered = log.withColumn("payload", F.when(hit, F.lit("x")).otherwise(F.col("payload")))
    assert evidence.verify(altered).first().wrong_hashes == 1
    again = altered.withColumn("event_hash", F.when(hit, evidence.content_hash(F.col("seq"), F.col("payload"), F.col("previous_hash"))).otherwise(F.col("event_hash")))
    r = evidence.verify(again).first()
    assert (r.wrong_hashes, r.valid) == (0, False) and r.broken_links >= 2  # the next event, and the blocks after
    assert not evidence.verify(log.where("seq <> 20")).first().valid
    twice = evidence.verify(log.unionAll(log.where("seq = 3"))).first()
    assert twice.duplicate_ids == 1 and not twice.valid
    assert evidence.verify(log.limit(0)).first().valid


def test_store_entries():
    row = {"entry_id": "a", "gain": 0.5, "expression": "x0 + x0"}
    got = evidence.validate_entry(row)
    assert got["canonical"] == "2*x0" and got["probe"][0] == -3.0 and len(got["probe"]) == 19
    for bad in ({**row, "entry_id": " "}, {**row, "gain": math.nan}, {**row, "gain": True}, {**row, "expression": "log(0 - 1 - x0**2)"}):
        with pytest.raises((ValueError, TypeError)):
            evidence.validate_entry(bad)


def test_exact_statistics(spark):
    # Fixed values of a printed table.
    want = {1: 12.706204736, 2: 4.302652730, 3: 3.182446305, 4: 2.776445105, 9: 2.262157163, 30: 2.042272456, 100: 1.983971519}
    got = spark.createDataFrame([(float(k),) for k in want], "k double").select("k", columns.t975(F.col("k")).alias("t")).collect()
    assert all(abs(r.t - want[int(r.k)]) < 1e-6 for r in got)
    assert metrics.signed_rank_tail(3) == [1.0, 7 / 8, 6 / 8, 5 / 8, 3 / 8, 2 / 8, 1 / 8]
    d = spark.createDataFrame([("s", b, v) for b, vs in {"a": [-1.0, -2.0, -3.0, -4.0, 5.0], "b": [-1.0, -2.0, -3.0, -4.0, -5.0]}.items() for v in vs], "scope string, baseline string, delta double")
    r = {x.baseline: x for x in metrics.wilcoxon_holm(d, ["scope", "baseline"]).collect()}
    assert r["b"].p == pytest.approx(1 / 32) and r["b"].p_holm == pytest.approx(2 / 32)
    assert r["a"].p == pytest.approx(sum(1 for s in range(32) if sum(k + 1 for k in range(5) if s >> k & 1) >= 10) / 32) and r["a"].p_holm >= r["b"].p_holm


def test_split_and_fingerprints(spark):
    df = spark.range(100).select("id", (F.col("id") * 1.0).alias("x"), F.lit(2.0).alias("y")).unionAll(spark.range(100, 105).select("id", ((F.col("id") - 100) * 1.0).alias("x"), F.lit(2.0).alias("y")))
    got, removed = roles.split(df, ["x"], "y", "id", 0.7, 0.1, 0.1, "feature0", 3)
    n = {r["role"]: r["count"] for r in got.groupBy("role").count().collect()}
    assert removed == 5 and n == {roles.DEVELOPMENT: 56, roles.VALIDATION: 24, roles.POOL: 10, roles.HELDOUT: 10}
    assert got.where(F.col("role").isin(roles.POOL, roles.HELDOUT)).agg(F.min("x")).first()[0] == 80
    with pytest.raises(ValueError):
        roles.split(df, ["x"], "y", "id", 0.7, 0.5, 0.4, "feature0", 3)
    a = roles.fingerprint(df, "id", ["x", "y"])
    assert a == roles.fingerprint(df.repartition(7), "id", ["x", "y"]) != roles.fingerprint(df.withColumn("y", F.lit(3.0)), "id", ["x", "y"])
    assert roles.covariate_fingerprint(df, "id", ["x"]) == roles.covariate_fingerprint(df.withColumn("y", F.lit(3.0)), "id", ["x"])


def metric(**change):
    m = dict.fromkeys(discovery.METRICS, 0.5) | {"complexity": 10.0} | change
    return (*[m[k] for k in discovery.METRICS], change.get("digest", "new"))


def test_gates(spark):
    old = metric(digest="old")
    cases = {"better": metric(val_nmse=0.2), "same": metric(), "unsafe": metric(val_nmse=0.1, stress_nmse=0.6), "nan": metric(val_nmse=math.nan), "huge": metric(val_nmse=0.01, complexity=500.0), "unchanged": (*metric(val_nmse=0.1)[:-1], "old"), "simpler": metric(complexity=5.0), "dear": metric(val_nmse=0.49, complexity=30.0)}
    df = spark.createDataFrame([(k, v, old) for k, v in cases.items()], f"k string, new {discovery.METRIC_TYPE}, old {discovery.METRIC_TYPE}")
    p = discovery.Policy()
    r = {x.k: (x.d, x.a) for x in df.select("k", discovery.dominates(F.col("new"), F.col("old"), p).alias("d"), discovery.accepts(F.col("new"), F.col("old"), F.lit("balanced"), p).alias("a")).collect()}
    assert r["better"] == (True, True) and r["simpler"] == (True, True)
    assert all(r[k] == (False, False) for k in ("same", "unsafe", "nan", "huge", "unchanged", "dear"))


def test_discovery_finds_a_law(spark):
    d = spark.range(400).select(((F.col("id") * 37 % 101) / 50 - 1).alias("a"), ((F.col("id") * 53 % 97) / 48 - 1).alias("b"), "id").withColumn("y", 1.5 + 2 * F.col("a") * F.col("b") - 0.5 * F.sin("a"))
    train, valid = d.where("id % 4 > 0").cache(), d.where("id % 4 = 0").cache()
    xs, y = [F.col("a"), F.col("b")], F.col("y")
    r = discovery.discover(train, valid, xs, y, discovery.Policy(islands=("balanced",), max_rounds=1), seeds=[("1.5", "seed"), ("broken(", "seed")])
    assert r["survivor"]["metrics"]["val_nmse"] < 1e-3 < r["anchor"]["metrics"]["val_nmse"]
    assert [e["phase"] for e in r["events"]][:2] == ["INITIALIZE", "SEED"] and r["events"][-1]["phase"] == "COMPLETE" and r["lineage"]
    assert [s for _, s in discovery.deterministic_candidates(train, xs, y)][0] == "constant"
    best, states = discovery.seed_survivor(train, valid, [("", "none")], xs, y)
    assert best.finite and len(states) == 1
    with pytest.raises(ValueError):
        discovery.seed_survivor(train, valid, [("1.0", "s")], xs, y, search.Budget(0))
    parts = discovery.intermediate_outputs(train, "sin(x0)*x1 + cos(x1)", xs)
    assert {t for t, _ in parts} >= {"sin(x0)", "cos(x1)"} and parts == sorted(parts, key=lambda p: (-p[1], p[0]))


def test_events_and_batches(spark):
    e = discovery.Events()
    e.add("SEED", "a", 0, round_id=9)
    assert e.rows[0]["round_id"] == 0
    for phase in ("INITIALIZE", "NONE"):
        with pytest.raises(ValueError):
            e.add(phase, "b", 0)
    batch = {"request_id": "r", "candidates": [{"candidate_id": "a", "expression": "x0"}, {"candidate_id": "a", "expression": "x1"}, {"candidate_id": "", "expression": "x1"}, {"candidate_id": "c", "expression": " "}, {"candidate_id": "d", "expression": "x0"}]}
    df = spark.createDataFrame([(json.dumps(batch),)], "j string")
    assert [r.reject_reason for r in discovery.validate_batch(df, "j", "r", 4).collect()].count("over_count") == 1
    got = {(r.candidate_id, r.expression): r.reject_reason for r in discovery.validate_batch(df, "j", "r", 9).collect()}
    assert got == {("a", "x0"): None, ("a", "x1"): "repeated_id", ("", "x1"): "no_id", ("c", " "): "no_expression", ("d", "x0"): None}
    assert {r.reject_reason for r in discovery.validate_batch(df, "j", "other", 9).collect()} == {"wrong_request"}
    assert discovery.public_fields({"a": 1, "b": 2}, ("b", "c")) == {"b": 2}


def test_closed_bounds():
    prior = Prior(0.0, 0.7, 3.0, 0.08)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(12, 1)), rng.normal(size=12)
    bank = gram.generic_bank(1)
    names = tuple(dict.fromkeys(t for b in bank for t in b.terms))

    def core(p):
        d = gram.design_rows(x, names)
        s = gram.Stats(names, float(p.sum()), (d.T * p) @ d, (d.T * p) @ y, float((p * y * y).sum()))
        return float(np.logaddexp.reduce([math.log(b.prior) + gram.conjugate(b, s, prior).log_evidence for b in bank]))

    flat, sharp = certify.uniform_log_bound(12, prior), certify.energy_log_bound(y, np.ones(12), prior)
    assert core(np.ones(12)) <= sharp.log_upper <= flat and sharp.margin > 0
    zero = certify.energy_log_bound(np.zeros(3), np.ones(3), prior)
    assert zero.t == 1.0 and zero.log_upper == pytest.approx(certify.uniform_log_bound(3, prior))
    ess = certify.bridge_relative_ess(core, 0.0, y, 5, 0.2, 0.3, prior)
    assert 0.5 < ess <= 1 and certify.bridge_relative_ess(core, 0.1, y, 5, 0.2, 0.3, prior) <= ess
    r = certify.sequential_reference(bank, x, y, prior)
    assert sum(r["steps"]) == pytest.approx(r["log_evidence"], abs=1e-9) and r["log_evidence"] == pytest.approx(core(np.ones(12)))
    back = certify.sequential_reference(bank, x, y, prior, list(range(11, -1, -1)))
    assert all(back["probabilities"][k] == pytest.approx(v) for k, v in r["probabilities"].items())
    assert certify.dependency_gate({"a": (1, 2), "b": (3, 2), "c": (0, 1)}, {"c": ("b",)}) == {"a": "pass", "b": "fail", "c": "blocked"}
    assert certify.distance_threshold(64) == 0.125 and certify.penalised_score(1.0, 2, 0.0, 0.1) == 2.2
    s = certify.Streams(1)
    assert s.take(0, "a").random() != s.take(1, "a").random() and certify.Streams(1).take(0, "a").random() == certify.Streams(1).take(0, "a").random()
    with pytest.raises(ValueError):
        s.take(0, "a")
    with pytest.raises(ValueError):
        certify.aligned(bank, {"other": 1.0}, {})


def test_interval_bounds(spark):
    rows = [(0, 0.5, 0, 0.1, 0.2), (0, 0.5, 1, 0.6, 0.7), (1, 0.3, 0, 0.4, 0.6), (1, 0.3, 1, 0.6, 0.7), (2, 0.2, 0, 0.1, 0.2), (2, 0.2, 1, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "state int, mass double, coordinate int, lower double, upper double")
    assert {r.class_rank: round(r.mass, 9) for r in certify.projection_bounds(df, [0.5]).collect()} == {2: 0.5, None: 0.3, 0: 0.2}
    b = certify.candidate_bounds(df, [0.5], [0, 1]).first()
    assert (b.lower, b.upper) == (0.5, 0.8)
    with pytest.raises(Exception):
        certify.projection_bounds(df.where("state > 0"), [0.5]).collect()


def test_structurewise_predictive():
    x = np.linspace(-1.4, 1.45, 9)[:, None]
    y = 0.15 + 0.7 * x[:, 0] + 0.2 * x[:, 0] ** 2
    designs = {"one": np.ones((9, 1)), "line": np.column_stack((np.ones(9), x[:, 0]))}
    s = discrepancy.Structurewise(designs, x, y[:7], {"short": (0.4, 0.55), "long": (0.6, 1.4)}, Prior(0, 0.7, 3, 0.08), observed=np.arange(7))
    assert sum(m.probability for m in s.members) == pytest.approx(1)
    grid = np.linspace(-6, 8, 4001)
    dens = np.array([s.predictive_density(8, t) for t in grid])
    area = np.concatenate(([0], np.cumsum((dens[1:] + dens[:-1]) / 2 * np.diff(grid))))
    cdf = np.array([s.predictive_cdf(8, t) for t in grid[::400]])
    assert np.abs(area[::400] + s.predictive_cdf(8, grid[0]) - cdf).max() < 1e-5 and (np.diff(cdf) >= 0).all()


def test_certified_acquisition():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 1))
    y = 1 + x[:, 0] ** 2 + 0.1 * rng.normal(size=30)
    bank, prior = gram.generic_bank(1), Prior()
    names = tuple(dict.fromkeys(t for b in bank for t in b.terms))
    d = gram.design_rows(x, names)
    s = gram.Stats(names, 30.0, d.T @ d, d.T @ y, float(y @ y))
    by = {e: gram.bank_posterior(bank, s, prior, e) for e in acquisition.POWERS}
    posts, groups = by[1.0], [[k] for k in range(len(bank))]
    actions, ids = np.array([[-3.0], [0.0], [3.5]]), np.array([5, 6, 7])
    m = acquisition.maximin_until_ranked(by, groups, actions, ids, x[:5], np.ones(3, bool))
    assert (m.lower <= m.upper + 1e-12).all() and (not m.certified or m.lower[m.leader] > np.delete(m.upper, m.leader).max())
    k, why = acquisition.discriminative(by, groups, x, actions, ids, x[:5], 1)
    assert 0 <= k < 3 and why in ("certified", "undecided", "least_harm")
    plain, inflated = (information.class_epig(posts, groups, actions, x[:5], e) for e in (0.0, 5.0))
    assert (inflated <= plain + 1e-12).all()
    assert (acquisition.class_eig_all(posts, groups, actions, 16, 5.0)[0] <= acquisition.class_eig_all(posts, groups, actions, 16)[0] + 1e-9).all()
    draws = [acquisition.weighted_draw(ids, np.array([0.0, 1.0, 3.0]), k) for k in range(400)]
    assert 0 not in draws and 0.65 < draws.count(2) / 400 < 0.85
    curve = acquisition.run(bank, prior, (x[:8], y[:8]), (x[8:20], y[8:20]), (x[20:], y[20:]), "discrepancy_aware", 1, 2)
    assert len(curve) == 3 and curve[0]["chosen"] >= 0
