"""Sources, roles, the evidence log, and streams against batches."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import distance, evidence, metrics, ordered, ranking, roles, sequential
from quillon.sources import tables
from quillon.streaming import running


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\nbad,3\n4,nan\n5,6\n")
    df = tables.read_delimited(spark, str(tmp_path / "a.csv"))
    assert roles.numeric_frame(df, "y").collect() == [(1.0, 2.0), (5.0, 6.0)]
    assert tables.finalise(df, ["x"], "y", 2).count() == 2
    with pytest.raises(ValueError):
        tables.finalise(df, ["x"], "y", 3)
    with pytest.raises(ValueError):
        tables.read_delimited(spark, "a.xlsx")
    (tmp_path / "b.dat").write_text("  1 2.5\n\n3   4\n")
    assert tables.read_columns(spark, str(tmp_path / "b.dat"), ["a", "b"]).collect() == [(1.0, 2.5), (3.0, 4.0)]
    (tmp_path / "c.jsonl").write_text('{"a":1}\nbroken\n{"a":2}\n')
    assert tables.read_json_lines(spark, str(tmp_path / "c.jsonl"), "a int").count() == 2
    with pytest.raises(Exception):
        tables.read_json_lines(spark, str(tmp_path / "c.jsonl"), "a int", strict=True).collect()
    d = tables.file_digests(spark, str(tmp_path)).collect()
    assert len(d) == 3 and len(tables.tree_digest(spark, str(tmp_path))) == 64
    tables.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["x", "y"]
    years = tables.union_years(spark, {2012: str(tmp_path / "a.csv"), 2011: str(tmp_path / "a.csv")})
    assert years.groupBy("group").count().count() == 2
    with pytest.raises(ValueError):
        tables.allowed_path("/etc/passwd", str(tmp_path))
    r = tables.Registry()
    r.add(" Air ", lambda s, root: df)
    assert r.ids() == ("air",) and r.load(spark, "AIR", "").count() == 4
    with pytest.raises(ValueError):
        r.load(spark, "x", "")


def test_roles_and_leakage(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") * 1.5).alias("x"), F.lit(1.0).alias("y"))
    h = roles.hash_roles(df, "id", 7)
    n = {r["role"]: r["count"] for r in h.groupBy("role").count().collect()}
    assert n == {roles.DEVELOPMENT: 120, roles.VALIDATION: 30, roles.POOL: 30, roles.HELDOUT: 20}
    again = roles.hash_roles(df.withColumn("y", F.lit(9.0)), "id", 7)
    assert h.select("id", "role").exceptAll(again.select("id", "role")).isEmpty()
    assert roles.shared_rows(h, ["x", "y"]).isEmpty()
    twice = h.unionByName(h.limit(1).withColumn("role", F.lit("other")))
    assert roles.shared_rows(twice, ["x", "y"]).first()["n_shared"] == 1
    v = roles.selection_view(h, "y")
    assert v.where("role = 'acquisition-pool' AND y IS NOT NULL").isEmpty() and v.where(F.col("role") == roles.HELDOUT).isEmpty()
    for s in ("feature0", "critical_point", "pca1", "mahalanobis"):
        assert roles.selection_scores(df.withColumn("z", F.sin("id")), ["x", "z"], s, "id").where("score IS NULL").isEmpty()
    assert [r.row_id for r in roles.row_ids(df, "ns", "id").orderBy("id").limit(2).collect()] == ["ns:000000", "ns:000001"]


def test_ordered_operators(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=300), np.full(150, 0.25)])
    df = spark.createDataFrame([(i, float(v), i % 3) for i, v in enumerate(x)], "id long, x double, k int")
    for q in (0.0, 0.13, 0.5, 0.99, 1.0):
        assert abs(ordered.quantiles(df, F.col("x"), [q]).first().q - np.quantile(x, q)) < 1e-12
    got = {r.id: r.rk for r in ordered.ranked(df, F.col("x"), "id", "rk").collect()}
    want = sorted(range(len(x)), key=lambda i: (x[i], i))
    assert all(got[i] == k for k, i in enumerate(want))
    run = {r.id: r.s for r in ordered.running(df, F.col("id").cast("double"), "id", {"s": F.col("x")}, ["k"]).collect()}
    assert all(abs(run[i] - x[i % 3 : i + 1 : 3].sum()) < 1e-9 for i in range(len(x)))


def test_buckets_hold_few_rows_whatever_the_spread(spark):
    x = [1e12, -0.0, 0.0, None, float("nan"), float("inf")] + [k / 1000 for k in range(2000)] + [0.5] * 2000
    df = spark.createDataFrame(list(enumerate(x)), "id long, x double")
    b = ordered.bucketed(df, F.col("x"), 64, "id")
    assert b.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 200
    got = [r.id for r in ordered.ranked(df, F.col("x"), "id", "rk", buckets=64).orderBy("rk").collect()]
    assert got == [r.id for r in df.orderBy("x", "id").collect()]
    assert ordered.quantiles(df.where("x < 1e6"), F.col("x"), [0.5]).first().q == 0.5
    assert ordered.ranked(df.limit(0), F.col("x"), "id").isEmpty()


def test_nearest_by_differences(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 6)) * 1e-3 + 1e4  # the expansion of the square keeps no digit of these distances
    rows = [(k, [float(c) for c in r]) for k, r in enumerate(v)] + [(400, None), (401, [float(c) for c in v[7]])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.query_id: r.nn_id for r in distance.nearest(df, "id", "v", df.where("id % 20 = 0 OR id = 401"), 5).collect()}
    d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {k: int(d[k].argmin()) for k in range(0, 400, 20)} | {401: 7}
    with pytest.raises(ValueError):
        distance.kernel_table(df.where("v IS NOT NULL"), "id", "v", most=100)


def test_front_meets_in_a_tree(spark):
    x = np.random.default_rng(4).integers(0, 60, (3000, 3)).astype(float)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, a double, b double, c double").repartition(40)
    beaten = [((x <= r).all(axis=1) & (x < r).any(axis=1)).any() for r in x]
    got = {r.id for r in ranking.pareto_front(df, "id", ["a", "b", "c"], pruners=2).collect()}
    assert got == {k for k, b in enumerate(beaten) if not b}


def test_reachable_goes_on_to_the_end(spark):
    edges = spark.range(70).selectExpr("id AS source", "id + 1 AS target").coalesce(1)
    assert sequential.reachable(edges, F.lit(0).cast("long")).count() == 71


def test_resampling_is_unbiased(spark):
    w = spark.createDataFrame([(0, 0.05), (1, 0.15), (2, 0.30), (3, 0.50)], "id long, w double")
    for f in (lambda: sequential.systematic_counts(w, "id", "w", 400, 0.3), lambda: sequential.stratified_counts(w, "id", "w", 400, 1), lambda: sequential.residual_counts(w, "id", "w", 400, 0.3)):
        got = {r.id: r.copies for r in f().collect()}
        assert sum(got.values()) == 400 and all(abs(got[i] - 400 * p) <= 2 for i, p in enumerate((0.05, 0.15, 0.30, 0.50)))
    got = {r.id: r.copies for r in sequential.multinomial_counts(w, "id", "w", 4000, 1).collect()}
    assert sum(got.values()) == 4000 and all(abs(got[i] / 4000 - p) < 0.03 for i, p in enumerate((0.05, 0.15, 0.30, 0.50)))
    step = sequential.tempering_step(w, F.col("w"), F.col("id") * 3.0, 1.0, 0.9)
    r = sequential.conditional_ess(w, F.col("w"), F.col("id") * 3.0, step).first()
    assert 0 < step < 1 and r.cess >= 0.9 * r.n - 1e-3


def test_eprocess_rejects_only_bad_transforms(spark):
    balanced = [0.01, 0.99, 0.25, 0.75, 0.5, 0.5, 0.75, 0.25] * 8
    rows = [("good", i, u) for i, u in enumerate(balanced)] + [("bad", i, 0.999) for i in range(64)]
    df = spark.createDataFrame(rows, "k string, t long, u double")
    got = {r.k: r for r in sequential.pit_eprocess(df, "k", F.col("t").cast("double"), "t", F.col("u")).collect()}
    assert got["good"].first_crossing == -1 and got["bad"].first_crossing > 0 and got["bad"].n == 64


def test_evidence_log(spark, tmp_path):
    log = evidence.Log(tmp_path / "log.jsonl")
    for k in range(3):
        log.append("h1" if k else "h0", "NOTE", {"k": k})
    assert log.verify() == {"valid": True, "events": 3} and len(log.events("h1")) == 2
    text = (tmp_path / "log.jsonl").read_text()
    (tmp_path / "log.jsonl").write_text(text.replace('"k":1', '"k":7'))
    assert not log.verify()["valid"]
    with pytest.raises(ValueError):
        log.append("h", "NOTE", {})
    with pytest.raises(ValueError):
        evidence.strict_loads('{"a":1,"a":2}')
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double")
    log = evidence.Log(tmp_path / "two.jsonl")
    assert evidence.confirm(df, F.col("x") * 2, "y", 0.01, log, "h")["passed"]
    with pytest.raises(ValueError):
        evidence.confirm(df, F.col("x") * 2, "y", 0.01, log, "h")
    chain = evidence.chained(spark.createDataFrame([(i, "t", i, json.dumps({"k": i})) for i in range(10)], "event_id long, event_type string, user_id long, props string"))
    assert evidence.verify(chain).first().valid
    broken = chain.withColumn("event_hash", F.when(F.col("seq") == 4, F.lit("0")).otherwise(F.col("event_hash")))
    assert not evidence.verify(broken).first().valid
    store = spark.createDataFrame([("a", 1, 0.1)], "entry_id string, successes int, gain double")
    staged = spark.createDataFrame([("a", 0.3, "h1"), ("b", 0.2, "h2")], "entry_id string, gain double, hypothesis_id string")
    done = evidence.promote(store, staged, spark.createDataFrame([("h1",)], "hypothesis_id string"), 5).collect()
    assert [(r.entry_id, r.successes, r.gain) for r in done] == [("a", 2, 0.3)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 2}", i, float((i * 37) % 100) / 100) for i in range(60)]
    for part in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps({"k": k, "t": t, "u": u}) for k, t, u in rows[part * 20 : part * 20 + 20]))
    schema = "k string, t long, u double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = running.gram_stream(stream, F.col("t"), F.col("u"), "k").writeStream.outputMode("complete").format("memory").queryName("g").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = running.gram_stream(spark.read.schema(schema).json(str(tmp_path / "in")), F.col("t"), F.col("u"), "k")
    assert sorted(map(tuple, spark.table("g").collect()))[0][:2] == sorted(map(tuple, batch.collect()))[0][:2]
    assert {(r.k, r.n, round(r.sxy, 6)) for r in spark.table("g").collect()} == {(r.k, r.n, round(r.sxy, 6)) for r in batch.collect()}
    e = running.eprocess_stream(stream, "k", "t", "u").writeStream.outputMode("update").format("memory").queryName("e").trigger(availableNow=True).start()
    e.awaitTermination(120)
    last = {}
    for r in spark.table("e").collect():
        last[r.k] = max(last.get(r.k, (0, 0.0)), (r.n, r.log_e))
    df = spark.createDataFrame(rows, schema)
    want = {r.k: (r.n, r.log_e) for r in sequential.pit_eprocess(df, "k", F.col("t").cast("double"), "t", F.col("u")).collect()}
    assert all(last[k][0] == n and abs(last[k][1] - v) < 1e-9 for k, (n, v) in want.items())


def test_paired_statistics(spark):
    rng = np.random.default_rng(2)
    rows = [(d, int(s), v, float(base + (0.5 if v == "other" else 0.0) + rng.normal(0, 0.01))) for d in ("a", "b") for s, base in enumerate(rng.uniform(1, 2, 12)) for v in ("full", "other")]
    runs = spark.createDataFrame(rows, "scope string, unit int, policy string, v double")
    d = metrics.paired_deltas(runs, "scope", "unit", "policy", "full", "v")
    e = metrics.paired_effects(d, "scope").collect()
    assert all(r.n == 12 and -0.52 < r.delta_mean < -0.48 and r.delta_low < r.delta_mean < r.delta_high for r in e)
    w = metrics.wilcoxon_holm(d, ["scope", "baseline"]).collect()
    assert all(r.n_wins == 12 and r.p < 0.01 for r in w)
    assert metrics.holm({"a": 0.01, "b": 0.04}) == {"a": 0.02, "b": 0.04}
    b = metrics.bootstrap_median(d, ["scope"], "delta", 200, 1).collect()
    assert all(r.low <= r.median <= r.high for r in b)
