"""Workbooks, the loader, evidence that is promoted, persisted and exported, and edits."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import expressions as ex
from quillon.operators import acquisition, certify, evidence, metrics, ranking, roles, sequential
from quillon.sources import tables, workbooks

HEAD = '<?xml version="1.0"?>'


def office(path, rows, strings):
    """A workbook as an office program writes it: shared strings, runs, gaps, booleans and errors, two sheets."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Other" sheetId="2" r:id="b"/><sheet name="Sheet1" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'{HEAD}<sst xmlns="{main}">' + "".join(strings) + "</sst>")
        z.writestr("xl/worksheets/one.xml", f'{HEAD}<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
        z.writestr("xl/worksheets/two.xml", f'{HEAD}<worksheet xmlns="{main}"><sheetData/></worksheet>')


def test_workbook_of_an_office_program(spark, tmp_path):
    strings = ["<si><t>name</t></si>", "<si><r><t>va</t></r><r><rPr/><t>lue</t></r><rPh><t>no</t></rPh></si>", "<si><t>a &amp; b</t></si>"]
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3"><v>1.5</v></c><c r="AB3" t="b"><v>1</v></c></row><row r="4"/><row r="5"><c r="C5" t="e"><v>#N/A</v></c><c r="A5" t="str"><v>x</v></c></row>'
    office(tmp_path / "one.xlsx", rows, strings)
    got = workbooks.read_workbooks(spark, str(tmp_path), ["value", "name"], "Sheet1").orderBy("row").collect()
    assert [(r.row, r.name, r.value) for r in got] == [(3, "a & b", "1.5"), (5, "x", None)]
    raw = list(workbooks.sheet_rows((tmp_path / "one.xlsx").read_bytes(), "Sheet1"))
    assert raw[1][1][27] == "TRUE" and raw[1][1][1] is None and len(raw) == 4
    assert list(workbooks.sheet_rows((tmp_path / "one.xlsx").read_bytes())) == []
    with pytest.raises(Exception, match="missing columns other"):
        workbooks.read_workbooks(spark, str(tmp_path), ["other"], "Sheet1").collect()
    with pytest.raises(ValueError):
        list(workbooks.sheet_rows((tmp_path / "one.xlsx").read_bytes(), "None"))


def test_workbooks_equal_delimited_files(spark, tmp_path):
    """The same rows from several workbooks and from a delimited file, in whatever order the columns stand."""
    body = [[k, f"n<{k}>" if k % 5 else None, k / 7] for k in range(9000)]
    for part in range(3):
        order = [0, 1, 2] if part else [2, 0, 1]
        rows = [[["id", "name", "v"][j] for j in order]] + [[r[j] for j in order] for r in body[part::3]]
        (tmp_path / f"{part}.xlsx").write_bytes(workbooks.workbook({"Sheet1": rows, "More": []}))
    spark.createDataFrame(body, "id long, name string, v double").write.csv(str(tmp_path / "plain.csv"), header=True)
    one = workbooks.read_workbooks(spark, str(tmp_path), ["id", "name", "v"]).select(F.col("id").cast("long"), "name", F.col("v").cast("double"))
    two = tables.read_delimited(spark, str(tmp_path / "plain.csv")).select(F.col("id").cast("long"), "name", F.col("v").cast("double"))
    assert one.count() == 9000 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_loader(spark, tmp_path):
    """One call from a file to roles: text, repeated and odd rows are left out and counted; a workbook gives the same rows."""
    rng = np.random.default_rng(1)
    rows = [[repr(float(v)) for v in rng.normal(size=3)] for _ in range(60)]
    rows += rows[:4] + [["x", "1", "2"], ["", "1", "2"], ["nan", "1", "2"], ["inf", "1", "2"]]
    (tmp_path / "d.csv").write_text("a,b,y\n" + "\n".join(",".join(r) for r in rows))
    d, left = roles.load(spark, str(tmp_path / "d.csv"), "y")
    assert left == {"scanned": 68, "not_numeric": 4, "repeated": 4} and d.count() == 60
    assert {r.role: r["count"] for r in d.groupBy("role").count().collect()} == {roles.DEVELOPMENT: 29, roles.VALIDATION: 13, roles.POOL: 9, roles.HELDOUT: 9}
    (tmp_path / "d.xlsx").write_bytes(workbooks.workbook({"Sheet1": [["a", "b", "y"], *rows]}))
    e, again = roles.load(spark, str(tmp_path / "d.xlsx"), "y", ["a", "b"])
    assert again == left and sorted(map(tuple, e.select("a", "b", "y", "role").collect())) == sorted(map(tuple, d.select("a", "b", "y", "role").collect()))
    with pytest.raises(ValueError):
        roles.load(spark, str(tmp_path / "d.xlsx"), "y")


def test_promotion_needs_a_confirmation_that_passed(spark, tmp_path):
    store = spark.createDataFrame([("old", 3, 0.5)], "entry_id string, successes int, gain double")
    staged = spark.createDataFrame([("a", "h1", 0.2), ("b", "h2", 0.3), ("old", "h1", 0.9)], "entry_id string, hypothesis_id string, gain double")
    log = evidence.Log(tmp_path / "log.jsonl")
    log.append("h2", "FROZEN", {"maximum_nmse": 0.1})
    log.append("h2", "CONFIRMED", {"nmse": 0.5})  # over its bound: counts for nothing
    with pytest.raises(ValueError, match="no confirmation"):
        evidence.promote_confirmed(store, staged, log, "h1", 5)
    df = spark.createDataFrame([(float(k), 2.0 * k) for k in range(9)], "x double, y double")
    evidence.confirm(df, F.col("x") * 2, "y", 0.01, log, "h1")
    got = {r.entry_id: (r.successes, r.gain) for r in evidence.promote_confirmed(store, staged, log, "h1", 5).collect()}
    assert got == {"old": (4, 0.9), "a": (1, 0.2)}
    with pytest.raises(ValueError, match="no confirmation"):
        evidence.promote_confirmed(store, staged, log, "h2", 5)
    log.append("h1", "RETRACTED", {})
    assert evidence.confirmations(log) == set()
    lines = (tmp_path / "log.jsonl").read_text().splitlines()
    (tmp_path / "log.jsonl").write_text("\n".join([lines[0].replace("0.1", "0.9"), *lines[1:]]) + "\n")
    with pytest.raises(ValueError, match="doesn't hold"):
        evidence.confirmations(evidence.Log(tmp_path / "log.jsonl"))


def test_hypotheses_are_persisted_once(tmp_path):
    log, spec = evidence.Log(tmp_path / "log.jsonl"), {"hypothesis_id": "h1", "expression": "2*x0", "status": "proposed"}
    for _ in range(2):
        path = evidence.persist_hypothesis(tmp_path / "h", spec, log, {"fingerprint": "f", "val_nmse": 0.1})
    assert json.loads(path.read_text()) == spec and [e["event_type"] for e in log.events()] == ["PROPOSED", "SCREENED"]
    evidence.persist_hypothesis(tmp_path / "h", spec, log, {"fingerprint": "g", "val_nmse": 0.2})
    assert len(log.events("h1")) == 3 and log.verify()["valid"]
    for bad in ({**spec, "expression": "3*x0"}, {**spec, "hypothesis_id": "../h"}, {"hypothesis_id": "h3"}):
        with pytest.raises(ValueError):
            evidence.persist_hypothesis(tmp_path / "h", bad, log)


def test_export_from_events(spark, tmp_path):
    rows = [(0, "h", "PROPOSED", '{"expression":"x0","n":1}'), (1, "h", "SCREENED", '{"nmse":0.5}'), (2, "g", "PROPOSED", '{"expression":"x1","extra":{"a":[1]}}')]
    e = spark.createDataFrame(rows, "seq long, hypothesis_id string, event_type string, payload string")
    t = evidence.payload_table(e, "PROPOSED").orderBy("seq")
    assert t.columns == ["seq", "hypothesis_id", "expression", "extra", "n"] and [(r.expression, r.extra, r.n) for r in t.collect()] == [("x0", None, "1"), ("x1", '{"a":[1]}', None)]
    manifest = evidence.export(e, str(tmp_path / "out")).collect()
    assert {r.path.split("/")[0] for r in manifest} == {"proposed", "screened"}
    import hashlib

    assert all(hashlib.sha256((tmp_path / "out" / r.path).read_bytes()).hexdigest() == r.sha256 for r in manifest)
    back = spark.read.csv(str(tmp_path / "out" / "screened"), header=True).collect()
    assert [(r.seq, r.nmse) for r in back] == [("1", "0.5")]
    with pytest.raises(ValueError):
        evidence.export(e.withColumn("event_type", F.lit("OTHER")), str(tmp_path / "no"))
    with pytest.raises(ValueError):
        evidence.payload_table(e, "PROPOSED", 2)


def test_edits(spark):
    pairs = [("x0*2", "x0*3.5", "REPARAMETERIZE"), ("x0", "x0 + 0", "NOOP"), ("x0", "x0*x1", "ADD"), ("x0*x1", "x1", "DELETE"), ("sin(x0)", "tanh(x0)", "CHANGE_OPERATOR"), ("sin(x0)", "sin(x1)", "CHANGE_INTERACTION"), ("sin(x0)", "x1**2 + 1", "REPLACE"), (None, "x0", None), ("x0", "import", None)]
    got = ranking.edits(spark.createDataFrame(pairs, "a string, b string, want string"), "a", "b", 2).collect()
    assert [r.action for r in got] == [r.want for r in got] and got[2].removed == [] and "x1" in got[2].added


def test_choices(spark):
    d = spark.createDataFrame([("a", 0.5, 1.0), ("a", 1.0, 1.0 + 5e-16), ("a", 0.25, 2.0), ("b", 1.0, 0.0)], "k string, power double, score double")
    assert {r.k: (r.power, r.least) for r in ranking.least_favourable(d, ["k"], "power", "score").collect()} == {"a": (0.5, 1.0), "b": (1.0, 0.0)}
    e = spark.createDataFrame([("m", 1.0, 3, "b"), ("m", 1.0, 3, "a"), ("m", 9.0, 1, "c"), ("m", 2.0, 1, "d")], "engine string, score double, complexity int, text string")
    r = ranking.best_with_median(e, ["engine"], "score", "complexity", "text", ["text", "score"]).first()
    assert (r.text, r["median"], r.n) == ("a", 1.5, 4)
    y = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (1.0, float("nan")), (float("inf"), 1.0)], "y double, p double")
    assert metrics.finite_pairs(y, F.col("y"), F.col("p")).count() == 1


def test_complete_proposals_and_classes(spark):
    s = spark.createDataFrame([(k, float(-k), float(k + 1)) for k in range(5)], "state int, log_target double, prior double")
    total = sum(np.exp(-k) for k in range(5))
    pi = s.select("state", (F.exp("log_target") / total).alias("pi"))
    for kind in ("uniform", "prior"):
        b = sequential.balance(sequential.mh_transition(s, sequential.complete_proposals(s, kind, "prior")), pi).first()
        assert b.balance_error < 2e-15 and b.stationarity_error < 1e-14
    with pytest.raises(ValueError):
        sequential.complete_proposals(s, "uniform", None, 4)
    with pytest.raises(ValueError):
        sequential.complete_proposals(s, "other")
    m = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "state int, class_id string")
    got = {r.class_id: r.mass for r in certify.class_masses(certify.MappedClasses(m), s.select("state", F.lit(0.2).alias("mass"))).collect()}
    assert got == {"a": pytest.approx(0.4), "b": pytest.approx(0.2), None: pytest.approx(0.4)}


def test_scales_fall_back(spark):
    """Targets that don't vary are scaled by all points."""
    o, c, t = np.array([[0.0, 1.0]]), np.array([[1.0, 3.0], [2.0, 1.0]]), np.array([[0.0, 1.0], [2.0, 1.0]])
    good, now, then = acquisition.safe_set(o, c, t)
    assert np.isfinite(now) and np.isfinite(then).all() and then[0] > then[1] and len(good) == 2


def test_imported_trees():
    got = ex.imported("Add(Mul(Integer(-2), Symbol('x0'), sin(Symbol('x1'))), Pow(Symbol('x1'), Integer(2)), Float('0.5', precision=53))", 2)
    assert ex.probe(got, [[1.0, 0.0], [0.5, 2.0]]) == pytest.approx([0.5, -np.sin(2.0) + 4.5])
    assert ex.probe(ex.imported("Mul(Rational(1, 2), Pow(Symbol('x0'), Rational(1, 2)))", 1), [[4.0]]) == pytest.approx([1.0])
    for bad in ("Symbol('y')", "Symbol('x5')", "Derivative(Symbol('x0'))", "Add()", "Integer(True)", "__import__('os')", "x0 + 1", "Add(Symbol('x0'), ", "Rational(1, 0)"):
        assert ex.imported(bad, 2) is None


def test_digest_trees(spark, monkeypatch):
    """Anchors of several runs of blocks, and fingerprints over several levels, still see every change."""
    monkeypatch.setattr(evidence, "BLOCK", 5)
    events = spark.range(120).select(F.col("id").alias("event_id"), F.lit("t").alias("event_type"), F.col("id").alias("user_id"), F.lit("{}").alias("props"))
    one = {r.seq: r.event_hash for r in evidence.chained(events).collect()}
    monkeypatch.setattr(evidence, "FAN", 4)
    log = evidence.chained(events).cache()
    assert evidence.verify(log).first().valid
    assert {r.seq: r.event_hash for r in log.where("seq < 20").collect()} == {k: v for k, v in one.items() if k < 20}  # the first run is what it was
    for k in (3, 47, 119):
        assert not evidence.verify(log.withColumn("payload", F.when(F.col("seq") == k, "x").otherwise(F.col("payload")))).first().valid
    assert not evidence.verify(log.where("seq <> 60")).first().valid
    df = spark.range(100).select("id", (F.col("id") * 1.5).alias("v"))
    a = roles.fingerprint(df, "id", ["v"], 4, 3)
    assert a == roles.fingerprint(df.repartition(5), "id", ["v"], 4, 3) != roles.fingerprint(df.withColumn("v", F.when(F.col("id") == 77, 0.0).otherwise(F.col("v"))), "id", ["v"], 4, 3)
    assert roles.fingerprint(df.limit(0), "id", ["v"], 4, 3) != a


def test_reference_draws():
    """A draw by the reference's weights never takes what has none."""
    ids = np.array([5, 3, 9])
    assert {int(ids[acquisition.weighted_draw(ids, np.array([0.0, 1.0, 1.0]), s)]) for s in range(40)} == {3, 9}


def test_paired_methods(spark):
    rows = [("f", 1, "a", 10, 0.5), ("f", 1, "b", 10, 0.2), ("f", 2, "a", 10, 0.5), ("f", 2, "b", 11, 0.7), ("f", 3, "a", 10, 0.5), ("f", 4, "a", 1, 0.1), ("f", 4, "b", 1, 0.1), ("f", 4, "c", 1, 0.1), ("f", 5, "b", None, 0.1), ("f", 5, "a", None, 0.2), ("f", 6, "a", 1, 0.1), ("f", 6, "a", 1, 0.1)]
    d = spark.createDataFrame(rows, "fixture string, seed int, method string, budget int, error double")
    got = {r.seed: (r.budget_matched, round(r.error_improvement, 9)) for r in metrics.paired_methods(d, ["fixture", "seed"], "method", "a", "b", ["budget"], ["error"]).collect()}
    assert got == {1: (True, 0.3), 2: (False, -0.2), 5: (True, 0.1)}


def test_retention(spark):
    """An added term that matters, one that doesn't, a deletion, other constants, and nothing."""
    from quillon.operators import refine

    rng = np.random.default_rng(7)
    x = rng.uniform(-2, 2, (300, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a + 2 * np.sin(b))) for a, b in x], "a double, b double, y double").cache()
    xs, y = [F.col("a"), F.col("b")], F.col("y")

    def left(parent, proposal, final):
        return refine.retention(df, df, parent, proposal, final, xs, y)

    added = left("x0", "x0 + 2*sin(x1)", "x0 + 1.9*sin(x1)")
    assert added["retained"] and added["added_retained"] and added["action"] == "ADD" and len(added["added"]) == 1
    assert not left("x0", "x0 + 2*sin(x1)", "x0")["retained"]
    gone = left("x0 + x1**2", "x0", "x0")
    assert gone["retained"] and gone["deletion_effective"] and gone["deleted"] == ["x1 ** 2"] and not gone["added_retained"]
    back = left("x0 + x1**2", "x0", "x0 + x1**2")
    assert not back["retained"] and back["effect"] == 0 and back["action"] == "NOOP"
    other = left("x0*2", "x0*3", "x0*3")
    assert other["reparameterized"] and other["retained"]


def test_plugins_as_table_functions(spark):
    from quillon.operators import search

    search.register_plugin(spark, "plugin_a", lambda n: [f"x{k} + 1" for k in range(n)] + ["broken("])
    search.register_plugin(spark, "plugin_b", lambda n: ["1 + x0", "sin(x0)", "x9"])
    every = spark.sql("SELECT * FROM plugin_a(2)").collect()
    assert [(r.plugin, r.expression, r.digest is None, r.reason is None) for r in every] == [("plugin_a", "x0 + 1", False, True), ("plugin_a", "x1 + 1", False, True), ("plugin_a", "broken(", True, False)]
    got = {(r.plugin, r.expression) for r in search.plugin_table(spark, ["plugin_b", "plugin_a"], 2).collect()}
    assert got == {("plugin_a", "x0 + 1"), ("plugin_a", "x1 + 1"), ("plugin_b", "sin(x0)")}
    for bad in (lambda: search.register_plugin(spark, "no name", lambda n: []), lambda: search.plugin_table(spark, [], 1)):
        with pytest.raises(ValueError):
            bad()


def test_bridge_update(spark):
    rows = [("a", 0.0, 1.0, 2.0), ("a", -1.0, 0.0, 0.5), ("a", float("-inf"), 0.0, 9.0), ("a", 0.0, 1.0, float("nan")), ("a", None, 0.0, 0.0), ("b", 0.0, 0.0, float("-inf"))]
    d = spark.createDataFrame(rows, "k string, w double, now double, later double")
    got = sequential.bridge_update(d, ["k"], F.col("w"), F.col("now"), F.col("later")).collect()
    a = sorted((r.log_weight_next for r in got if r.k == "a"), reverse=True)
    assert np.exp(a).sum() == pytest.approx(1.0) and a[0] - a[1] == pytest.approx(1.5) and a[2:] == [float("-inf")] * 3
    inc = next(r.log_increment for r in got if r.k == "a")
    assert inc == pytest.approx(np.log(np.exp(1.0) + np.exp(-0.5)) - np.log(1 + np.exp(-1.0) + 1))
    assert all(r.log_weight_next is None and r.log_increment is None for r in got if r.k == "b")
