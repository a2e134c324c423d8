"""The pipeline's stages against brute force on a small table."""

import corpus_pipeline
from quillon.llm import decontaminate, secret_scan


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("cast(item_id as string)", "text").collect()]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language ID", "near-dedup", "decontamination", "secret scan", "byte-level BPE"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
        if name == "language ID":
            assert len(after) == n
        if name == "near-dedup":
            assert 0 < len(after) < n and len({r.text for r in after.values()}) == len(after)
        if name == "decontamination":
            bad = {r[0] for r in decontaminate.brute([(i, r.text) for i, r in before.items()], items) if r[5]}
            assert set(after) == set(before) - bad
        if name == "secret scan":
            assert set(after) == set(before)
            assert all((after[i].text == before[i].text) == (not secret_scan.brute(before[i].text)) for i in after)
        if name == "byte-level BPE":
            assert set(after) == set(before) and all(r.n_tokens == len(r.ids) for r in after.values())
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()} == {i: r.ids_sha256 for i, r in after.items()}
