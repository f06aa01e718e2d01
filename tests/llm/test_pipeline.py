"""The pipeline against plain versions of its stages."""

import corpus_pipeline

from . import brute


def test_stages_on_small_documents(spark, tmp_path):
    import duckdb

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    found, held = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held, src).write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        found[name] = {r.doc_id: r.text for r in held.collect()}
        if name != "bpe":
            assert held.columns == corpus_pipeline.COLUMNS
    assert {k for k in rows if k not in found["language"]} == {k for k, t in rows.items() if not any(c.isalpha() for c in t or "")}
    lines = brute.later_runs(sorted(found["language"].items()))
    assert found["line_dedup"] == {k: t for k, n, gone, t in lines if gone < n or not gone}
    groups = brute.near(sorted(found["line_dedup"].items()))
    assert found["near_dedup"] == {k: t for k, t in found["line_dedup"].items() if groups[k] == k}
    items = duckdb.sql(f"SELECT item_id, text FROM '{src}/benchmark.parquet'").fetchall()
    clean = {x[0] for x in brute.leaks(sorted(found["near_dedup"].items()), items) if not x[5]}
    assert found["decontaminate"] == {k: t for k, t in found["near_dedup"].items() if k in clean} == found["bpe"]


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() < 200 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)
