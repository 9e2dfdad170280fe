"""The whole pipeline against a plain version, stage by stage."""

import collections

import brute
import corpus_pipeline
import pytest

from pyspark.sql import functions as F

from gridstone.llm import quality_rules


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    return f"file://{path}"


def _redacted(text):
    out, at = "", 0
    for span in brute.secrets(text)[4].split(","):
        if span:
            s, e = map(int, span.split(":")[1:])
            if s >= at:
                out += text[at:s] + "[REDACTED]"
            at = max(at, e)
    return out + text[at:]


def test_stages_follow_the_plain_version(spark, sf_dir, texts):
    kept_ids = {r.doc_id for r in quality_rules.apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept").collect()}
    assert not kept_ids & {i for i, t in texts if brute.quality(t)[5]}
    good = [(i, t) for i, t in texts if i in kept_ids]
    groups = brute.near(good)
    clean = {i: _redacted(t) for i, t in good if groups[i][2]}
    size = collections.Counter(i % 3 for i in clean)
    want = {i: brute.copies(17, brute.mix_key(i, t), 1.0 / len(size) * len(clean) / size[i % 3]) for i, t in clean.items()}

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        seen.append([r.asDict() for r in out.collect()])
        if len(seen) < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = spark.createDataFrame(seen[-1], docs.schema)
    assert {r["doc_id"] for r in seen[0]} == kept_ids
    assert {r["doc_id"] for r in seen[1]} == set(clean)
    assert {r["doc_id"]: r["text"] for r in seen[2]} == clean
    assert collections.Counter(r["doc_id"] for r in seen[3]) == {i: n for i, n in want.items() if n}
    assert all(r["round_trip"] for r in seen[4]) and len(seen[4]) == sum(want.values())
    assert {r["doc_id"]: len(r["ids"]) for r in seen[4]} == {r["doc_id"]: r["n_tokens"] for r in seen[4]}


def test_run_hands_written_tables_on(spark, sf_dir, monkeypatch):
    first = lambda spark, docs, sf: docs.where("doc_id < 100")
    second = lambda spark, docs, sf: docs.where("doc_id >= 90").select("doc_id", F.input_file_name().alias("file"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", first), ("two", second)])
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == list(range(90, 100)) and all("pipeline-one" in r.file for r in out)


def test_empty_input_passes_through(spark, docs):
    frame = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, "")
        frame = spark.createDataFrame(out.collect(), out.schema)
    assert frame.count() == 0 and "ids" in frame.columns
