"""Sample and trace files, response reuse, replay, sums and features on small frames."""

import pytest
from pyspark.sql import functions as F

from gridstone.functions import features as FT
from gridstone.operators import grid as GR
from gridstone.operators import replay as RP
from gridstone.operators import summaries as S
from gridstone.sources import samples as SP
from gridstone.sources import traces as TR


def test_sample_lines_are_read_and_judged(spark, tmp_path):
    lines = ['{"sample_id":"a","task_type":"math","query":"q","expected_answer":"1","split":"dev","metadata":{"k":"v"}}', "", "not json",
             '{"sample_id":"b","task_type":"poetry","query":"q","expected_answer":"1","split":"dev"}', '{"sample_id":" ","task_type":"math","query":"q","expected_answer":"1","split":"dev"}',
             '{"sample_id":"c","task_type":"math","query":" ","expected_answer":"1","split":"dev"}', '{"sample_id":"d","task_type":"math","query":"q","split":"dev"}',
             '{"sample_id":"e","task_type":"gsm8k","query":"q","expected_answer":"1","split":"later"}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    good, bad = SP.validate_samples(SP.read_samples(spark, str(tmp_path / "in.json")))
    assert [(r.sample_id, r.metadata) for r in good.collect()] == [("a", {"k": "v"})]
    reasons = {r.sample_id: r.reject_reason for r in bad.collect()}
    assert reasons == {None: "invalid_json", "b": "unsupported_task_type", " ": "empty_sample_id", "c": "empty_query", "d": "missing:expected_answer", "e": "unsupported_split"}
    SP.write_samples(good, str(tmp_path / "out"))
    again, none = SP.validate_samples(SP.read_samples(spark, str(tmp_path / "out")))
    assert again.count() == 1 and none.isEmpty()
    assert SP.filter_samples(again, "math", "dev", 5).count() == 1 and SP.filter_samples(again, "gsm8k").isEmpty()
    with pytest.raises(ValueError):
        SP.filter_samples(again, "poetry")


def test_splits_restart_their_numbers(spark):
    out = SP.assign_splits(spark.range(9).withColumnRenamed("id", "n"), "n", 3, 2, 2, "x").orderBy("n").collect()
    assert [(r.split, r.sample_id) for r in out] == [("train", "x_train_001"), ("train", "x_train_002"), ("train", "x_train_003"), ("dev", "x_dev_001"), ("dev", "x_dev_002"),
                                                     ("test", "x_test_001"), ("test", "x_test_002")]


def test_old_trace_files_gain_columns(spark, tmp_path):
    path = str(tmp_path / "traces")
    spark.createDataFrame([(1, "s", 256)], "id long, sample_id string, selected_budget int").write.parquet(path)
    TR.append_traces(spark.createDataFrame([(2, "t", 0, None, True)], "id long, sample_id string, selected_budget int, schema_version int, fallback_triggered boolean"), path)
    got = TR.read_traces(spark, path).select("id", "schema_version", "fallback_triggered", "selected_budget_id", "judge_metadata").collect()
    assert [tuple(r) for r in got] == [(1, 2, False, None, "{}"), (2, 2, True, "budget-0", "{}")]


def test_responses_are_reused_and_failures_kept(spark):
    old = spark.createDataFrame([("a", "old", None, 1), ("b", "x", "APIConnectionError", 2)], "request_key string, output_text string, error_type string, write_seq long")
    new = spark.createDataFrame([("a", "new", None, 3)], old.schema)
    answers = GR.upsert_responses(old, new)
    grid = spark.createDataFrame([("a",), ("b",), ("c",)], "request_key string")
    assert {r.request_key: (r.cache_hit, r._resp_text) for r in GR.attach_responses(grid, answers).collect()} == {"a": (True, "new"), "b": (True, "x"), "c": (False, None)}
    grades = spark.createDataFrame([("a", 1.0, True, None)], "request_key string, score double, is_correct boolean, error_type string")
    out = {r.request_key: (r.score, r.is_correct, r.error_type) for r in GR.assemble_traces(grid, answers, grades).collect()}
    assert out == {"a": (1.0, True, None), "b": (0.0, False, "APIConnectionError"), "c": (0.0, False, None)}


def test_replay_takes_the_match_or_the_cheapest(spark):
    rows = [(1, "s", "m1", 0, 0.3, 1.0, True), (2, "s", "m1", 256, 0.1, 2.0, False), (3, "t", "m2", 0, 0.2, 1.0, True), (4, "t", "m1", 0, 0.2, 0.5, True)]
    grid = spark.createDataFrame(rows, "id long, sample_id string, selected_model string, selected_budget int, cost_usd double, latency_s double, is_correct boolean")
    decisions = spark.createDataFrame([("s", "m1", 0), ("t", "m9", 0)], "sample_id string, route_model string, route_budget int")
    got = {r.sample_id: (r.id, r.matched) for r in RP.replay(grid, decisions).collect()}
    assert got == {"s": (1, True), "t": (4, False)}
    summary = RP.replay_router(grid, decisions, "x")[1].first()
    assert summary.match_rate == 0.5 and summary.n == 2 and summary.accuracy == 1.0


def test_sums_do_not_depend_on_order(spark):
    values = [0.1, 1e9, -1e9, 0.2, 0.7] * 200
    got = {spark.createDataFrame([(v,) for v in vs], "x double").repartition(n).agg(S.total("x").alias("s"), S.mean("x").alias("m")).first()
           for vs in (values, values[::-1], sorted(values)) for n in (1, 8, 64)}
    assert got == {(200.0, 0.2)}
    empty = spark.createDataFrame([], "x double").agg(S.total("x").alias("s"), S.mean("x").alias("m")).first()
    assert tuple(empty) == (None, None)


def test_features_count_whole_texts(spark):
    text = "def f(x): return 12 + 3\n\t" + "word " * 50_000 + " é, 9!"
    row = FT.feature_frame(spark.createDataFrame([(text,), (None,), (" \n",)], "query string")).collect()
    assert row[0].char_count == len(text) and row[0].word_count == len(text.split()) and row[0].digit_count == 4
    assert abs(row[0].avg_word_length - sum(map(len, text.split())) / len(text.split())) < 1e-12
    assert [r.word_count for r in row[1:]] == [0, 0]
    vectors = spark.createDataFrame([(1, [0.5, 2.0])], "k long, embedding array<float>")
    out = FT.with_embedding_features(spark.createDataFrame([(1,), (2,)], "k long"), vectors, "k", 3).orderBy("k")
    assert [tuple(r) for r in out.collect()] == [(1, 0.5, 2.0, 0.0), (2, 0.0, 0.0, 0.0)]
    assert out.select(F.sum("semantic_embedding_01")).first()[0] == 2.0


def test_blank_sample_ids_are_never_done(spark):
    from gridstone.operators import grid as GR

    grid = GR.candidate_grid(spark.createDataFrame([("a",), ("\t\n",), ("b",)], "sample_id string"), ["m"], [0, 256])
    traces = spark.createDataFrame([("a", "m", 0), ("\t\n", "m", 0), ("\t\n", "m", 256)], "sample_id string, selected_model string, selected_budget int")
    assert sorted(tuple(r)[:3] for r in GR.pending_grid(grid, traces).select("sample_id", "selected_model", "selected_budget").collect()) == [
        ("\t\n", "m", 0), ("\t\n", "m", 256), ("a", "m", 256), ("b", "m", 0), ("b", "m", 256)]
