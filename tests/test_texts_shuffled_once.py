"""Texts cross one shuffle on their way to the labels, markers are found by bytes, and a sweep routes and replays once."""

from pyspark.sql import functions as F

from gridstone.config import SURFACE_CODE_MARKERS
from gridstone.functions import features as FT
from gridstone.operators import labels as L
from gridstone.operators import replay as RP

ROWS = [("solve 1 + 2", "math"), ("solve 1 + 2", None), ("solve 1 + 2", ""), ("solve 1 + 2", "math"), (None, "math"), (None, None), ("null", None), ("", "math"),
        ("def f(x): return 3 ", "custom"), ("İmport é ```", "math")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def labelled(spark):
    some = spark.createDataFrame([(t, k, i) for i, (t, k) in enumerate(ROWS)], "query string, task_type string, id int")
    grid = some.select("*", F.explode(F.array(*map(F.lit, (0, 256)))).alias("selected_budget")).withColumns(
        {"selected_model": F.lit("m"), "is_correct": F.col("selected_budget") > 0, "cost_usd": F.lit(1.0), "latency_s": F.lit(1.0)})
    return some, grid


def test_a_text_is_joined_where_its_group_is(spark):
    some, grid = labelled(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for task in (F.col("task_type"), F.coalesce("task_type", F.lit("custom"))):  # a task that may be null, and one that never is
            texts = L._texts(some.withColumn("task_type", task))
            narrow = grid.select(L.text_key("query").alias("_key"), task.alias("task_type"))
            assert plan(L._with_text(narrow, texts)).count("Exchange hashpartitioning") == 2  # one of the texts, one of the narrow rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_labels_of_null_texts_and_tasks(spark):
    some, grid = labelled(spark)
    distinct = sorted(map(str, set(ROWS)))
    want = sorted(str(tuple(r)) for r in L.best_budget(grid).select("query", "task_type").collect())
    assert want == distinct
    keyed = L.best_budget(grid.withColumn("query", L.text_key("query")), queries=some)
    assert sorted(map(str, keyed.collect())) == sorted(map(str, L.best_budget(grid).collect()))
    alone = L.difficulty_labels(some)
    assert sorted(str((r.query, r.task_type)) for r in alone.collect()) == distinct
    score = {(r.query, r.task_type): r.s for r in some.select("query", "task_type", L.difficulty_score(some).alias("s")).collect()}
    assert all(r.difficulty_score == score[r.query, r.task_type] for r in alone.collect())


def test_scores_are_made_before_the_shuffle(spark):
    some, _ = labelled(spark)
    text = plan(L._scored(some))
    assert "query" not in text[:text.index("Exchange")]  # above the shuffle no row holds a text


def test_markers_are_found_by_bytes(spark):
    texts = [t for t, _ in ROWS] + ["DEF x", "def", "``` class\treturn", "日本 import 日本", "a" * 50 + "assert"]
    df = spark.createDataFrame([(t,) for t in texts], "query string")
    got = df.select("query", FT.marker_count(F.lower(F.coalesce("query", F.lit(""))), SURFACE_CODE_MARKERS).alias("n"))
    assert {(r.query, r.n) for r in got.collect()} == {(t, sum(m in (t or "").lower() for m in SURFACE_CODE_MARKERS)) for t in texts}
    assert "instr" not in plan(got)


def test_a_sweep_is_replayed_once(spark):
    grid = spark.createDataFrame([(i, f"s{i % 3}", "q", "m", b, i % 2 == 0, 1.0, float(i), "o") for i, b in enumerate([0, 256, 1024] * 3)],
                                 "id int, sample_id string, query string, selected_model string, selected_budget int, is_correct boolean, cost_usd double, latency_s double, output_text string")
    route = lambda b, c: spark.createDataFrame([(f"s{i}", "m", b, c, False) for i in range(3)], "sample_id string, route_model string, route_budget int, route_confidence double, fallback_triggered boolean")
    out = RP.sweep_thresholds(grid, route(0, 0.7), route(256, 0.5))
    assert "min_by" not in plan(out) and "percentile" not in plan(out)
    rows = {r.threshold: r for r in out.collect()}
    assert len(rows) == 4 and sum(r.is_best for r in rows.values()) == 1 and [rows[t].fallback_rate for t in sorted(rows)] == [0.0, 0.0, 1.0, 1.0]
