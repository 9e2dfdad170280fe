"""Policies, labels and summaries on small hand-made grids."""

from pyspark.sql import functions as F

from gridstone.operators import labels as L
from gridstone.operators import policies as P
from gridstone.operators import summaries as S

SCHEMA = ("id long, sample_id string, query string, task_type string, selected_model string, selected_budget int, "
          "is_correct boolean, error_type string, cost_usd double, latency_s double")


def grid(spark):
    rows = [
        (1, "a", "q1", "gsm8k", "m1", 0, False, "parse_error", 0.001, 1.0),
        (2, "a", "q1", "gsm8k", "m1", 1024, True, None, 0.003, 3.0),
        (3, "b", "q2", "gsm8k", "m1", 0, True, None, 0.001, 1.0),
        (4, "b", "q2", "gsm8k", "m1", 1024, True, None, 0.003, 3.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_policy_table_names_and_accuracy(spark):
    t = {r["policy"]: r for r in P.policy_table(grid(spark)).collect()}
    assert t["fixed_m1_budget_1024"]["accuracy"] == 1.0
    assert t["fixed_budget_0"]["accuracy"] == 0.5
    assert t["oracle_lowest_cost_correct"]["accuracy"] == 1.0
    assert t["oracle_lowest_cost_correct"]["n"] == 2
    assert "aggregate_utility_budget_1024" in t
    assert any(k.startswith("aggregate_utility_safe_fallback_budget_") for k in t)


def test_safe_fallback_replaces_recoverable_rows(spark):
    g = grid(spark)
    primary = g.filter(F.col("selected_budget") == 0)
    out = {r["sample_id"]: r for r in P.safe_fallback(g, primary, F.lit(1024)).collect()}
    assert out["a"]["fallback_triggered"] and out["a"]["selected_budget"] == 1024
    assert out["a"]["fallback_reason"] == "recoverable_error:parse_error"
    assert not out["b"]["fallback_triggered"] and out["b"]["selected_budget"] == 0


def test_best_joint_label_ties_break_deterministically(spark):
    got = {r["sample_id"]: r["selected_budget"] for r in L.best_joint(grid(spark)).collect()}
    assert got == {"a": 1024, "b": 0}


def test_latency_percentiles_match_pandas(spark):
    df = spark.createDataFrame([("t", 1.0), ("t", 2.0), ("t", 3.0)], "task_type string, latency_s double")
    r = S.summarize_latency(df, ["task_type"]).first()
    assert abs(r["p95_latency"] - 2.9) < 1e-12 and r["p50_latency"] == 2.0


def test_single_or_mixed(spark):
    df = spark.createDataFrame([("x", None), ("x", "a"), ("y", "a"), ("y", "b"), ("z", None)], "k string, v string")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(S.single_or_mixed("v").alias("s")).collect()}
    assert got == {"x": "a", "y": "mixed", "z": None}


def test_difficulty_buckets_follow_qcut(spark):
    # five distinct scores -> 2 / 1 / 2 (qcut of first-rank), not ntile's 2 / 2 / 1
    rows = [("a" * i + " x" * i, "gsm8k") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "query string, task_type string")
    got = sorted((r["difficulty_score"], r["difficulty"]) for r in L.difficulty_labels(df).collect())
    assert [d for _, d in got] == ["easy", "easy", "medium", "hard", "hard"]
