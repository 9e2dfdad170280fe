"""Registered queries: routers, replay, calibration, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstone.plans.sql_values import (
    BUDGET_ACCURACY_BONUS, JOINT_BUDGET_BONUS, JOINT_DIFFICULTY_PENALTY, JOINT_MODEL_ACCURACY, JOINT_MODEL_COST_FACTOR,
    TASK_ACCURACY_PENALTY, TASK_LATENCY_MULTIPLIER, TIER_ACCURACY_BASE, TIER_COST_BASE, TIER_LATENCY_BASE, BUDGET_LEVELS,
)
from gridstone.functions import features as FT
from gridstone.operators import grading as G
from gridstone.operators import policies as P
from gridstone.operators import replay as RP
from gridstone.operators import routers as R
from gridstone.plans import sqlfrag as Q
from gridstone.plans.catalog import register
from gridstone.session import cut_lineage
from gridstone.sources.views import FIXTURE_MODELS, grid_view, samples_view

POOL = [R.PoolModel(m, t) for _, m, t, _ in FIXTURE_MODELS]
MODEL_IDS = [m for _, m, _, _ in FIXTURE_MODELS]


def _case(mapping: dict, key: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {Q.lit(k) if isinstance(k, str) else k} THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


FIRSTQ = ("firstq", """SELECT sample_id, query, task_type FROM (
  SELECT sample_id, query, task_type, row_number() OVER (PARTITION BY sample_id ORDER BY id) AS rn FROM grid) WHERE rn = 1""")
THRESH_SQL = f"""
SELECT sample_id, task_type, route_model, route_budget, route_difficulty,
  greatest(0.05, least(0.98, {_case(TIER_ACCURACY_BASE, 'route_tier', '0.78')} + {_case(BUDGET_ACCURACY_BONUS, 'route_budget', '0.08')}
    - d * 0.25 - {_case(TASK_ACCURACY_PENALTY, 'task_type', '0.02')})) AS estimated_accuracy,
  {_case(TIER_COST_BASE, 'route_tier', '0.0008')} * (1 + route_budget / CAST(1024 AS DOUBLE)) AS estimated_cost,
  ({_case(TIER_LATENCY_BASE, 'route_tier', '5.0')} + route_budget / 180.0) * {_case(TASK_LATENCY_MULTIPLIER, 'task_type', '1.0')}
    AS estimated_latency,
  greatest(0.15, 1.0 - abs(d - 0.5)) AS route_confidence
FROM (SELECT *, CASE tier WHEN 'cheap' THEN 'm-cheap' WHEN 'mid' THEN 'm-mid' ELSE 'm-strong' END AS route_model, tier AS route_tier,
        CASE WHEN d >= 0.8 THEN 1024 WHEN d >= 0.4 THEN 256 ELSE 0 END AS route_budget,
        CASE WHEN d < 0.35 THEN 'easy' WHEN d < 0.7 THEN 'medium' ELSE 'hard' END AS route_difficulty
      FROM (SELECT *, CASE WHEN d >= 0.75 OR task_type = 'humaneval' THEN 'strong' WHEN d >= 0.45 OR task_type = 'math' THEN 'mid'
                      ELSE 'cheap' END AS tier
            FROM (SELECT sample_id, task_type, {Q.probe_difficulty('query')} AS d FROM firstq)))
"""
TH_DOUBLES = ["estimated_accuracy", "estimated_cost", "estimated_latency", "route_confidence"]


def sample_queries(spark, sf):
    return samples_view(spark, sf).select("sample_id", "query", "task_type")


def split_grid(spark, sf, split):
    return grid_view(spark, sf).filter(F.col("split") == split)


def threshold_decisions(spark, sf):
    return R.route_threshold(sample_queries(spark, sf), POOL)


@register("threshold_router", THRESH_SQL, TH_DOUBLES, ctes=(FIRSTQ,))
def threshold_router(spark, sf):
    """Threshold decisions for every distinct sample."""
    return threshold_decisions(spark, sf).select(
        "sample_id", "task_type", "route_model", "route_budget", "route_difficulty", *TH_DOUBLES)


CANDS = ", ".join(f"({mi}, {Q.lit(m)}, {b}, {bi}, {mi * len(BUDGET_LEVELS) + bi})"
                  for mi, m in enumerate(MODEL_IDS) for bi, b in enumerate(BUDGET_LEVELS))
JOINT_SQL = f"""
SELECT sample_id, task_type, model_id AS route_model, budget AS route_budget, diff AS route_difficulty, acc AS estimated_accuracy,
  cost AS estimated_cost, lat AS estimated_latency, u AS route_utility FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY u DESC, idx) AS rn FROM (
    SELECT *, 1.0 * acc - 5.0 * cost - 0.02 * lat AS u FROM (
      SELECT s.sample_id, s.task_type, s.diff, c.*,
        greatest(0.0, least(0.98, (CASE WHEN c.mi >= 2 THEN {JOINT_MODEL_ACCURACY[2]} WHEN c.mi = 1 THEN {JOINT_MODEL_ACCURACY[1]}
          ELSE {JOINT_MODEL_ACCURACY[0]} END) + {_case(JOINT_BUDGET_BONUS, 'c.budget', 'NULL')}
          - ({_case(JOINT_DIFFICULTY_PENALTY, 's.diff', 'NULL')} + CASE WHEN s.task_type = 'humaneval' THEN 0.05 ELSE 0.0 END))) AS acc,
        (CASE WHEN c.mi >= 2 THEN {JOINT_MODEL_COST_FACTOR[2]} WHEN c.mi = 1 THEN {JOINT_MODEL_COST_FACTOR[1]} ELSE {JOINT_MODEL_COST_FACTOR[0]} END)
          * (1 + c.budget / CAST(1024 AS DOUBLE)) AS cost,
        0.4 + c.mi * 0.8 + c.budget / CAST(1500 AS DOUBLE) AS lat
      FROM (SELECT sample_id, task_type, {Q.heuristic_difficulty('query')} AS diff FROM firstq) s
      CROSS JOIN (VALUES {CANDS}) AS c(mi, model_id, budget, bi, idx)))) WHERE rn = 1
"""


@register("joint_router", JOINT_SQL, ["estimated_accuracy", "estimated_cost", "estimated_latency", "route_utility"], ctes=(FIRSTQ,))
def joint_router(spark, sf):
    """Joint utility argmax over models × four budgets, per distinct sample."""
    out = R.route_joint(sample_queries(spark, sf), MODEL_IDS)
    return out.select("sample_id", "task_type", "route_model", "route_budget", "route_difficulty", "estimated_accuracy",
                      "estimated_cost", "estimated_latency", "route_utility")


def _replay_sql(dec: str, grid: str = "grid") -> str:
    return f"""
SELECT * FROM (
  SELECT g.*, d.route_confidence, (g.selected_model = d.route_model AND g.selected_budget = d.route_budget) AS matched,
    row_number() OVER (PARTITION BY g.sample_id ORDER BY (g.selected_model = d.route_model AND g.selected_budget = d.route_budget) DESC,
      CASE WHEN NOT (g.selected_model = d.route_model AND g.selected_budget = d.route_budget) THEN g.cost_usd END,
      CASE WHEN NOT (g.selected_model = d.route_model AND g.selected_budget = d.route_budget) THEN g.latency_s END,
      g.selected_budget, g.selected_model, g.id) AS rn
  FROM {grid} g JOIN {dec} d ON g.sample_id = d.sample_id) WHERE rn = 1"""


def _som(c: str) -> str:
    return (f"CASE WHEN count({c}) = 0 THEN NULL WHEN min(CAST({c} AS VARCHAR)) = max(CAST({c} AS VARCHAR)) "
            f"THEN min(CAST({c} AS VARCHAR)) ELSE 'mixed' END")


ROUTER_SUMMARY = f"""
SELECT 'phase2_threshold' AS policy, 'phase2_threshold' AS policy_family, 'threshold' AS router_name,
  avg(CAST(is_correct AS DOUBLE)) AS accuracy, exact_avg(cost_usd) AS avg_cost, exact_sum(cost_usd) AS total_cost, exact_avg(latency_s) AS avg_latency,
  quantile_cont(latency_s, 0.95) AS p95_latency, count(*) AS n,
  {_som('selected_model')} AS selected_model, CAST(NULL AS VARCHAR) AS selected_model_provider, {_som('selected_model_tier')} AS selected_model_tier,
  CAST(NULL AS VARCHAR) AS selected_model_alias, {_som('selected_budget')} AS selected_budget,
  exact_avg(route_confidence) AS avg_route_confidence, 0.0 AS fallback_rate, avg(CAST(matched AS DOUBLE)) AS match_rate
FROM replayed"""


@register("replay_threshold", ROUTER_SUMMARY, ["accuracy", "avg_cost", "total_cost", "avg_latency", "p95_latency",
                                               "avg_route_confidence", "fallback_rate", "match_rate"],
          ctes=(FIRSTQ, ("thr", THRESH_SQL), ("replayed", _replay_sql("thr"))), headline=True)
def replay_threshold(spark, sf):
    """B9 + A4: threshold router replayed against the recorded grid, with the match rate."""
    grid = grid_view(spark, sf)
    _, summ = RP.replay_router(grid, R.route_threshold(sample_queries(spark, sf), POOL), "threshold")
    return summ


@register("replayed_rows", "SELECT sample_id, id, selected_model, selected_budget, matched, cost_usd, latency_s FROM replayed",
          ["cost_usd", "latency_s"], ctes=(FIRSTQ, ("thr", THRESH_SQL), ("replayed", _replay_sql("thr"))))
def replayed_rows(spark, sf):
    """The replayed trace row per sample (exact match, else cheapest)."""
    grid = grid_view(spark, sf)
    sel, _ = RP.replay_router(grid, R.route_threshold(sample_queries(spark, sf), POOL), "threshold")
    return sel.select("sample_id", "id", "selected_model", "selected_budget", "matched", "cost_usd", "latency_s")


@register("replay_without_failed", "SELECT sample_id, id, selected_model, selected_budget, matched, cost_usd, latency_s FROM replayed",
          ["cost_usd", "latency_s"], ctes=(FIRSTQ, ("thr", THRESH_SQL), ("called", "SELECT * FROM grid WHERE NOT (total_tokens = 0 AND error_type IS NOT NULL)"),
                                           ("replayed", _replay_sql("thr", "called"))))
def replay_without_failed(spark, sf):
    """J6 with T4's option: failed calls are no candidates."""
    sel, _ = RP.replay_router(grid_view(spark, sf), R.route_threshold(sample_queries(spark, sf), POOL), "threshold", exclude_failed=True)
    return sel.select("sample_id", "id", "selected_model", "selected_budget", "matched", "cost_usd", "latency_s")


@register("oracle_without_failed", """SELECT sample_id, id, selected_model, selected_budget, cost_usd FROM (SELECT *, row_number() OVER (PARTITION BY sample_id
  ORDER BY is_correct DESC, cost_usd, latency_s, selected_budget, selected_model, id) AS rn FROM grid WHERE NOT (total_tokens = 0 AND error_type IS NOT NULL)) WHERE rn = 1""", ["cost_usd"])
def oracle_without_failed(spark, sf):
    """W5 with T4's option."""
    return P.oracle_policy(grid_view(spark, sf), exclude_failed=True).select("sample_id", "id", "selected_model", "selected_budget", "cost_usd")


# primary = joint router decision, scored with the cheap-probe confidence (a recorded score table)



def primary_decisions(spark, sf):
    grid = grid_view(spark, sf)
    fq = sample_queries(spark, sf)
    j = R.route_joint(fq, MODEL_IDS)
    return j.withColumn("route_confidence", FT.probe_feature_columns("query")[1])


def rule_decisions(spark, sf):
    """Narrow decisions of both rules, written once: the counts of a text are made in one pass and serve both rules, and
    texts are not routed again for every split, sweep and fallback."""
    counted = FT.with_counts(sample_queries(spark, sf), ["sample_id", "task_type"])
    counts = {k: F.col("_n_" + k) for k in FT.COUNT_COLUMNS}
    probe = {c: e for c, e in zip([*FT.SURFACE_COLUMNS, *FT.PROBE_COLUMNS], FT.features_from_counts())}
    one = R.route_threshold(counted, POOL, difficulty=probe["cheap_probe_difficulty"]).withColumnsRenamed(
        {"route_model": "_tm", "route_budget": "_tb", "route_confidence": "_tc", "route_difficulty": "_td", "estimated_accuracy": "_ta", "estimated_cost": "_te", "estimated_latency": "_tl"})
    two = R.route_joint(one, MODEL_IDS, difficulty=FT.heuristic_difficulty(counts=counts)).withColumn("_jc", probe["cheap_probe_confidence"])
    rule = lambda name, m, b, c: F.struct(F.lit(name).alias("router_name"), F.col(m).alias("route_model"), F.col(b).cast("int").alias("route_budget"), F.col(c).cast("double").alias("route_confidence"))
    both = two.select("sample_id", F.explode(F.array(rule("threshold", "_tm", "_tb", "_tc"), rule("joint_rule", "route_model", "route_budget", "_jc"))).alias("d"))
    return cut_lineage(both.select("d.router_name", "sample_id", "d.route_model", "d.route_budget", "d.route_confidence", F.lit(False).alias("fallback_triggered")))


UNC_SQL = """
SELECT t.sample_id, CASE WHEN keep THEN p.route_model ELSE t.route_model END AS route_model,
  CASE WHEN keep THEN p.route_budget ELSE t.route_budget END AS route_budget, p.pconf AS route_confidence,
  NOT keep AS fallback_triggered, CASE WHEN NOT keep THEN 'low_confidence' END AS fallback_reason
FROM (SELECT t.*, coalesce(p.pconf >= 0.55, false) AS keep FROM thr t LEFT JOIN prim p ON t.sample_id = p.sample_id) t
LEFT JOIN prim p ON t.sample_id = p.sample_id"""
PRIM_CTE = ("prim", """SELECT j.sample_id, j.route_model, j.route_budget,
  CAST(greatest(0.05, 1.0 - d * 0.75) AS DOUBLE) AS pconf FROM joint j JOIN (SELECT sample_id, """ + Q.probe_difficulty('query')
            + " AS d FROM firstq) f ON j.sample_id = f.sample_id")


@register("uncertainty_router", UNC_SQL, ["route_confidence"],
          ctes=(FIRSTQ, ("thr", THRESH_SQL), ("joint", JOINT_SQL), PRIM_CTE))
def uncertainty_router(spark, sf):
    """Primary (joint decision + confidence score) kept above .55, else threshold fallback."""
    out = R.route_uncertain(primary_decisions(spark, sf), threshold_decisions(spark, sf))
    return out.select("sample_id", "route_model", "route_budget", "route_confidence", "fallback_triggered", "fallback_reason")


SWEEP_SQL = """
SELECT threshold, avg(CAST(is_correct AS DOUBLE)) AS accuracy, exact_avg(cost_usd) AS avg_cost, exact_sum(cost_usd) AS total_cost,
  exact_avg(latency_s) AS avg_latency, quantile_cont(latency_s, 0.95) AS p95_latency, count(*) AS n,
  avg(CAST(fallback_triggered AS DOUBLE)) AS fallback_rate
FROM (SELECT * FROM (
  SELECT g.*, d.threshold, d.fallback_triggered, row_number() OVER (PARTITION BY g.sample_id, d.threshold ORDER BY
    (g.selected_model = d.route_model AND g.selected_budget = d.route_budget) DESC,
    CASE WHEN NOT (g.selected_model = d.route_model AND g.selected_budget = d.route_budget) THEN g.cost_usd END,
    CASE WHEN NOT (g.selected_model = d.route_model AND g.selected_budget = d.route_budget) THEN g.latency_s END,
    g.selected_budget, g.selected_model, g.id) AS rn
  FROM grid g JOIN dec d ON g.sample_id = d.sample_id WHERE g.split = 'dev') WHERE rn = 1)
GROUP BY threshold"""
DEC_CTE = ("dec", """SELECT t.sample_id, th.threshold,
  CASE WHEN coalesce(p.pconf >= th.threshold, false) THEN p.route_model ELSE t.route_model END AS route_model,
  CASE WHEN coalesce(p.pconf >= th.threshold, false) THEN p.route_budget ELSE t.route_budget END AS route_budget,
  NOT coalesce(p.pconf >= th.threshold, false) AS fallback_triggered
FROM thr t CROSS JOIN (VALUES (0.55), (0.65), (0.75), (0.85)) AS th(threshold) LEFT JOIN prim p ON t.sample_id = p.sample_id""")


@register("threshold_sweep",
          f"SELECT *, {Q.summary_utility(latency='p95')} AS utility, "
          f"threshold = first_value(threshold) OVER (ORDER BY {Q.summary_utility(latency='p95')} DESC, threshold) AS is_best FROM ({SWEEP_SQL})",
          ["threshold", "accuracy", "avg_cost", "total_cost", "avg_latency", "p95_latency", "fallback_rate", "utility"],
          ctes=(FIRSTQ, ("thr", THRESH_SQL), ("joint", JOINT_SQL), PRIM_CTE, DEC_CTE))
def threshold_sweep(spark, sf):
    """Confidence-threshold sweep on the dev split in one job; first best p95 utility marked."""
    decisions = rule_decisions(spark, sf)
    of = lambda name: decisions.where(F.col("router_name") == name)
    return RP.sweep_thresholds(split_grid(spark, sf, "dev"), of("joint_rule"), of("threshold"))


# predictions (B10/B12 "given predictions"): the threshold rule's budget for every (sample, model)
PRED_CTE = ("pred", "SELECT g.sample_id, g.selected_model, t.route_budget AS predicted_budget FROM (SELECT DISTINCT sample_id, "
                    "selected_model FROM grid) g JOIN thr t ON g.sample_id = t.sample_id")


def predictions(spark, sf):
    grid = grid_view(spark, sf)
    thr = R.route_threshold(sample_queries(spark, sf), POOL).select("sample_id", F.col("route_budget").alias("predicted_budget"))
    pairs = grid.select("sample_id", "selected_model").distinct()
    return pairs.join(thr, "sample_id")


POLICY_REPLAY_SQL = """
SELECT * FROM (
  SELECT g.*, p.predicted_budget, row_number() OVER (PARTITION BY g.sample_id, g.selected_model ORDER BY
    (g.selected_budget = p.predicted_budget) DESC, CASE WHEN g.selected_budget <> p.predicted_budget THEN g.cost_usd END,
    CASE WHEN g.selected_budget <> p.predicted_budget THEN g.latency_s END, g.selected_budget, g.id) AS rn
  FROM grid g JOIN pred p ON g.sample_id = p.sample_id AND g.selected_model = p.selected_model) WHERE rn = 1"""


@register("policy_replay",
          f"SELECT 'learned_policy' AS policy, {Q.METRICS} FROM polrep",
          Q.METRIC_DOUBLES, ctes=(FIRSTQ, ("thr", THRESH_SQL), PRED_CTE, ("polrep", POLICY_REPLAY_SQL)))
def policy_replay(spark, sf):
    """Per-(sample, model) budget policy replayed (raw mode)."""
    from gridstone.operators.summaries import summarize_selection

    return summarize_selection(RP.replay_policy(grid_view(spark, sf), predictions(spark, sf), None, safe=False), "learned_policy")


@register("calibration",
          f"""SELECT CASE WHEN starts_with(policy, 'fixed_budget_') THEN 'fallback_to_calibrated_fixed_budget' ELSE 'raw_learned_policy' END
  AS calibration_policy, starts_with(policy, 'fixed_budget_') AS safe_mode,
  CASE WHEN starts_with(policy, 'fixed_budget_') THEN CAST(replace(policy, 'fixed_budget_', '') AS INTEGER) END AS fallback_budget,
  utility AS calibration_utility, accuracy AS calibration_accuracy, avg_cost AS calibration_avg_cost, avg_latency AS calibration_avg_latency
FROM (SELECT *, {Q.summary_utility()} AS utility FROM (
  SELECT 'learned_policy_raw' AS policy, {Q.METRICS} FROM polrep WHERE split = 'dev'
  UNION ALL SELECT concat('fixed_budget_', CAST(selected_budget AS VARCHAR)), {Q.METRICS} FROM grid WHERE split = 'dev' GROUP BY selected_budget))
ORDER BY utility DESC, accuracy DESC, avg_cost, policy LIMIT 1""",
          ["calibration_utility", "calibration_accuracy", "calibration_avg_cost", "calibration_avg_latency"],
          ctes=(FIRSTQ, ("thr", THRESH_SQL), PRED_CTE, ("polrep", POLICY_REPLAY_SQL)))
def calibration(spark, sf):
    """Calibrate the budget policy on the dev table against every fixed budget."""
    return RP.calibrate(split_grid(spark, sf, "dev"), predictions(spark, sf))


@register("confidence_bands",
          """SELECT band AS confidence_band, count(*) AS n FROM (SELECT CASE WHEN route_confidence > -0.001 AND route_confidence <= 0.25
  THEN 'very_low' WHEN route_confidence > 0.25 AND route_confidence <= 0.5 THEN 'low' WHEN route_confidence > 0.5 AND
  route_confidence <= 0.75 THEN 'medium' WHEN route_confidence > 0.75 AND route_confidence <= 1.0 THEN 'high' END AS band FROM thr)
GROUP BY band""", ctes=(FIRSTQ, ("thr", THRESH_SQL)))
def confidence_bands(spark, sf):
    """Confidence bands of the routing decisions."""
    d = threshold_decisions(spark, sf)
    return d.groupBy(G.confidence_band(F.col("route_confidence")).alias("confidence_band")).agg(F.count(F.lit(1)).alias("n"))
