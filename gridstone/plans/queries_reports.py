"""Registered queries: report tables and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstone.functions import features as FT
from gridstone.operators import policies as P
from gridstone.operators import replay as RP
from gridstone.operators import reports as RE
from gridstone.operators import routers as R
from gridstone.plans import sqlfrag as Q
from gridstone.plans.catalog import register
from gridstone.plans.queries_core import POLICY_CTES
from gridstone.operators import selection as SE
from gridstone.plans.queries_more import (
    FIRSTQ, JOINT_SQL, MODEL_IDS, POOL, PRIM_CTE, ROUTER_SUMMARY, THRESH_SQL, _replay_sql, _som, rule_decisions, sample_queries, split_grid)
from gridstone.plans.queries_text import FAIL_CTES
from gridstone.plans.sql_values import ABLATION_GROUPS
from gridstone.plans.queries_core import REGISTRY_BASELINE_SQL
from gridstone.session import cut_lineage
from gridstone.sources.views import grid_view, trace_log_view

M = "accuracy, avg_cost, total_cost, avg_latency, p95_latency, n"
DOUBLES = [*Q.METRIC_DOUBLES, "avg_route_confidence", "fallback_rate", "match_rate", "utility"]


def _metric_rows(rows: str, level: str) -> str:
    return f"SELECT benchmark, {level}, {Q.METRICS} FROM {rows} GROUP BY ALL"


def _best(level: str) -> str:
    return (f"(SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY {Q.summary_utility()} DESC, accuracy DESC, avg_cost, "
            f"selected_model NULLS LAST, selected_budget NULLS LAST) AS place FROM {level}) WHERE place = 1")


def _replay_all(grid: str, decisions: str) -> str:
    hit = "(g.selected_model = d.route_model AND g.selected_budget = d.route_budget)"
    return f"""SELECT * FROM (SELECT g.*, d.router_name, d.threshold, d.route_confidence, d.fallback_triggered, {hit} AS matched,
  row_number() OVER (PARTITION BY g.sample_id, d.router_name, d.threshold ORDER BY {hit} DESC, CASE WHEN NOT {hit} THEN g.cost_usd END,
    CASE WHEN NOT {hit} THEN g.latency_s END, g.selected_budget, g.selected_model, g.id) AS rn
  FROM {grid} g JOIN {decisions} d ON g.sample_id = d.sample_id) WHERE rn = 1"""


def _router_rows(rows: str) -> str:
    return f"""SELECT *, {Q.summary_utility(latency='p95')} AS utility FROM (
  SELECT task_type AS benchmark, router_name, threshold, {Q.METRICS}, {_som('selected_model')} AS selected_model, {_som('selected_model_tier')} AS selected_model_tier,
    {_som('selected_budget')} AS selected_budget, exact_avg(route_confidence) AS avg_route_confidence, avg(CAST(fallback_triggered AS DOUBLE)) AS fallback_rate,
    avg(CAST(matched AS DOUBLE)) AS match_rate FROM {rows} GROUP BY task_type, router_name, threshold)"""


def _unsure(thresholds: str, primary: str) -> str:
    """The uncertainty-aware router over the decision table ``scores`` at the thresholds of a (sample_id, threshold) table."""
    return f"""SELECT 'uncertainty_aware' AS router_name, f.sample_id, CASE WHEN keep THEN p.route_model ELSE f.route_model END AS route_model,
  CASE WHEN keep THEN p.route_budget ELSE f.route_budget END AS route_budget, coalesce(p.route_confidence, CASE WHEN p.sample_id IS NULL THEN f.route_confidence END) AS route_confidence,
  NOT keep AS fallback_triggered, f.threshold
FROM (SELECT f.*, t.threshold, coalesce(p.route_confidence >= t.threshold, false) AS keep FROM scores f JOIN {thresholds} t ON t.sample_id = f.sample_id
  LEFT JOIN scores p ON p.sample_id = f.sample_id AND p.router_name = '{primary}' WHERE f.router_name = 'threshold') f
LEFT JOIN scores p ON p.sample_id = f.sample_id AND p.router_name = '{primary}'"""


def selection_ctes(primary: str, candidates: tuple[str, ...]) -> tuple:
    """B14 from the decision table ``scores`` and the grid, up to the selection and the integrated test summary."""
    place = "CASE router_name " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(candidates)) + " END"
    plain = "SELECT router_name, sample_id, route_model, route_budget, route_confidence, fallback_triggered, CAST(NULL AS DOUBLE) AS threshold FROM scores"
    failed = "coalesce(p.error_type, '') IN ('parse_error', 'execution_error', 'timeout', 'empty_output', 'malformed_answer')"
    return (
        ("devgrid", "SELECT * FROM grid WHERE split = 'dev'"), ("testgrid", "SELECT *, task_type AS benchmark FROM grid WHERE split = 'test'"),
        ("sweep", "SELECT sample_id, unnest([0.55, 0.65, 0.75, 0.85])::DOUBLE AS threshold FROM (SELECT DISTINCT sample_id FROM devgrid)"),
        ("devdec", f"{plain} UNION ALL {_unsure('sweep', primary)}"), ("devsel", _replay_all("devgrid", "devdec")), ("devrows", _router_rows("devsel")),
        ("devbest", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, router_name ORDER BY utility DESC, threshold) AS t FROM devrows) WHERE t = 1"),
        ("picked", f"""SELECT d.benchmark, router_name AS official_router_name, concat('phase2_', router_name) AS official_router_policy, u.threshold AS uncertainty_threshold, utility AS dev_utility
FROM (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY utility DESC, accuracy DESC, avg_cost, {place}) AS rn FROM devbest WHERE {place} IS NOT NULL) d
LEFT JOIN (SELECT benchmark, threshold FROM devbest WHERE router_name = 'uncertainty_aware') u ON u.benchmark = d.benchmark WHERE rn = 1"""),
        ("atbest", "SELECT DISTINCT g.sample_id, p.uncertainty_threshold AS threshold FROM testgrid g JOIN picked p ON p.benchmark = g.task_type"),
        ("testdec", f"{plain} UNION ALL {_unsure('atbest', primary)}"),
        ("testsel", f"SELECT r.*, r.router_name = p.official_router_name AS is_official FROM ({_replay_all('testgrid', 'testdec')}) r JOIN picked p ON p.benchmark = r.task_type"),
        ("mb", _metric_rows("testgrid", "selected_model, selected_budget")), ("mo", _metric_rows("testgrid", "selected_model, CAST(NULL AS INT) AS selected_budget")),
        ("bo", _metric_rows("testgrid", "CAST(NULL AS VARCHAR) AS selected_model, selected_budget")),
        ("mbest", f"SELECT * FROM {_best('mb')}"), ("bbest", f"SELECT * FROM {_best('bo')}"),
        ("saferows", f"""SELECT p.benchmark, CASE WHEN f.id IS NOT NULL AND {failed} THEN f.is_correct ELSE p.is_correct END AS is_correct,
  CASE WHEN f.id IS NOT NULL AND {failed} THEN f.cost_usd ELSE p.cost_usd END AS cost_usd, CASE WHEN f.id IS NOT NULL AND {failed} THEN f.latency_s ELSE p.latency_s END AS latency_s,
  CASE WHEN f.id IS NOT NULL AND {failed} THEN f.id ELSE p.id END AS id, CASE WHEN f.id IS NOT NULL AND {failed} THEN f.selected_model_tier ELSE p.selected_model_tier END AS tier
FROM testgrid p JOIN mbest m ON m.benchmark = p.benchmark AND m.selected_model = p.selected_model AND m.selected_budget = p.selected_budget
LEFT JOIN (SELECT g.*, row_number() OVER (PARTITION BY g.sample_id ORDER BY g.cost_usd, g.latency_s, g.selected_model, g.id) AS rn FROM testgrid g JOIN bbest b
  ON b.benchmark = g.benchmark AND b.selected_budget = g.selected_budget) f ON f.sample_id = p.sample_id AND f.rn = 1"""),
        ("tier", "SELECT benchmark, selected_model, min(selected_model_tier) AS tier FROM testgrid GROUP BY ALL"),
        ("families", f"""
SELECT mb.benchmark, concat('fixed_model_budget_', mb.selected_model, '_', CAST(selected_budget AS VARCHAR)) AS policy, 'fixed_model_budget' AS policy_family,
  mb.selected_model, tier, CAST(selected_budget AS VARCHAR) AS selected_budget, {M} FROM mb JOIN tier ON tier.benchmark = mb.benchmark AND tier.selected_model = mb.selected_model
UNION ALL SELECT o.benchmark, concat('model_only_best_', o.selected_model), 'model_only', o.selected_model, tier, NULL, {M} FROM (SELECT * FROM {_best('mo')}) o JOIN tier ON tier.benchmark = o.benchmark AND tier.selected_model = o.selected_model
UNION ALL SELECT benchmark, concat('budget_only_best_', CAST(selected_budget AS VARCHAR)), 'budget_only', NULL, NULL, CAST(selected_budget AS VARCHAR), {M} FROM bbest
UNION ALL SELECT o.benchmark, concat('aggregate_utility_', o.selected_model, '_', CAST(selected_budget AS VARCHAR)), 'joint_aggregate_utility', o.selected_model, tier, CAST(selected_budget AS VARCHAR), {M}
  FROM mbest o JOIN tier ON tier.benchmark = o.benchmark AND tier.selected_model = o.selected_model
UNION ALL SELECT m.benchmark, concat('aggregate_utility_safe_fallback_', m.selected_model, '_', CAST(m.selected_budget AS VARCHAR), '_to_', CAST(b.selected_budget AS VARCHAR)), 'joint_safe_fallback',
  m.selected_model, s.tier, CAST(m.selected_budget AS VARCHAR), s.accuracy, s.avg_cost, s.total_cost, s.avg_latency, s.p95_latency, s.n
  FROM mbest m JOIN bbest b ON b.benchmark = m.benchmark JOIN (SELECT benchmark, arg_min(tier, id) FILTER (tier IS NOT NULL) AS tier, {Q.METRICS} FROM saferows GROUP BY benchmark) s ON s.benchmark = m.benchmark"""),
        ("integ", f"""SELECT benchmark, policy, policy_family, CAST(NULL AS VARCHAR) AS router_name, selected_model, CAST(NULL AS VARCHAR) AS selected_model_provider, tier AS selected_model_tier,
  CAST(NULL AS VARCHAR) AS selected_model_alias, selected_budget, {M}, CAST(NULL AS DOUBLE) AS avg_route_confidence, CAST(NULL AS DOUBLE) AS fallback_rate, CAST(NULL AS DOUBLE) AS match_rate,
  {Q.summary_utility(latency='p95')} AS utility FROM families
UNION ALL SELECT benchmark, concat('phase2_', router_name), concat('phase2_', router_name), router_name, selected_model, NULL, selected_model_tier, NULL, selected_budget, {M},
  avg_route_confidence, fallback_rate, match_rate, utility FROM ({_router_rows('testsel')})"""))


#: The rule routers: the threshold rule, the joint rule with the probe's confidence, and the uncertainty-aware one over both.
RULE_CANDIDATES = ("threshold", "joint_rule", SE.UNCERTAIN)
RULE_CTES = (FIRSTQ, ("thr", THRESH_SQL), ("joint", JOINT_SQL), PRIM_CTE, (
    "scores", """SELECT 'threshold' AS router_name, sample_id, route_model, route_budget, route_confidence, false AS fallback_triggered FROM thr
UNION ALL SELECT 'joint_rule', sample_id, route_model, route_budget, pconf, false FROM prim"""), *selection_ctes("joint_rule", RULE_CANDIDATES))


def _official(spark, sf, decisions, primary, candidates):
    """The selection table (written: it is read several times) and all routers' replayed test rows."""
    selection = cut_lineage(SE.select_on_dev(split_grid(spark, sf, "dev"), decisions, primary, candidates))
    return selection, SE.replay_on_test(split_grid(spark, sf, "test"), decisions, selection, primary)


def _rules(spark, sf):
    return _official(spark, sf, rule_decisions(spark, sf), "joint_rule", RULE_CANDIDATES)


def _summary(spark, sf, selected):
    return SE.integrated_summary(split_grid(spark, sf, "test"), selected)


@register("router_selection", "SELECT * FROM picked", ["uncertainty_threshold", "dev_utility"], ctes=RULE_CTES)
def router_selection(spark, sf):
    """B14 over the rule routers: threshold sweep and choice per benchmark on the dev split."""
    return SE.select_on_dev(split_grid(spark, sf, "dev"), rule_decisions(spark, sf), "joint_rule", RULE_CANDIDATES)


@register("integrated_summary", "SELECT * FROM integ", DOUBLES, ctes=RULE_CTES)
def integrated_summary(spark, sf):
    """Per-benchmark summary of the test split: all baseline families and the rule routers, with the official utility."""
    return _summary(spark, sf, _rules(spark, sf)[1])


FINAL_SQL = """
SELECT l.benchmark, l.policy AS official_rule_policy, l.router_name AS official_router_name, l.accuracy, l.avg_cost, l.p95_latency, l.utility,
  f.policy AS strongest_fixed_policy, f.utility AS strongest_fixed_utility, a.policy AS aggregate_policy, a.utility AS aggregate_utility,
  (f.avg_cost - l.avg_cost) / greatest(f.avg_cost, 1e-9) AS cost_reduction_vs_strongest_fixed,
  f.accuracy - l.accuracy AS accuracy_drop_vs_strongest_fixed,
  l.utility > f.utility AS beats_strongest_fixed, l.utility > a.utility AS beats_aggregate_baseline
FROM (SELECT i.* FROM integ i JOIN picked p ON p.benchmark = i.benchmark AND p.official_router_policy = i.policy) l
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY utility DESC, accuracy DESC, avg_cost, policy) AS rn
                     FROM integ WHERE policy_family = 'fixed_model_budget') WHERE rn = 1) f ON l.benchmark = f.benchmark
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY utility DESC, policy) AS rn
                     FROM integ WHERE policy_family = 'joint_aggregate_utility') WHERE rn = 1) a ON l.benchmark = a.benchmark
"""
FINAL_DOUBLES = ["accuracy", "avg_cost", "p95_latency", "utility", "strongest_fixed_utility", "aggregate_utility",
                 "cost_reduction_vs_strongest_fixed", "accuracy_drop_vs_strongest_fixed"]


def _final(spark, sf):
    selection, selected = _rules(spark, sf)
    return RE.final_comparison(_summary(spark, sf, selected), selection, "rule")


@register("final_comparison", FINAL_SQL, FINAL_DOUBLES, ctes=RULE_CTES, headline=True)
def final_comparison(spark, sf):
    """Q1 for the rule routers: the one picked on dev vs strongest fixed vs aggregate for every benchmark at once."""
    return _final(spark, sf)


@register("win_list", f"""SELECT coalesce(array_to_string(list_sort(list(benchmark)), ','), '') AS winning_benchmarks, count(*) AS n_wins
FROM ({FINAL_SQL}) WHERE beats_strongest_fixed AND beats_aggregate_baseline""", ctes=RULE_CTES)
def win_list(spark, sf):
    """Q2."""
    return RE.win_list(_final(spark, sf)).withColumn("winning_benchmarks", F.coalesce("winning_benchmarks", F.lit("")))


@register("final_failures", """SELECT r.task_type AS benchmark, c.failure_class, coalesce(r.error_type, 'none') AS error_type, count(*) AS count,
  exact_avg(r.cost_usd) AS avg_cost,
  exact_avg(r.latency_s) AS avg_latency
FROM testsel r JOIN classified c ON r.id = c.id WHERE r.is_official AND NOT r.is_correct GROUP BY ALL""",
          ["avg_cost", "avg_latency"], ctes=(*RULE_CTES, *FAIL_CTES))
def final_failures(spark, sf):
    """Q3: cross-benchmark failure summary of the test rows that the picked rule routers chose: class from the output
    and recorded error type (T5)."""
    return RE.failure_summary(_rules(spark, sf)[1], split_grid(spark, sf, "test"))


ABL_CASE = "CASE policy_family " + " ".join(f"WHEN {Q.lit(k)} THEN {Q.lit(v)}" for k, v in
                                            ABLATION_GROUPS.items()) \
    + " ELSE policy_family END"


@register("ablation_table", f"""SELECT benchmark, policy, policy_family, {ABL_CASE} AS ablation_group,
  round(accuracy * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS accuracy,
  round(avg_cost * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS avg_cost,
  round(avg_latency * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS avg_latency,
  round(utility * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS utility FROM integ""",
          ["accuracy", "avg_cost", "avg_latency", "utility"], ctes=RULE_CTES)
def ablation_table(spark, sf):
    """Q4."""
    return RE.ablation_table(integrated_summary(spark, sf))


@register("pareto_points", """SELECT benchmark, policy, policy_family, avg_cost, accuracy,
  max(accuracy) OVER (PARTITION BY benchmark ORDER BY avg_cost RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > accuracy AS is_dominated
FROM integ""", ["avg_cost", "accuracy"], ctes=RULE_CTES)
def pareto_points(spark, sf):
    """Q5: the data behind the cost–accuracy plot, with dominance."""
    return RE.pareto_points(integrated_summary(spark, sf))


RANK_INPUT = f"""
SELECT policy, policy_family, CAST(NULL AS VARCHAR) AS router_name, selected_model, selected_model_tier,
  CAST(selected_budget AS VARCHAR) AS selected_budget, accuracy, avg_cost, avg_latency,
  CAST(NULL AS DOUBLE) AS avg_route_confidence, CAST(NULL AS DOUBLE) AS fallback_rate FROM ({REGISTRY_BASELINE_SQL})
UNION ALL
SELECT policy, policy_family, router_name, selected_model, selected_model_tier, selected_budget, accuracy, avg_cost, avg_latency,
  avg_route_confidence, fallback_rate FROM ({ROUTER_SUMMARY})"""
RANK_SQL = f"""
SELECT policy, policy_family, router_name, selected_model, selected_model_tier, selected_budget,
  round(accuracy * 1e6::DOUBLE) / 1e6::DOUBLE AS accuracy, round(avg_cost * 1e6::DOUBLE) / 1e6::DOUBLE AS avg_cost,
  round(avg_latency * 1e6::DOUBLE) / 1e6::DOUBLE AS avg_latency,
  round(avg_route_confidence * 1e6::DOUBLE) / 1e6::DOUBLE AS avg_route_confidence,
  round(fallback_rate * 1e6::DOUBLE) / 1e6::DOUBLE AS fallback_rate, round(utility * 1e6::DOUBLE) / 1e6::DOUBLE AS utility,
  rank_overall, rank_in_phase2, rank_overall = 1 AS is_best_overall, rank_in_phase2 = 1 AS is_best_phase2
FROM (SELECT *, row_number() OVER (ORDER BY utility DESC, accuracy DESC, avg_cost, policy) AS rank_overall,
        CASE WHEN starts_with(policy_family, 'phase2_') THEN row_number() OVER (PARTITION BY starts_with(policy_family, 'phase2_')
          ORDER BY utility DESC, accuracy DESC, avg_cost, policy) END AS rank_in_phase2
      FROM (SELECT *, {Q.summary_utility()} AS utility FROM rank_input))"""


@register("evaluation_bundle", RANK_SQL,
          ["accuracy", "avg_cost", "avg_latency", "avg_route_confidence", "fallback_rate", "utility"],
          ctes=POLICY_CTES + (("tiers", "SELECT selected_model, min(selected_model_tier) AS tier FROM grid GROUP BY selected_model"),
                              FIRSTQ, ("thr", THRESH_SQL), ("replayed", _replay_sql("thr")), ("rank_input", RANK_INPUT)))
def evaluation_bundle(spark, sf):
    """W7 + Q6: baselines and the replayed router ranked by utility, best rows flagged."""
    grid = grid_view(spark, sf)
    base = P.baseline_table(grid).select(
        "policy", "policy_family", F.lit(None).cast("string").alias("router_name"), "selected_model", "selected_model_tier",
        F.col("selected_budget").cast("string").alias("selected_budget"), "accuracy", "avg_cost", "avg_latency",
        F.lit(None).cast("double").alias("avg_route_confidence"), F.lit(None).cast("double").alias("fallback_rate"))
    _, summ = RP.replay_router(grid, R.route_threshold(sample_queries(spark, sf), POOL), "threshold")
    summ = summ.select("policy", "policy_family", "router_name", "selected_model", "selected_model_tier", "selected_budget",
                       "accuracy", "avg_cost", "avg_latency", "avg_route_confidence", "fallback_rate")
    return RE.rank_policies(base.unionByName(summ))


BOOT_B = 1000


def _poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= {t!r} THEN 1 ELSE 0 END" for t in RE.poisson1_thresholds()) + ")"


BOOT_U = "CAST(('0x' || substr(md5(concat_ws(':', '0', CAST(rep AS VARCHAR), k)), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
BOOT_CTES = (
    ("bx", "SELECT selected_model, CAST(id AS VARCHAR) AS k, CAST(is_correct AS DOUBLE) AS v FROM trace_log WHERE is_correct IS NOT NULL"),
    ("br", f"SELECT bx.*, rep FROM bx, range(0, {BOOT_B}) t(rep)"),
    ("bw", f"SELECT *, {_poisson_sql('u')} AS wt FROM (SELECT *, {BOOT_U} AS u FROM br)"),
    ("bm", "SELECT selected_model, rep, sum(wt * v) / sum(wt) AS mm FROM bw GROUP BY selected_model, rep HAVING sum(wt) > 0"),
    ("bc", "SELECT selected_model, list_sort(list(mm)) AS ms FROM bm GROUP BY selected_model"),
)
BOOT_SQL = f"""SELECT a.selected_model, a.mean, list_extract(bc.ms, {int(__import__('math').floor(0.025 * (BOOT_B - 1))) + 1}) AS lower,
  list_extract(bc.ms, {int(__import__('math').ceil(0.975 * (BOOT_B - 1))) + 1}) AS upper
FROM (SELECT selected_model, avg(v) AS mean FROM bx GROUP BY selected_model) a LEFT JOIN bc ON a.selected_model = bc.selected_model"""


@register("bootstrap_accuracy", BOOT_SQL, ["mean", "lower", "upper"], ctes=BOOT_CTES)
def bootstrap_accuracy(spark, sf):
    """Bootstrap CI of accuracy per model over the whole trace log (B = 1000), each trace drawn in each replicate."""
    return RE.bootstrap_ci(trace_log_view(spark, sf), "is_correct", ["selected_model"], b=BOOT_B, key="id")
