"""Registered queries: grid jobs, dimensions, learned routers, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstone.config import BUDGET_LEVELS
from gridstone.functions import budgets as BU
from gridstone.operators import grid as GR
from gridstone.operators import routers as R
from gridstone.plans import sqlfrag as Q
from gridstone.operators.summaries import total
from gridstone.plans.catalog import register
from gridstone.plans.queries_more import FIRSTQ, THRESH_SQL, sample_queries
from gridstone.sources.views import FIXTURE_MODELS, grid_view, samples_view, table, trace_log_view

MODELS = [m for _, m, _, _ in FIXTURE_MODELS]
SIG = GR.signature(MODELS, BUDGET_LEVELS)
CAND_VALUES = ", ".join(f"({Q.lit(m)}, {b})" for m in MODELS for b in BUDGET_LEVELS)


@register("candidate_grid", f"""SELECT split, selected_model, selected_budget, candidate_set_signature, count(*) AS n FROM (
  SELECT s.split, c.selected_model, c.selected_budget, {Q.lit(SIG)} AS candidate_set_signature FROM samples s
  CROSS JOIN (VALUES {CAND_VALUES}) AS c(selected_model, selected_budget)) GROUP BY ALL""")
def candidate_grid(spark, sf):
    """Every sample × model × budget level (counts per split and candidate)."""
    g = GR.candidate_grid(samples_view(spark, sf).select("sample_id", "split"), MODELS, BUDGET_LEVELS)
    return g.groupBy("split", "selected_model", "selected_budget", "candidate_set_signature").agg(F.count(F.lit(1)).alias("n"))


@register("pending_grid", f"""SELECT c.sample_id, c.selected_model, c.selected_budget FROM (
  SELECT s.sample_id, c.selected_model, c.selected_budget FROM samples s CROSS JOIN (VALUES {CAND_VALUES}) AS c(selected_model, selected_budget)) c
WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.sample_id = c.sample_id AND g.selected_model = c.selected_model
                  AND g.selected_budget = c.selected_budget AND length(trim(g.sample_id)) > 0)""")
def pending_grid(spark, sf):
    """Resume — candidates not yet traced (left anti join on the three keys)."""
    cand = GR.candidate_grid(samples_view(spark, sf).select("sample_id"), MODELS, BUDGET_LEVELS)
    return GR.pending_grid(cand, grid_view(spark, sf)).select("sample_id", "selected_model", "selected_budget")


CLAMP_SQL = ("CASE WHEN abs(x - 0) <= abs(x - 256) AND abs(x - 0) <= abs(x - 1024) AND abs(x - 0) <= abs(x - 4096) THEN 0 "
             "WHEN abs(x - 256) <= abs(x - 1024) AND abs(x - 256) <= abs(x - 4096) THEN 256 "
             "WHEN abs(x - 1024) <= abs(x - 4096) THEN 1024 ELSE 4096 END")


@register("budget_clamp", f"""SELECT clamped_budget, repaired_budget, count(*) AS n FROM (
  SELECT {CLAMP_SQL} AS clamped_budget, CASE WHEN x IN (0, 256, 1024, 4096) THEN x ELSE 1024 END AS repaired_budget
  FROM (SELECT CAST(floor(value * 100) AS INTEGER) AS x FROM events)) GROUP BY ALL""")
def budget_clamp(spark, sf):
    """P5 + P6 over every event value read as a requested budget."""
    x = F.floor(F.col("value") * 100).cast("int")
    ev = table(spark, sf, "events").select(x.alias("x"))
    return ev.groupBy(BU.clamp_budget(F.col("x")).alias("clamped_budget"), BU.repair_budget(F.col("x")).alias("repaired_budget")).agg(
        F.count(F.lit(1)).alias("n"))


@register("budget_config", """SELECT selected_budget, concat('budget-', CAST(selected_budget AS VARCHAR)) AS budget_id,
  CASE selected_budget WHEN 0 THEN 'minimal' WHEN 256 THEN 'brief' WHEN 1024 THEN 'medium' ELSE 'deep' END AS effort_level,
  CASE selected_budget WHEN 0 THEN 256 WHEN 256 THEN 600 WHEN 1024 THEN 1200 ELSE 2400 END AS max_output_tokens, count(*) AS n
FROM grid GROUP BY selected_budget""")
def budget_config(spark, sf):
    """Budget dimension attached to every trace (broadcast 4-row dimension)."""
    good, _ = BU.with_budget_config(grid_view(spark, sf))
    return good.groupBy("selected_budget", "budget_id", "effort_level", "max_output_tokens").agg(F.count(F.lit(1)).alias("n"))


@register("model_costs", f"""SELECT selected_model, tier, exact_sum(total_tokens / 1000.0 * price) AS total_cost, count(*) AS n FROM (
  SELECT t.selected_model, CASE WHEN instr(lower(t.selected_model), 'flash') > 0 OR instr(lower(t.selected_model), 'cheap') > 0
    OR instr(lower(t.selected_model), 'mini') > 0 THEN 'cheap' WHEN instr(lower(t.selected_model), 'plus') > 0
    OR instr(lower(t.selected_model), 'mid') > 0 THEN 'mid' WHEN instr(lower(t.selected_model), 'max') > 0
    OR instr(lower(t.selected_model), 'strong') > 0 OR instr(lower(t.selected_model), 'pro') > 0 THEN 'strong' END AS tier,
    t.total_tokens, coalesce(p.price, 0.0006) AS price
  FROM trace_log t LEFT JOIN (VALUES ('m-cheap', 0.0003), ('m-mid', 0.0012), ('m-strong', 0.0040)) AS p(model_id, price)
    ON t.selected_model = p.model_id) GROUP BY ALL""", ["total_cost"])
def model_costs(spark, sf):
    """P7 + P8 + P9: tier inferred from the model name, token cost from a broadcast price dimension."""
    prices = spark.createDataFrame([(m, float(p)) for _, m, _, p in FIXTURE_MODELS], "model_id string, cost_per_1k_tokens double")
    t = trace_log_view(spark, sf).join(F.broadcast(prices), F.col("selected_model") == F.col("model_id"), "left")
    t = BU.with_cost(t)
    return t.groupBy("selected_model", BU.infer_tier(F.col("selected_model")).alias("tier")).agg(
        total("cost_usd").alias("total_cost"), F.count(F.lit(1)).alias("n"))


@register("distinct_queries", "SELECT task_type, count(*) AS n FROM (SELECT DISTINCT query, task_type FROM grid) GROUP BY task_type")
def distinct_queries(spark, sf):
    """Distinct (query, task) training inputs."""
    return grid_view(spark, sf).select("query", "task_type").dropDuplicates().groupBy("task_type").agg(F.count(F.lit(1)).alias("n"))


NAMES_SQL = """SELECT CASE id % 7 WHEN 0 THEN 'qwen-flash' WHEN 1 THEN 'qwen3.5-plus-2026-02-15' WHEN 2 THEN ' qwen3-max-2026-01-23 ' WHEN 3 THEN 'mock-cheap' WHEN 4 THEN 'plain'
  WHEN 5 THEN 'own-max' ELSE selected_model END AS name FROM trace_log"""


@register("resolved_models", f"""SELECT name, CASE name WHEN 'qwen-flash' THEN 'qwen3.5-flash-2026-02-23' ELSE CASE WHEN trim(name) LIKE 'qwen3%' THEN trim(name) ELSE name END END AS model_id,
  CASE WHEN starts_with(name, 'mock') THEN 'mock' ELSE 'openai-compatible' END AS backend,
  CASE WHEN name LIKE '%qwen%' THEN 'qwen' WHEN starts_with(name, 'mock') THEN 'mock' ELSE 'openai-compatible' END AS provider,
  CASE WHEN name LIKE '%flash%' OR name LIKE '%cheap%' THEN 'cheap' WHEN name LIKE '%plus%' OR name LIKE '%mid%' THEN 'mid' WHEN name LIKE '%max%' OR name LIKE '%strong%' THEN 'strong' END AS tier,
  CASE trim(name) WHEN 'qwen3.5-plus-2026-02-15' THEN 'qwen-plus' WHEN 'qwen3-max-2026-01-23' THEN 'qwen-max' ELSE name END AS alias,
  CASE WHEN name LIKE '%flash%' THEN 0.0003 WHEN name LIKE '%plus%' THEN 0.0012 WHEN name LIKE '%qwen3-max%' THEN 0.0040 WHEN starts_with(name, 'mock') THEN 0.0 ELSE 0.0006 END::DOUBLE AS cost_per_1k_tokens,
  count(*) AS n FROM ({NAMES_SQL}) GROUP BY ALL""", ["cost_per_1k_tokens"])
def resolved_models(spark, sf):
    """Models named by alias, by an alias's model id, or otherwise."""
    i = F.col("id") % 7
    name = (F.when(i == 0, "qwen-flash").when(i == 1, "qwen3.5-plus-2026-02-15").when(i == 2, " qwen3-max-2026-01-23 ").when(i == 3, "mock-cheap").when(i == 4, "plain")
            .when(i == 5, "own-max").otherwise(F.col("selected_model")))
    resolved = BU.resolve_models(trace_log_view(spark, sf).select(name.alias("name")), "name")
    return resolved.groupBy(*resolved.columns).agg(F.count(F.lit(1)).alias("n"))


@register("budget_rejects", """SELECT id, selected_budget, 'unsupported_budget' AS reject_reason FROM (SELECT id, CASE WHEN id % 10 = 0 THEN 300 ELSE selected_budget END AS selected_budget FROM trace_log)
WHERE selected_budget NOT IN (0, 256, 1024, 4096)""")
def budget_rejects(spark, sf):
    """Traces whose budget is no level."""
    odd = trace_log_view(spark, sf).select("id", F.when(F.col("id") % 10 == 0, 300).otherwise(F.col("selected_budget")).alias("selected_budget"))
    return BU.with_budget_config(odd)[1]


@register("pool_without_tiers", """SELECT sample_id, route_budget, CASE WHEN tier = 'cheap' THEN 'first' ELSE 'only-strong' END AS route_model FROM (
  SELECT sample_id, route_budget, CASE route_model WHEN 'm-cheap' THEN 'cheap' WHEN 'm-mid' THEN 'mid' ELSE 'strong' END AS tier FROM thr)""", ctes=(FIRSTQ, ("thr", THRESH_SQL)))
def pool_without_tiers(spark, sf):
    """A pool without cheap and mid models: cheap falls to the pool's first, mid to the strong one."""
    pool = [R.PoolModel("first", None), R.PoolModel("only-strong", "strong"), R.PoolModel("last", None)]
    return R.route_threshold(sample_queries(spark, sf), pool).select("sample_id", "route_budget", "route_model")
