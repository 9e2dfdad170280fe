"""Registered queries: grading, regrade, failures (whole output texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstone.functions import text as T
from gridstone.operators import grading as G
from gridstone.operators import summaries as S
from gridstone.plans import sql_grading as SG
from gridstone.plans.catalog import register
from gridstone.plans.sql_views import with_views
from gridstone.sources.views import grid_view, samples_view, table

OUTCOME_SQL = """CASE WHEN task_type <> 'humaneval' THEN NULL WHEN is_correct THEN 'pass' WHEN error_type = 'parse_error' THEN 'SyntaxError'
  WHEN error_type = 'APIConnectionError' THEN NULL ELSE 'AssertionError' END"""


def recorded_outcomes(grid):
    """Recorded code-test outcomes (G8 input), derived by Spark from the trace grid."""
    c = F.col
    outcome = (F.when(c("task_type") != "humaneval", F.lit(None)).when(c("is_correct"), "pass")
               .when(c("error_type") == "parse_error", "SyntaxError").when(c("error_type") == "APIConnectionError", F.lit(None))
               .otherwise("AssertionError"))
    return grid.select("id", outcome.alias("outcome")).filter(F.col("outcome").isNotNull())


def _graded_sql() -> str:
    L = SG.Layers("SELECT g.*, o.outcome AS _outcome FROM grid g LEFT JOIN outcomes o ON g.id = o.id")
    SG.grades(L, outcome="_outcome")
    return L.sql


OUTCOMES_CTE = ("outcomes", f"SELECT id, {OUTCOME_SQL} AS outcome FROM grid WHERE ({OUTCOME_SQL}) IS NOT NULL")


@register(
    "text_answers",
    (lambda L: f"SELECT id, _marked AS marked_answer, _numeric AS numeric_answer, _final AS final_answer, _code AS code_block, "
               f"_math_raw AS math_answer FROM ({L.sql})")(SG.text_answers(SG.Layers("SELECT * FROM grid"))),
)
def text_answers(spark, sf):
    """G1, G2, G4, G5, G3 extraction columns over every trace."""
    g = T.add_text_answers(grid_view(spark, sf).select("id", "output_text"))
    return g.select("id", F.col("_marked").alias("marked_answer"), F.col("_numeric").alias("numeric_answer"),
                    F.col("_final").alias("final_answer"), F.col("_code").alias("code_block"), F.col("_math_raw").alias("math_answer"))


@register(
    "regrade",
    f"SELECT id, task_type, _g_score AS score, _g_ok AS is_correct, _g_extracted AS extracted_answer, "
    f"_g_expected AS expected_answer, _g_error AS error_type FROM graded",
    ["score"], headline=True, ctes=(OUTCOMES_CTE, ("graded", _graded_sql())),
)
def regrade(spark, sf):
    """G6 (+G8 from recorded outcomes)."""
    grid = grid_view(spark, sf)
    out = G.regrade_traces(grid.select("id", "task_type", "output_text", "expected_answer"), recorded_outcomes(grid))
    return out.select("id", "task_type", "score", "is_correct", "extracted_answer", "expected_answer", "error_type")


@register(
    "regrade_report",
    """SELECT count(*) AS rows, avg(CAST(g.is_correct AS DOUBLE)) AS accuracy_before, avg(CAST(r._g_ok AS DOUBLE)) AS accuracy_after,
  CAST(sum(CASE WHEN g.is_correct <> r._g_ok THEN 1 ELSE 0 END) AS BIGINT) AS changed
FROM grid g JOIN graded r ON g.id = r.id""",
    ["accuracy_before", "accuracy_after"], ctes=(OUTCOMES_CTE, ("graded", _graded_sql())),
)
def regrade_report(spark, sf):
    """A12."""
    grid = grid_view(spark, sf)
    after = G.regrade_traces(grid.select("id", "task_type", "output_text", "expected_answer"), recorded_outcomes(grid))
    return S.regrade_report(grid, after)


def _failure_input(spark, sf):
    """Recorded traces with the extracted answer a grader would have stored."""
    grid = grid_view(spark, sf)
    graded = G.add_grades(grid)
    return graded.select(*[c for c in grid.columns if c != "expected_answer"], "expected_answer",
                         F.col("_g_extracted").alias("extracted_answer"))


def _failures_sql() -> str:
    L = SG.Layers("SELECT g.*, g._g_extracted AS extracted_answer FROM graded g")
    return L.sql


FAIL_BASE = f"""
SELECT f.*, cb.correct_budgets_for_sample,
  coalesce(list_bool_or(list_transform(cb.bl, lambda x: x <> CAST(f.selected_budget AS BIGINT))), false) AS any_other_budget_correct
FROM (SELECT * FROM fin WHERE NOT coalesce(is_correct, false)) f
LEFT JOIN (SELECT sample_id, list_sort(list_distinct(list(CASE WHEN is_correct THEN CAST(selected_budget AS BIGINT) END))) AS bl,
                  array_to_string(list_sort(list_distinct(list(CASE WHEN is_correct THEN CAST(selected_budget AS BIGINT) END))), ',')
                    AS correct_budgets_for_sample
           FROM fin GROUP BY sample_id) cb ON f.sample_id = cb.sample_id
"""


def _classified_sql() -> str:
    L = SG.Layers("SELECT * FROM fbase")
    SG.failure_class(L)
    return L.sql


FAIL_CTES = (
    ("graded", (lambda L: SG.grades(L).sql)(SG.Layers("SELECT * FROM grid"))),
    ("fin", "SELECT id, sample_id, query, task_type, split, expected_answer, selected_model, selected_model_tier, selected_budget, "
            "is_correct, error_type, total_tokens, cost_usd, latency_s, output_text, _g_extracted AS extracted_answer FROM graded"),
    ("fbase", FAIL_BASE),
    ("classified", _classified_sql()),
)
FAILURE_SELECT = """sample_id, split, task_type, selected_model, selected_budget, expected_answer, extracted_answer, failure_class,
  error_type AS recorded_error_type, correct_budgets_for_sample, any_other_budget_correct, total_tokens, cost_usd, latency_s, query,
  translate(substr(coalesce(output_text, ''), 1, 240), chr(10), ' ') AS output_preview, output_text"""


@register("failure_table", f"SELECT {FAILURE_SELECT} FROM classified", ["cost_usd", "latency_s"], ctes=FAIL_CTES, headline=True)
def failure_table(spark, sf):
    """G10 with G9 classes, J7 and the recorded error type (T5)."""
    return G.analyze_failures(_failure_input(spark, sf), samples_view(spark, sf))


@register(
    "failure_taxonomy",
    """SELECT failure_class AS error_type, count(*) AS count, exact_avg(cost_usd) AS avg_cost, exact_avg(latency_s) AS avg_latency
FROM classified GROUP BY failure_class""",
    ["avg_cost", "avg_latency"], ctes=FAIL_CTES,
)
def failure_taxonomy(spark, sf):
    """A9."""
    return G.failure_taxonomy(G.analyze_failures(_failure_input(spark, sf)))


@register(
    "failure_browser",
    f"SELECT sample_id, selected_model, selected_budget, failure_class, recorded_error_type, output_preview FROM "
    f"(SELECT {FAILURE_SELECT} FROM classified) WHERE recorded_error_type = 'wrong_answer' AND selected_model = 'm-mid'",
    ctes=FAIL_CTES,
)
def failure_browser(spark, sf):
    """P10: failures filtered by recorded error type and model."""
    f = G.analyze_failures(_failure_input(spark, sf))
    return G.browse_failures(f, "wrong_answer", "m-mid", error_col="recorded_error_type",
                             columns=["sample_id", "selected_model", "selected_budget", "failure_class", "recorded_error_type",
                                      "output_preview"])


@register(
    "correct_budgets",
    """SELECT sample_id, array_to_string(list_sort(list_distinct(list(CASE WHEN is_correct THEN CAST(selected_budget AS BIGINT) END))), ',')
  AS correct_budgets_for_sample FROM grid GROUP BY sample_id""",
)
def correct_budgets(spark, sf):
    """J7 per sample."""
    cb = G.correct_budgets(grid_view(spark, sf))
    return cb.select("sample_id", F.array_join(F.transform("_correct_budgets", lambda x: x.cast("string")), ",")
                     .alias("correct_budgets_for_sample"))


@register(
    "conversation_answers",
    (lambda L: f"SELECT conv_id, turn, _marked AS marked_answer, _numeric AS numeric_answer, _code AS code_block FROM ({L.sql})")(
        SG.text_answers(SG.Layers("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"), "text")),
    note="whole conversation texts",
)
def conversation_answers(spark, sf):
    """Answer extraction over assistant turns of ``conversations`` (extra grading text)."""
    conv = table(spark, sf, "conversations").filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    g = T.add_text_answers(conv, "text")
    return g.select("conv_id", "turn", F.col("_marked").alias("marked_answer"), F.col("_numeric").alias("numeric_answer"),
                    F.col("_code").alias("code_block"))
