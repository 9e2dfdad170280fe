"""Grading and failure analysis jobs.

One pass of ``when(task_type)`` over native text expressions grades a whole
trace table; there is no per-row Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.config import CONFIDENCE_BANDS
from gridstone.functions import text as T
from gridstone.functions.utility import with_sample_id
from gridstone.operators.summaries import mean

GRADE_COLUMNS = ["score", "is_correct", "extracted_answer", "expected_answer", "error_type"]


def add_grades(df: DataFrame, text_col: str = "output_text", expected_col: str = "expected_answer",
               task_col: str = "task_type", outcome_col: str | None = None) -> DataFrame:
    """G6 dispatch by task type — gsm8k numeric (G2), math (G3), humaneval code (G5, G8),
    anything else exact match (G4) — adding ``_g_*`` grade columns."""
    df = T.add_text_answers(df, text_col, task_col)
    df = df.withColumn("_exp_s", F.col(expected_col).cast("string"))
    df = df.withColumn("_exp_m", F.when(F.col(task_col) == "math", F.col("_exp_s")))
    df = df.withColumn("_exp_num", T.normalize_number(F.col("_exp_s")))
    df = df.withColumn("_exp_text", F.when(F.col("_exp_s").isNotNull(), T.normalize_text(F.col("_exp_s"))))
    df = T.add_normalized_math(df, "_math_raw", "_m_ext", ("_exp_m", "_m_exp"))
    df = T.add_rational(T.add_rational(df, "_m_ext"), "_m_exp")
    outcome = F.col(outcome_col) if outcome_col else F.lit(None).cast("string")
    c = F.col
    num_ok = c("_numeric").isNotNull() & c("_exp_num").isNotNull() & (c("_numeric") == c("_exp_num"))
    math_ok = c("_m_ext").isNotNull() & c("_m_exp").isNotNull() & T.math_equal("_m_ext", "_m_exp")
    code_ok = c("_code").isNotNull() & F.coalesce(outcome == "pass", F.lit(False))
    exact_ok = (c("_final").isNotNull() & c("_exp_text").isNotNull() & (F.length(c("_exp_text")) > 0)
                & (T.normalize_text(c("_final")) == c("_exp_text")))
    task = c(task_col)
    ok = F.coalesce(F.when(task == "gsm8k", num_ok).when(task == "math", math_ok).when(task == "humaneval", code_ok)
                    .otherwise(exact_ok), F.lit(False))
    df = df.withColumn("_g_ok", ok)
    ok = c("_g_ok")
    code_err = (F.when(c("_code").isNull(), "parse_error").when(outcome.isNull(), "execution_error")
                .when(outcome == "pass", F.lit(None).cast("string")).when(outcome == "AssertionError", "wrong_answer")
                .otherwise("execution_error"))
    return df.select(
        "*",
        F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0)).alias("_g_score"),
        F.when(task == "gsm8k", c("_numeric")).when(task == "math", c("_m_ext")).when(task == "humaneval", c("_code"))
        .otherwise(c("_final")).alias("_g_extracted"),
        F.when(task == "gsm8k", c("_exp_num")).when(task == "math", c("_m_exp")).when(task == "humaneval", c("_exp_s"))
        .otherwise(c("_exp_text")).alias("_g_expected"),
        F.when(task == "gsm8k", F.when(c("_numeric").isNull(), "parse_error").when(~ok, "wrong_answer"))
        .when(task == "math", F.when(c("_m_ext").isNull(), "parse_error").when(~ok, "wrong_answer"))
        .when(task == "humaneval", code_err)
        .otherwise(F.when(c("_final").isNull(), "empty_output").when(~ok, "wrong_answer")).alias("_g_error"),
    )


def regrade_traces(df: DataFrame, outcomes: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rewrite score / is_correct / extracted / expected / error_type from the text (T7: the
    error type is refreshed too).  ``outcomes`` (optional) holds recorded code-test outcomes
    ``(key, outcome)`` for humaneval rows (G8), joined on the trace key."""
    missing = {"task_type", "output_text", "expected_answer"} - set(df.columns)
    if missing:
        raise ValueError(f"Missing columns: {sorted(missing)}")
    outcome_col = None
    if outcomes is not None:
        df = df.join(outcomes.select(key, F.col("outcome").alias("_outcome")), key, "left")
        outcome_col = "_outcome"
    keep = [c for c in df.columns if c not in GRADE_COLUMNS and not c.startswith("_")]
    g = add_grades(df, outcome_col=outcome_col)
    return g.select(*keep, F.col("_g_score").alias("score"), F.col("_g_ok").alias("is_correct"),
                    F.col("_g_extracted").alias("extracted_answer"), F.col("_g_expected").alias("expected_answer"),
                    F.col("_g_error").alias("error_type"))


# ---------------------------------------------------------------------------
# failures
# ---------------------------------------------------------------------------

def add_failure_class(df: DataFrame, text_col: str = "output_text", expected_col: str = "expected_answer",
                      extracted_col: str = "extracted_answer", task_col: str = "task_type", dst: str = "failure_class") -> DataFrame:
    """Failure class per task (numeric for gsm8k and anything unknown, math, code)."""
    df = df.withColumn("_ft", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumn("_fexp", F.col(expected_col).cast("string")).withColumn("_fext", F.col(extracted_col).cast("string"))
    is_math = F.col(task_col) == "math"
    df = df.withColumn("_fexp_m", F.when(is_math, F.col("_fexp"))).withColumn("_fext_m", F.when(is_math, F.col("_fext")))
    df = T.add_normalized_math(df, "_fexp_m", "_fm_exp", ("_fext_m", "_fm_ext"))
    # the whole output is normalized only where the earlier classes do not decide
    df = df.withColumn("_ft_m", F.when(is_math & (F.col("_fm_ext") != F.col("_fm_exp")), F.col("_ft")))
    df = T.add_normalized_math(df, "_ft_m", "_fm_out")
    c = F.col
    n_exp, n_ext = T.normalize_number(c("_fexp")), T.normalize_number(c("_fext"))
    df = df.withColumn("_fn_exp", n_exp).withColumn("_fn_ext", n_ext)
    numbers = F.transform(F.regexp_extract_all(c("_ft"), F.lit("(" + T.NUMBER + ")"), 1), lambda x: T.normalize_number(x))
    numeric = (
        F.when(c("_fn_ext").isNull(), "no_numeric_answer")
        .when(c("_fn_exp").isNull(), "missing_expected_answer")
        .when(c("_fn_ext") == c("_fn_exp"), "not_failure")
        .when(F.coalesce(F.array_contains(numbers, c("_fn_exp")), F.lit(False)), "answer_format_extraction_error")
        .otherwise("wrong_answer")
    )
    math = (
        F.when(c("_fm_exp").isNull(), "missing_expected_answer")
        .when(c("_fm_ext").isNull(), "no_final_answer")
        .when(c("_fm_ext") == c("_fm_exp"), "stale_or_normalization_mismatch")
        .when(F.instr(F.coalesce(c("_fm_out"), F.lit("")), c("_fm_exp")) > 0, "answer_format_extraction_error")
        .otherwise("wrong_answer")
    )
    ext_s = F.coalesce(c("_fext"), F.lit(""))
    low = F.lower(c("_ft"))
    code = (
        F.when(F.length(T.pystrip(ext_s)) == 0, "parse_error")
        .when((F.instr(low, "traceback") > 0) | (F.instr(low, "syntaxerror") > 0), "execution_error")
        .when(F.instr(ext_s, "def ") == 0, "malformed_answer")
        .otherwise("wrong_answer")
    )
    task = c(task_col)
    return df.withColumn(dst, F.when(task == "math", math).when(task == "humaneval", code).otherwise(numeric))


def correct_budgets(df: DataFrame) -> DataFrame:
    """J7 per sample: sorted distinct budgets with a correct row (hash aggregate; the set is
    bounded by the budget axis, and collect_set combines map-side)."""
    df = with_sample_id(df)
    return df.groupBy("sample_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_correct").cast("boolean"), F.col("selected_budget").cast("bigint"))))
        .alias("_correct_budgets")
    )


def with_correct_budgets(df: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Attach ``correct_budgets_for_sample`` and ``any_other_budget_correct`` to each row; the budgets are those of
    ``traces`` (``df`` itself unless given)."""
    df = with_sample_id(df)
    j = df.join(correct_budgets(df if traces is None else traces), "sample_id", "left")
    b = F.col("selected_budget").cast("bigint")
    return j.withColumn(
        "correct_budgets_for_sample", F.array_join(F.transform("_correct_budgets", lambda x: x.cast("string")), ",")
    ).withColumn(
        "any_other_budget_correct", F.coalesce(F.exists("_correct_budgets", lambda x: x != b), F.lit(False))
    ).drop("_correct_budgets")


FAILURE_COLUMNS = [
    "sample_id", "split", "task_type", "selected_model", "selected_budget", "expected_answer", "extracted_answer",
    "failure_class", "recorded_error_type", "correct_budgets_for_sample", "any_other_budget_correct", "total_tokens",
    "cost_usd", "latency_s", "query", "output_preview", "output_text",
]


def analyze_failures(df: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Incorrect rows + failure class (G9) + recorded error (T5) + J7 + 240-char preview.

    ``route_confidence`` is carried through when present (T6).  With ``queries`` (sample_id, query) the query's text is
    joined to the result, once per sample; without it the rows' own ``query`` is kept.
    """
    df = with_sample_id(df)
    for c, t in (("split", "string"), ("extracted_answer", "string"), ("error_type", "string"), ("total_tokens", "bigint"),
                 ("query", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    if queries is not None:
        df = df.drop("query")
    failed = df.filter(~F.coalesce(F.col("is_correct").cast("boolean"), F.lit(False)))
    text = F.coalesce(F.col("output_text").cast("string"), F.lit(""))
    # texts are judged where they were read, in as many tasks; the small sets of budgets are joined afterwards
    classified = add_failure_class(failed).select(
        "*",
        F.col("error_type").alias("recorded_error_type"),
        F.translate(F.substring(text, 1, 240), "\n", " ").alias("output_preview"),
    )
    out = with_correct_budgets(classified, df)
    if queries is not None:
        out = out.join(queries.select("sample_id", "query"), "sample_id", "left")
    extra = ["route_confidence"] if "route_confidence" in df.columns else []
    return out.select(*FAILURE_COLUMNS, *extra)


def failure_taxonomy(failures: DataFrame, class_col: str = "failure_class") -> DataFrame:
    """Count, average cost and latency per failure class; count desc, avg cost asc."""
    return (
        failures.groupBy(F.col(class_col).alias("error_type"))
        .agg(F.count(F.lit(1)).alias("count"), mean("cost_usd").alias("avg_cost"), mean("latency_s").alias("avg_latency"))
        .orderBy(F.desc("count"), F.asc("avg_cost"), F.asc("error_type"))
    )


def confidence_band(col: Column) -> Column:
    """Right-closed bins (-0.001,.25], (.25,.5], (.5,.75], (.75,1]; out of range → null."""
    expr = None
    for lo, hi, name in CONFIDENCE_BANDS:
        cond = (col > lo) & (col <= hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def browse_failures(df: DataFrame, error: str | None = None, model: str | None = None,
                    error_col: str = "error_type", columns: Sequence[str] | None = None) -> DataFrame:
    """P10: failure browser filters (None = all)."""
    out = df
    if error and error != "all":
        out = out.filter(F.col(error_col) == error)
    if model and model != "all":
        out = out.filter(F.col("selected_model") == model)
    return out.select(*columns) if columns else out
