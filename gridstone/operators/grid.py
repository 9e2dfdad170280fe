"""Candidate grid and resume (J1, J2), response reuse and upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.functions.text import pystrip


def signature(models: Sequence[str], budgets: Sequence[int]) -> str:
    return "models=" + ",".join(models) + "|budgets=" + ",".join(str(b) for b in budgets)


def candidate_grid(samples: DataFrame, models: Sequence[str], budgets: Sequence[int]) -> DataFrame:
    """Samples × models × budgets with the candidate-set signature.  The dimension is a
    bounded literal array exploded per sample: no join, partitioning of samples kept."""
    cands = F.array(*[F.struct(F.lit(m).alias("selected_model"), F.lit(b).alias("selected_budget")) for m in models for b in budgets])
    return samples.select("*", F.explode(cands).alias("_c")).select(
        *samples.columns, "_c.selected_model", "_c.selected_budget", F.lit(signature(models, budgets)).alias("candidate_set_signature"))


def pending_grid(grid: DataFrame, traces: DataFrame) -> DataFrame:
    """Drop (sample, model, budget) keys already traced; blank sample ids never match."""
    done = traces.filter(F.length(pystrip(F.col("sample_id"))) > 0).select("sample_id", "selected_model", "selected_budget")
    return grid.join(done, ["sample_id", "selected_model", "selected_budget"], "left_anti")


def attach_responses(grid: DataFrame, responses: DataFrame, key: str = "request_key") -> DataFrame:
    """Reuse recorded answers by request fingerprint; ``cache_hit`` marks reuse."""
    r = responses.select(key, F.col("output_text").alias("_resp_text"), F.lit(True).alias("_hit"))
    j = grid.join(r, key, "left")
    return j.withColumn("cache_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def upsert_responses(old: DataFrame, new: DataFrame, key: str = "request_key", seq: str = "write_seq") -> DataFrame:
    """Last write wins per fingerprint (hash aggregate max_by, combines map-side)."""
    u = old.unionByName(new, allowMissingColumns=True)
    cols = [c for c in u.columns if c != key]
    return u.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_r")).select(key, "_r.*")


def assemble_traces(grid: DataFrame, responses: DataFrame, grades: DataFrame, key: str = "request_key") -> DataFrame:
    """Grid rows with their response and grade.  A call that failed, or has no answer yet, is a trace of score 0 that
    carries the error: the grade's error goes before the response's."""
    r = responses.select(key, F.col("output_text"), F.col("error_type").alias("_call_error"))
    g = grades.select(key, F.col("score").alias("_score"), F.col("is_correct").alias("_ok"), F.col("error_type").alias("_grade_error"))
    j = grid.join(r, key, "left").join(g, key, "left")
    return j.withColumns({
        "score": F.coalesce("_score", F.lit(0.0)), "is_correct": F.coalesce("_ok", F.lit(False)),
        "error_type": F.coalesce("_grade_error", "_call_error"),
    }).drop("_score", "_ok", "_grade_error", "_call_error")
