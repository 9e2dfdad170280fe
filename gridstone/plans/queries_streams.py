"""Registered queries: the request path as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstone.functions import features as FT
from gridstone.plans.catalog import register
from gridstone.plans.queries_learned import models_folder
from gridstone.plans.queries_more import FIRSTQ, JOINT_SQL, POOL, THRESH_SQL
from gridstone.plans.queries_text import OUTCOMES_CTE, _graded_sql, recorded_outcomes
from gridstone.sources.views import grid_view, samples_from_documents, samples_view, table, trace_log_view
from gridstone.streaming import streams as ST


@register("stream_traces", """SELECT id, sample_id, selected_model, selected_budget, task_type, n_requests FROM (
  SELECT *, count(*) OVER (PARTITION BY sample_id, selected_model, selected_budget, task_type, session) AS n_requests,
    row_number() OVER (PARTITION BY sample_id, selected_model, selected_budget, task_type, session ORDER BY created_at, id) AS place
  FROM (SELECT *, count(*) FILTER (before IS NULL OR created_at - before > INTERVAL 1 HOUR) OVER (PARTITION BY sample_id, selected_model, selected_budget, task_type
          ORDER BY created_at, id) AS session
        FROM (SELECT *, lag(created_at) OVER (PARTITION BY sample_id, selected_model, selected_budget, task_type ORDER BY created_at, id) AS before FROM trace_log WHERE created_at IS NOT NULL)))
WHERE place = 1""")
def stream_traces(spark, sf):
    """The events in slices of rising time; a request is answered unless the same one came at most an hour before."""
    return ST.answered_requests(trace_log_view(spark, sf)).select("id", *ST.REQUEST_FIELDS, "n_requests")


def requests_of(samples):
    """How each sample wants to be routed: by a named router, by the default one, or by its own model and budget."""
    kind = F.col("doc_id") % 6
    return samples.select(
        "doc_id", "sample_id", "query", "task_type", (~kind.isin(2, 4)).alias("use_router"),
        F.when(kind == 0, "threshold").when(kind == 1, "legacy_joint_policy").when(kind == 5, "no_such_router").alias("router_name"),
        F.when(kind == 2, "m-mid").when(kind == 4, "m-cheap").alias("model_id"), F.when(kind == 2, 256).when(kind == 4, 300).alias("budget"))


@register("routed_requests", """
SELECT s.sample_id, CASE s.doc_id % 6 WHEN 1 THEN j.route_model WHEN 2 THEN 'm-mid' WHEN 4 THEN 'm-cheap' WHEN 5 THEN NULL ELSE t.route_model END AS route_model,
  CASE s.doc_id % 6 WHEN 1 THEN j.route_budget WHEN 2 THEN 256 WHEN 4 THEN 300 WHEN 5 THEN NULL ELSE t.route_budget END AS route_budget,
  CASE WHEN s.doc_id % 6 IN (0, 3) THEN t.route_confidence END AS route_confidence,
  CASE s.doc_id % 6 WHEN 0 THEN 'threshold' WHEN 1 THEN 'legacy_joint_policy' WHEN 3 THEN 'uncertainty_aware' WHEN 5 THEN 'no_such_router' END AS routed_by,
  s.doc_id % 6 = 3 AS fallback_triggered, CASE WHEN s.doc_id % 6 = 3 THEN 'missing_artifact' END AS fallback_reason,
  CASE s.doc_id % 6 WHEN 4 THEN 'unsupported_budget' WHEN 5 THEN 'unknown_router' END AS reject_reason
FROM samples s JOIN thr t ON t.sample_id = s.sample_id JOIN joint j ON j.sample_id = s.sample_id""", ["route_confidence"],
          ctes=(FIRSTQ, ("thr", THRESH_SQL), ("joint", JOINT_SQL)))
def routed_requests(spark, sf):
    """A request stream routed row by row, with the routers that need no artifact; unknown routers and budgets are rejected with a reason."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    keep = ["sample_id", "route_model", "route_budget", "route_confidence", "routed_by", "fallback_triggered", "fallback_reason", "reject_reason"]
    return ST.routed_stream(docs, "doc_id", lambda d: requests_of(samples_from_documents(d)), ST.Runtime(POOL), keep=keep)


def learned_requests(samples):
    """Every sample once by each learned router's name and once by the default."""
    names = F.array(F.lit("logreg_joint"), F.lit("mlp_factorized"), F.lit(None))
    return samples.select("*", F.lit(True).alias("use_router"), F.explode(names).alias("router_name"),
                          F.lit(None).cast("string").alias("model_id"), F.lit(None).cast("int").alias("budget"))


@register("learned_routed_requests", None, note="Spark ML training; equal to the batch routers in the tests")
def learned_routed_requests(spark, sf):
    """X1 with saved and reloaded routers applied inside the stream; embedding features come by a stream-static join."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    vectors = table(spark, sf, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.min("embedding").alias("embedding"))

    def features(d):
        # features are made before the join and the repeats, so texts are in neither
        made = FT.feature_frame(samples_from_documents(d).select("doc_id", "sample_id", "query", "task_type")).drop("query")
        return learned_requests(FT.with_embedding_features(made, vectors, "doc_id"))

    runtime = ST.Runtime(POOL, ST.load_artifacts(spark, models_folder(spark, sf)))
    return ST.routed_stream(docs, "doc_id", features, runtime, keep=["sample_id", "routed_by", "route_model", "route_budget", "route_confidence", "fallback_triggered", "fallback_reason"])


@register("graded_responses", """SELECT id, sample_id, selected_model, selected_budget, cost_usd, _g_score AS score, _g_ok AS is_correct, _g_extracted AS extracted_answer,
  _g_expected AS expected_answer, _g_error AS error_type FROM graded""", ["cost_usd", "score"], ctes=(OUTCOMES_CTE, ("graded", _graded_sql())))
def graded_responses(spark, sf):
    """A stream of responses joined with the static samples, graded and appended batch by batch."""
    grid = grid_view(spark, sf)
    responses = grid.select("id", "sample_id", "selected_model", "selected_budget", "cost_usd", "output_text")
    traces = ST.graded_stream(responses, "id", samples_view(spark, sf), recorded_outcomes(grid))
    return traces.select("id", "sample_id", "selected_model", "selected_budget", "cost_usd", "score", "is_correct", "extracted_answer", "expected_answer", "error_type")
