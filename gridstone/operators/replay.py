"""Counterfactual replay of routing decisions against recorded traces.

Decisions are made once per distinct sample (or (sample, model)), then joined
to the trace table on the sample key; the chosen row per sample is an aggregate
``min_by`` over narrow rows on the same key, so the join and the aggregate share
one shuffle.  The reference's silent fallback to the cheapest row (T2) is kept and
flagged with ``matched``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.config import THRESHOLD_SWEEP, Weights
from gridstone.functions.utility import summary_utility, with_sample_id, without_failed
from gridstone.operators.summaries import METRIC_COLUMNS, selection_metrics, summarize_router, zero_fill
from gridstone.session import cut_lineage

MODEL = "selected_model"
BUDGET = "selected_budget"


def first_queries(grid: DataFrame) -> DataFrame:
    """One (sample_id, query, task_type) per sample: the first row's (by id)."""
    grid = with_sample_id(grid)
    order = "id" if "id" in grid.columns else "sample_id"
    return grid.groupBy("sample_id").agg(F.min_by(F.struct("query", "task_type"), F.col(order)).alias("_q")).select(
        "sample_id", "_q.query", "_q.task_type")


def replay(grid: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("sample_id",),
           decision_cols: Sequence[str] = (), group_extra: Sequence[str] = (), exclude_failed: bool = False) -> DataFrame:
    """The trace row matching the decided (model, budget) of each key, else the key's
    cheapest row by (cost, latency, budget).  ``decisions`` has ``keys``, ``route_model``
    (optional when keys include the model) and ``route_budget``.  Texts are not ranked: join
    them to the result by ``id`` where they are wanted.  ``exclude_failed`` leaves failed calls out (T4)."""
    grid = with_sample_id(without_failed(grid) if exclude_failed else grid).drop("query", "output_text")
    keys = list(keys)
    d = decisions.select(*keys, *group_extra,
                         *[c for c in ("route_model", "route_budget") if c in decisions.columns and c not in keys],
                         *decision_cols)
    j = grid.join(d, keys, "inner")
    match = F.col(BUDGET) == F.col("route_budget")
    if "route_model" in d.columns:
        match = match & (F.col(MODEL) == F.col("route_model"))
    j = j.withColumn("matched", F.coalesce(match, F.lit(False)))
    unmatched = ~F.col("matched")
    tail = [F.col(c) for c in (MODEL, "id") if c in grid.columns]
    key = F.struct(unmatched.alias("k0"), F.when(unmatched, F.col("cost_usd")).alias("k1"),
                   F.when(unmatched, F.col("latency_s")).alias("k2"), F.col(BUDGET).alias("k3"),
                   *[c.alias(f"t{i}") for i, c in enumerate(tail)])
    gkeys = keys + list(group_extra)
    value_cols = [c for c in j.columns if c not in gkeys]
    return j.groupBy(*gkeys).agg(F.min_by(F.struct(*value_cols), key).alias("_r")).select(*gkeys, "_r.*")


def replay_router(grid: DataFrame, decisions: DataFrame, router_name: str, exclude_failed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replay a router's per-sample decisions; returns (selected rows, A4 summary)."""
    extra = [c for c in ("route_confidence", "fallback_triggered", "fallback_reason", "router_name") if c in decisions.columns]
    sel = replay(grid, decisions, ("sample_id",), extra, exclude_failed=exclude_failed)
    sel = sel.withColumn("policy", F.lit(f"phase2_{router_name}"))
    return sel, summarize_router(sel, router_name)


def match_rate(selected: DataFrame) -> DataFrame:
    """Share of replayed decisions that had a recorded trace."""
    return selected.agg(F.avg(F.col("matched").cast("double")).alias("match_rate"), F.count(F.lit(1)).alias("n"))


def replay_policy(grid: DataFrame, predictions: DataFrame, fallback_budget: Column | None = None, safe: bool = True) -> DataFrame:
    """Per (sample, model): the predicted budget — or the safe fallback budget when given —
    else the cheapest row of that (sample, model)."""
    p = predictions.select("sample_id", MODEL, "predicted_budget")
    chosen = fallback_budget if (safe and fallback_budget is not None) else F.col("predicted_budget")
    p = p.withColumn("route_budget", chosen)
    sel = replay(grid, p, ("sample_id", MODEL), ["predicted_budget"])
    return sel.withColumn("policy_budget", F.col(BUDGET)).withColumn(
        "policy", F.lit("safe_learned_policy" if safe and fallback_budget is not None else "learned_policy"))


def calibrate(grid: DataFrame, predictions: DataFrame, w: Weights | None = None) -> DataFrame:
    """Raw learned replay vs every fixed budget on a dev table; the best by utility
    (avg latency) decides safe mode and the fallback budget."""
    raw = replay_policy(grid, predictions, None, safe=False)
    raw_sum = zero_fill(raw.agg(*selection_metrics()).withColumn("policy", F.lit("learned_policy_raw")))
    fixed = grid.groupBy(BUDGET).agg(*selection_metrics()).select(
        F.concat(F.lit("fixed_budget_"), F.col(BUDGET).cast("string")).alias("policy"), *METRIC_COLUMNS)
    table = raw_sum.select("policy", *METRIC_COLUMNS).unionByName(fixed).withColumn("utility", summary_utility(w, "avg"))
    best = table.orderBy(F.desc("utility"), F.desc("accuracy"), F.asc("avg_cost"), F.asc("policy")).limit(1)
    is_fixed = F.col("policy").startswith("fixed_budget_")
    return best.select(
        F.when(is_fixed, "fallback_to_calibrated_fixed_budget").otherwise("raw_learned_policy").alias("calibration_policy"),
        is_fixed.alias("safe_mode"),
        F.when(is_fixed, F.regexp_extract("policy", "fixed_budget_(.*)", 1).cast("int")).alias("fallback_budget"),
        F.col("utility").alias("calibration_utility"), F.col("accuracy").alias("calibration_accuracy"),
        F.col("avg_cost").alias("calibration_avg_cost"), F.col("avg_latency").alias("calibration_avg_latency"),
    )


def sweep_thresholds(grid: DataFrame, primary: DataFrame, fallback: DataFrame,
                     thresholds: Sequence[float] = THRESHOLD_SWEEP, w: Weights | None = None) -> DataFrame:
    """Uncertainty-aware decisions at every threshold in one job (thresholds exploded
    per sample — a fixed 4-entry literal), replay, one summary row per threshold with the
    p95-flavoured utility; ``is_best`` marks the first best."""
    from gridstone.operators.routers import route_uncertain

    fb = fallback.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    dec = route_uncertain(primary, fb, F.col("threshold"))
    grid = with_sample_id(grid)
    d = dec.select("sample_id", "threshold", "route_model", "route_budget", "route_confidence", "fallback_triggered")
    sel = replay(grid, d, ("sample_id",), ["route_confidence", "fallback_triggered"], group_extra=("threshold",))
    summ = sel.groupBy("threshold").agg(*selection_metrics(), F.avg(F.col("fallback_triggered").cast("double")).alias("fallback_rate"))
    summ = cut_lineage(summ.withColumn("utility", summary_utility(w, "p95")))  # read twice: the replay runs once
    best = summ.orderBy(F.desc("utility"), F.asc("threshold")).limit(1).select("threshold").scalar()
    return summ.withColumn("is_best", F.col("threshold") == best)
