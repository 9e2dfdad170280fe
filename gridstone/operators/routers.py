"""Routing rules as batch scorers over whole tables.

Routers score *distinct samples*; decisions are then joined to traces
(replay).  The model pool is a short list of the caller's, turned into literals,
so scoring is a per-row expression with no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.config import (
    BUDGET_ACCURACY_BONUS,
    BUDGET_ACCURACY_BONUS_DEFAULT,
    BUDGET_HINT_PENALTY,
    BUDGET_LEVELS,
    DEFAULT_CONFIDENCE_THRESHOLD,
    JOINT_BUDGET_BONUS,
    JOINT_CODE_PENALTY,
    JOINT_DIFFICULTY_PENALTY,
    JOINT_MODEL_ACCURACY,
    JOINT_MODEL_COST_FACTOR,
    TASK_ACCURACY_PENALTY,
    TASK_ACCURACY_PENALTY_DEFAULT,
    TASK_LATENCY_DEFAULT,
    TASK_LATENCY_MULTIPLIER,
    TIER_ACCURACY_BASE,
    TIER_ACCURACY_DEFAULT,
    TIER_COST_BASE,
    TIER_COST_DEFAULT,
    TIER_LATENCY_BASE,
    TIER_LATENCY_DEFAULT,
    Weights,
)
from gridstone.functions.features import difficulty_band, heuristic_difficulty, probe_feature_columns

@dataclass(frozen=True)
class PoolModel:
    model_id: str
    tier: str | None


def _lookup(mapping: dict, key: Column, default) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[key], F.lit(default))


def estimates(tier: Column, budget: Column, task: Column, difficulty: Column) -> dict[str, Column]:
    """Estimated cost, latency and accuracy for (tier, budget, task, difficulty score)."""
    cost = _lookup(TIER_COST_BASE, tier, TIER_COST_DEFAULT) * (1 + budget / 1024)
    lat = (_lookup(TIER_LATENCY_BASE, tier, TIER_LATENCY_DEFAULT) + budget / 180.0) * _lookup(TASK_LATENCY_MULTIPLIER, task, TASK_LATENCY_DEFAULT)
    acc = (_lookup(TIER_ACCURACY_BASE, tier, TIER_ACCURACY_DEFAULT) + _lookup(BUDGET_ACCURACY_BONUS, budget.cast("int"), BUDGET_ACCURACY_BONUS_DEFAULT)
           - difficulty * 0.25 - _lookup(TASK_ACCURACY_PENALTY, task, TASK_ACCURACY_PENALTY_DEFAULT))
    return {"estimated_cost": cost, "estimated_latency": lat, "estimated_accuracy": F.greatest(F.lit(0.05), F.least(F.lit(0.98), acc))}


def tier_to_model(pool: list[PoolModel], tier: Column) -> tuple[Column, Column]:
    """First model of the tier; mid falls back to strong then cheap; else the first
    (cheap) or last (other tiers) model of the pool.  Returns (model_id, model tier)."""
    first = {}
    for m in pool:
        if m.tier is not None and m.tier not in first:
            first[m.tier] = m
    head, tail = pool[0], pool[-1]

    def pick(t: str) -> PoolModel:
        if t in first:
            return first[t]
        if t == "mid":
            for alt in ("strong", "cheap"):
                if alt in first:
                    return first[alt]
        return head if t == "cheap" else tail

    chosen = {t: pick(t) for t in ("cheap", "mid", "strong")}
    model = F.when(tier == "cheap", chosen["cheap"].model_id).when(tier == "mid", chosen["mid"].model_id).otherwise(chosen["strong"].model_id)
    mtier = (F.when(tier == "cheap", F.lit(chosen["cheap"].tier)).when(tier == "mid", F.lit(chosen["mid"].tier))
             .otherwise(F.lit(chosen["strong"].tier)))
    return model, mtier


def route_threshold(samples: DataFrame, pool: list[PoolModel], query_col: str = "query", task_col: str = "task_type",
                    difficulty: Column | None = None) -> DataFrame:
    """R2: tier by difficulty .75/.45 (or task), budget by .8/.4, confidence max(.15, 1-|d-.5|).  ``difficulty``: the
    probe's, if it is there already."""
    d_col = probe_feature_columns(query_col)[0] if difficulty is None else difficulty
    df = samples.withColumn("_d", d_col)
    d, task = F.col("_d"), F.col(task_col)
    tier = F.when((d >= 0.75) | (task == "humaneval"), "strong").when((d >= 0.45) | (task == "math"), "mid").otherwise("cheap")
    budget = F.when(d >= 0.8, 1024).when(d >= 0.4, 256).otherwise(0)
    df = df.withColumn("_tier", tier).withColumn("route_budget", budget)
    model, mtier = tier_to_model(pool, F.col("_tier"))
    df = df.withColumn("route_model", model).withColumn("route_tier", mtier)
    est = estimates(F.col("route_tier"), F.col("route_budget"), task, d)
    return df.select(
        *[c for c in samples.columns], "route_model", "route_budget",
        difficulty_band(d).alias("route_difficulty"),
        est["estimated_accuracy"].alias("estimated_accuracy"), est["estimated_cost"].alias("estimated_cost"),
        est["estimated_latency"].alias("estimated_latency"),
        F.greatest(F.lit(0.15), 1.0 - F.abs(d - 0.5)).alias("route_confidence"),
        F.lit("threshold").alias("router_name"), F.lit(False).alias("fallback_triggered"),
        F.lit(None).cast("string").alias("fallback_reason"),
    )


def route_joint(samples: DataFrame, model_ids: list[str], hints: DataFrame | None = None, w: Weights | None = None,
                query_col: str = "query", task_col: str = "task_type", difficulty: Column | None = None) -> DataFrame:
    """Argmax of utility over models × four budgets (first wins ties), heuristic difficulty,
    optional budget hints (``sample_id, model_id, budget_hint``) with a 0.03 penalty per level step.

    Candidates are a literal array (pool × 4 budgets, bounded); the argmax is
    ``array_max`` over per-candidate structs — no join, no shuffle.
    """
    w = w or Weights()
    df = samples.withColumn("_diff", heuristic_difficulty(query_col, task_col) if difficulty is None else difficulty)
    cands = []
    for mi, mid in enumerate(model_ids):
        for bi, b in enumerate(BUDGET_LEVELS):
            cands.append(F.struct(F.lit(mi).alias("mi"), F.lit(mid).alias("model_id"), F.lit(b).alias("budget"),
                                  F.lit(bi).alias("bi"), F.lit(mi * len(BUDGET_LEVELS) + bi).alias("idx")))
    if hints is not None:
        hint_map = hints.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("model_id", "budget_hint"))).alias("_hints"))
        df = df.join(hint_map, "sample_id", "left")
    else:
        df = df.withColumn("_hints", F.lit(None).cast("map<string,int>"))
    diff_pen = F.create_map(*[x for k, v in JOINT_DIFFICULTY_PENALTY.items() for x in (F.lit(k), F.lit(v))])[F.col("_diff")]
    code_pen = F.when(F.col(task_col) == "humaneval", F.lit(JOINT_CODE_PENALTY)).otherwise(F.lit(0.0))
    bonus = F.create_map(*[x for k, v in JOINT_BUDGET_BONUS.items() for x in (F.lit(k), F.lit(v))])
    level_idx = F.create_map(*[x for i, b in enumerate(BUDGET_LEVELS) for x in (F.lit(b), F.lit(i))])

    def score(c: Column) -> Column:
        mi = F.least(c["mi"], F.lit(len(JOINT_MODEL_ACCURACY) - 1))
        base = F.element_at(F.array(*[F.lit(v) for v in JOINT_MODEL_ACCURACY]), mi + 1)
        acc = F.greatest(F.lit(0.0), F.least(F.lit(0.98), base + bonus[c["budget"]] - (diff_pen + code_pen)))
        factor = F.element_at(F.array(*[F.lit(v) for v in JOINT_MODEL_COST_FACTOR]), F.least(c["mi"], F.lit(2)) + 1)
        cost = factor * (1 + c["budget"] / 1024)
        lat = 0.4 + c["mi"] * 0.8 + c["budget"] / 1500
        util = F.lit(w.alpha) * acc - F.lit(w.beta) * cost - F.lit(w.gamma) * lat
        hint = F.col("_hints")[c["model_id"]]
        pen = F.when(hint.isNotNull(), F.abs(c["bi"] - level_idx[hint]) * BUDGET_HINT_PENALTY).otherwise(F.lit(0.0))
        return F.struct((util - pen).alias("u"), (-c["idx"]).alias("neg_idx"), c["model_id"].alias("model_id"),
                        c["budget"].alias("budget"), acc.alias("acc"), cost.alias("cost"), lat.alias("lat"))

    best = F.array_max(F.transform(F.array(*cands), score))
    df = df.withColumn("_best", best)
    return df.select(
        *[c for c in samples.columns], F.col("_best.model_id").alias("route_model"), F.col("_best.budget").alias("route_budget"),
        F.col("_diff").alias("route_difficulty"), F.col("_best.acc").alias("estimated_accuracy"),
        F.col("_best.cost").alias("estimated_cost"), F.col("_best.lat").alias("estimated_latency"),
        F.col("_best.u").alias("route_utility"),
    )


def route_uncertain(primary: DataFrame, fallback: DataFrame, threshold: float | Column = DEFAULT_CONFIDENCE_THRESHOLD,
                    key: str = "sample_id") -> DataFrame:
    """Keep the primary decision when its confidence >= threshold; otherwise the
    fallback's decision with ``low_confidence`` (primary confidence kept).  Samples with no
    primary decision (no artifact) use the fallback with ``missing_artifact``."""
    p = primary.select(key, F.col("route_model").alias("_pm"), F.col("route_budget").alias("_pb"),
                       F.col("route_confidence").alias("_pc"))
    j = fallback.join(p, key, "left")
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    missing = F.col("_pm").isNull()
    keep = ~missing & F.coalesce(F.col("_pc") >= thr, F.lit(False))
    return j.select(
        *[c for c in fallback.columns if c not in ("route_model", "route_budget", "route_confidence", "router_name",
                                                   "fallback_triggered", "fallback_reason")],
        F.when(keep, F.col("_pm")).otherwise(F.col("route_model")).alias("route_model"),
        F.when(keep, F.col("_pb")).otherwise(F.col("route_budget")).alias("route_budget"),
        F.when(missing, F.col("route_confidence")).otherwise(F.col("_pc")).alias("route_confidence"),
        F.lit("uncertainty_aware").alias("router_name"),
        (~keep).alias("fallback_triggered"),
        F.when(missing, "missing_artifact").when(~keep, "low_confidence").alias("fallback_reason"),
    )


def artifact_exists(spark: SparkSession, path: str) -> bool:
    """Whether a saved model is there, in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def route_or_threshold(spark: SparkSession, samples: DataFrame, pool: list[PoolModel], model_path: str | None, name: str,
                       scorer, difficulty: Column | None = None) -> DataFrame:
    """A learned router whose artifact is missing gives the threshold rule's decisions, flags included, under its
    own name.  The branch is decided once at plan time."""
    if model_path and artifact_exists(spark, model_path):
        return scorer(samples, model_path)
    return route_threshold(samples, pool, difficulty=difficulty).withColumn("router_name", F.lit(name))
