"""Report tables (W7, Q1–Q6) and bootstrap confidence intervals.

Every benchmark is handled in the same job (``benchmark`` is a grouping key),
not one pass per benchmark.  Report inputs are summary tables whose size is
bounded by benchmarks × policies, so their windows are cheap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.config import ABLATION_GROUPS, Weights
from gridstone.functions.utility import summary_utility
from gridstone.operators import grading as G
from gridstone.operators.quantiles import same_keys
from gridstone.operators.summaries import mean, total

def round6(c: str) -> Column:
    """Round to 6 places as round(x*1e6)/1e6 (bit-identical across engines)."""
    return F.round(F.col(c) * F.lit(1e6)) / F.lit(1e6)


def final_comparison(summary: DataFrame, selection: DataFrame, kind: str = "learned") -> DataFrame:
    """Q1: per benchmark the router that dev picked (``kind``: what the routers to pick from were) vs the strongest fixed
    pair vs the aggregate policy."""
    order = [F.desc("utility"), F.desc("accuracy"), F.asc("avg_cost"), F.asc("policy")]
    fixed = (summary.filter(F.col("policy_family") == "fixed_model_budget")
             .withColumn("_rn", F.row_number().over(Window.partitionBy("benchmark").orderBy(*order))).filter(F.col("_rn") == 1)
             .select("benchmark", F.col("policy").alias("strongest_fixed_policy"), F.col("utility").alias("strongest_fixed_utility"),
                     F.col("avg_cost").alias("_f_cost"), F.col("accuracy").alias("_f_acc")))
    agg = (summary.filter(F.col("policy_family") == "joint_aggregate_utility")
           .withColumn("_rn", F.row_number().over(Window.partitionBy("benchmark").orderBy(F.desc("utility"), F.asc("policy"))))
           .filter(F.col("_rn") == 1).select("benchmark", F.col("policy").alias("aggregate_policy"), F.col("utility").alias("aggregate_utility")))
    picked = selection.select("benchmark", F.col("official_router_policy").alias("policy"), "official_router_name")
    chosen = summary.join(picked, ["benchmark", "policy"]).select(
        "benchmark", F.col("policy").alias(f"official_{kind}_policy"), "official_router_name", "accuracy", "avg_cost", "p95_latency", "utility")
    j = chosen.join(fixed, "benchmark").join(agg, "benchmark")
    return j.select(
        "benchmark", f"official_{kind}_policy", "official_router_name", "accuracy", "avg_cost", "p95_latency", "utility", "strongest_fixed_policy",
        "strongest_fixed_utility", "aggregate_policy", "aggregate_utility",
        ((F.col("_f_cost") - F.col("avg_cost")) / F.greatest(F.col("_f_cost"), F.lit(1e-9))).alias("cost_reduction_vs_strongest_fixed"),
        (F.col("_f_acc") - F.col("accuracy")).alias("accuracy_drop_vs_strongest_fixed"),
        (F.col("utility") > F.col("strongest_fixed_utility")).alias("beats_strongest_fixed"),
        (F.col("utility") > F.col("aggregate_utility")).alias("beats_aggregate_baseline"),
    )


def failure_summary(selected: DataFrame, outputs: DataFrame) -> DataFrame:
    """Q3: classes (G9) and recorded error types (T5) of the wrong rows that the official routers chose; ``outputs``: id, output_text."""
    failed = selected.filter(F.col("is_official") & ~F.col("is_correct")).join(outputs.select("id", "output_text"), "id")
    graded = G.add_grades(failed).withColumn("extracted_answer", F.col("_g_extracted"))
    return G.add_failure_class(graded).groupBy(
        F.col("task_type").alias("benchmark"), "failure_class", F.coalesce("error_type", F.lit("none")).alias("error_type")).agg(
        F.count(F.lit(1)).alias("count"), mean("cost_usd").alias("avg_cost"), mean("latency_s").alias("avg_latency"))


def win_list(final: DataFrame) -> DataFrame:
    """Q2: benchmarks where the official router beats both baselines (comma list, sorted)."""
    wins = final.filter(F.col("beats_strongest_fixed") & F.col("beats_aggregate_baseline"))
    return wins.agg(F.array_join(F.array_sort(F.collect_list("benchmark")), ",").alias("winning_benchmarks"),
                    F.count(F.lit(1)).alias("n_wins"))


def ablation_table(summary: DataFrame) -> DataFrame:
    """Q4: family → ablation bucket (unknown families pass through), metrics rounded to 6."""
    groups = F.create_map(*[x for k, v in ABLATION_GROUPS.items() for x in (F.lit(k), F.lit(v))])
    cols = [c for c in ("benchmark", "policy", "policy_family") if c in summary.columns]
    return summary.select(*cols, F.coalesce(groups[F.col("policy_family")], F.col("policy_family")).alias("ablation_group"),
                          *[round6(c).alias(c) for c in ("accuracy", "avg_cost", "avg_latency", "utility") if c in summary.columns])


def pareto_points(summary: DataFrame) -> DataFrame:
    """Q5: cost–accuracy points per benchmark; ``is_dominated`` when another point of the
    benchmark costs no more and is strictly more accurate."""
    win = Window.partitionBy("benchmark").orderBy("avg_cost").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return summary.select("benchmark", "policy", "policy_family", "avg_cost", "accuracy",
                          (F.max("accuracy").over(win) > F.col("accuracy")).alias("is_dominated"))


def rank_policies(summary: DataFrame, w: Weights | None = None) -> DataFrame:
    """Utility (avg latency) ranking, overall and among router (phase2) rows,
    metrics rounded to 6, best overall / best router flagged."""
    s = summary.withColumn("utility", summary_utility(w, "avg"))
    order = [F.desc("utility"), F.desc("accuracy"), F.asc("avg_cost"), F.asc("policy")]
    is_p2 = F.col("policy_family").startswith("phase2_")
    s = s.withColumn("rank_overall", F.row_number().over(Window.orderBy(*order)))
    s = s.withColumn("rank_in_phase2", F.when(is_p2, F.row_number().over(Window.partitionBy(is_p2).orderBy(*order))))
    metrics = [c for c in ("accuracy", "avg_cost", "avg_latency", "avg_route_confidence", "fallback_rate", "utility") if c in s.columns]
    return s.select(*[round6(c).alias(c) if c in metrics else F.col(c) for c in s.columns],
                    (F.col("rank_overall") == 1).alias("is_best_overall"), (F.col("rank_in_phase2") == 1).alias("is_best_phase2"))


# ---------------------------------------------------------------------------
# A11 bootstrap CI
# ---------------------------------------------------------------------------

#: Means up to this are drawn by exact inversion, larger ones from the normal quantile with a skewness term.
EXACT_MEAN, EXACT_TERMS = 16, 96
#: FIXED VALUES: coefficients of Acklam's rational approximation of the normal quantile (relative error under 1.2e-9).
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_TAIL = 0.02425


def _polynomial(coefficients: tuple, x: Column, last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in [*coefficients[1:], *([last] if last is not None else [])]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(u: Column) -> Column:
    """The standard normal quantile of ``u`` in (0, 1)."""
    middle, tail = u - 0.5, F.sqrt(-2.0 * F.log(F.least(u, 1.0 - u)))
    inner = _polynomial(QUANTILE_A, middle * middle) * middle / _polynomial(QUANTILE_B, middle * middle, 1.0)
    outer = _polynomial(QUANTILE_C, tail) / _polynomial(QUANTILE_D, tail, 1.0)
    return F.when(u < QUANTILE_TAIL, outer).when(u > 1.0 - QUANTILE_TAIL, -outer).otherwise(inner)


def poisson_draw(u: Column, mean: Column) -> Column:
    """A Poisson variate of a whole ``mean`` from one uniform number by inversion."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
    step = lambda a, j: F.struct((a["p"] * mean / j).alias("p"), (a["c"] + a["p"] * mean / j).alias("c"), (a["k"] + (u >= a["c"]).cast("int")).alias("k"))
    exact = F.aggregate(F.sequence(F.lit(1), F.lit(EXACT_TERMS)), start, step)["k"].cast("long")
    z = normal_quantile(u)
    near = F.greatest(F.floor(mean + F.sqrt(mean) * z + (z * z - 1.0) / 6.0 + 0.5), F.lit(0)).cast("long")
    return F.when(mean <= EXACT_MEAN, exact).otherwise(near)


def poisson1_thresholds() -> list[float]:
    """CDF of Poisson(1) at 0, 1, ... until it no longer grows in double precision: no weight is cut off."""
    out, p, c, k = [], math.exp(-1.0), 0.0, 0
    while c + p > c:
        c += p
        out.append(c)
        k += 1
        p = p / k
    return out


def poisson1_weight(digest: Column) -> Column:
    """The Poisson(1) variate of the uniform number that the first 13 hex digits of ``digest`` stand for: that number is at
    least a threshold if the digits are, as text, at least the threshold's own."""
    steps = [f"{math.ceil(t * 16**13):013x}" for t in poisson1_thresholds() if t < 1.0]
    weight = F.when(digest < steps[0], 0)
    for k, step in enumerate(steps[1:], 1):
        weight = weight.when(digest < step, k)
    return weight.otherwise(len(steps))


def _row_weights(df: DataFrame, value: str, by: list[str], b: int, seed: int, key: str) -> DataFrame:
    """As ``bootstrap_weights``, from a Poisson(1) draw of each row and replicate, by the hash of (seed, replicate, key).  Draws
    are added up in every task before the shuffle."""
    rows = df.select(*by, F.col(key).cast("string").alias("_k"), F.col(value).cast("double").alias("_x")).where("_x is not null")
    each = rows.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_rep").cast("string"), F.col("_k")))
    drawn = each.select(*by, "_x", "_rep", digest.alias("_d")).select(*by, "_x", "_rep", poisson1_weight(F.col("_d")).alias("_w"))
    return drawn.groupBy(*by, "_x", "_rep").agg(F.sum("_w").alias("_w"))


def bootstrap_weights(df: DataFrame, value: str, by: list[str], b: int, seed: int, key: str | None = None) -> DataFrame:
    """``by, _x, _rep, _w``: how often each distinct value of a group is drawn in each of ``b`` replicates.

    With ``key`` every row is drawn on its own, by that column.  Otherwise:

    The rows that share a value are drawn together: a value that ``n`` rows hold gets one Poisson(n) number, from the hash of
    (seed, replicate, group, value), in place of a Poisson(1) number for each row.  The work is ``b`` times the distinct
    values, whatever the number of rows."""
    if key is not None:
        return _row_weights(df, value, by, b, seed, key)
    counts = df.select(*by, F.col(value).cast("double").alias("_x")).where("_x is not null").groupBy(*by, "_x").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    each = counts.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    parts = [F.lit(str(seed)), F.col("_rep").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.col("_x").cast("string")]
    # the middle of one of 2**52 equal steps, so the number is never 0 or 1
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(16**13))
    return each.select(*by, "_x", "_rep", poisson_draw(u, F.col("_n")).alias("_w"))


def bootstrap_ci(df: DataFrame, value: str, by: list[str], b: int = 1000, confidence: float = 0.95, seed: int = 0, key: str | None = None) -> DataFrame:
    """Per-group bootstrap CI of a mean, by Poisson weights of the group's rows (``key``: their id), or of its distinct
    values without a key.  Only ``b`` means per group are collected; a replicate of total weight 0 (probability e^-n) is left out."""
    alpha = max(0.0, min(1.0, 1.0 - confidence))
    lo, hi = int(math.floor((alpha / 2.0) * (b - 1))), int(math.ceil((1.0 - alpha / 2.0) * (b - 1)))
    weights = bootstrap_weights(df, value, by, b, seed, key)
    means = weights.groupBy(*by, "_rep").agg(F.try_divide(total(F.col("_w") * F.col("_x")), F.sum("_w")).alias("_m")).where("_m is not null")
    ci = means.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(F.array_sort(F.collect_list("_m")).alias("_ms"))
    whole = df.select(*by, F.col(value).cast("double").alias("_x")).where("_x is not null").groupBy(*by).agg(mean("_x").alias("mean"))
    return whole.join(ci, same_keys(by, [f"_k_{c}" for c in by]), "left").select(
        *by, "mean", F.try_element_at("_ms", F.lit(lo + 1)).alias("lower"), F.try_element_at("_ms", F.lit(hi + 1)).alias("upper"))
