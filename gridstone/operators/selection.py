"""Dev selection and test replay among several routers (B14), and the report inputs that follow from it.

All routers' decisions are one table (``router_name, sample_id, route_model, route_budget, route_confidence,
fallback_triggered``), so each split is replayed once for all of them: a join on the sample and one grouped minimum.
The uncertainty-aware router is made from two of the others, at every threshold of the sweep on dev and at the
benchmark's best threshold on test.  Summaries are grouped by benchmark, router and threshold; picking works on that
small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.config import THRESHOLD_SWEEP, Weights
from gridstone.functions.utility import summary_utility, with_sample_id
from gridstone.operators.policies import baselines
from gridstone.operators.replay import replay
from gridstone.operators.routers import route_uncertain
from gridstone.operators.summaries import METRIC_COLUMNS, mean, selection_metrics, single_or_mixed
from gridstone.session import cut_lineage

UNCERTAIN = "uncertainty_aware"
DECISION = ["router_name", "sample_id", "route_model", "route_budget", "route_confidence", "fallback_triggered"]
_EXTRA = ["route_confidence", "fallback_triggered"]
_ATTRS = ["selected_model_provider", "selected_model_tier", "selected_model_alias"]


def recorded(decisions: DataFrame, router_name: str) -> DataFrame:
    """One router's decisions as rows of the decision table."""
    fallback = F.coalesce(F.col("fallback_triggered"), F.lit(False)) if "fallback_triggered" in decisions.columns else F.lit(False)
    return decisions.select(
        F.lit(router_name).alias("router_name"), "sample_id", "route_model", F.col("route_budget").cast("int").alias("route_budget"),
        F.col("route_confidence").cast("double").alias("route_confidence"), fallback.alias("fallback_triggered"))


def _of(decisions: DataFrame, router: str) -> DataFrame:
    return decisions.where(F.col("router_name") == router).drop("router_name")


def _uncertain(decisions: DataFrame, primary: str, fallback: str, thresholds: DataFrame | Sequence[float]) -> DataFrame:
    """The uncertainty-aware router's decisions with their ``threshold``: each of a list, or the one of the sample
    (``sample_id, threshold``)."""
    base = _of(decisions, fallback)
    if isinstance(thresholds, DataFrame):
        base = base.join(thresholds, "sample_id")
    else:
        base = base.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    made = route_uncertain(_of(decisions, primary), base, F.col("threshold"))
    return made.select(F.lit(UNCERTAIN).alias("router_name"), *DECISION[1:], "threshold")


def replayed(grid: DataFrame, decisions: DataFrame) -> DataFrame:
    """The chosen trace row of every sample under every router and threshold."""
    return replay(grid, decisions, ("sample_id",), _EXTRA, group_extra=("router_name", "threshold"))


def router_rows(selected: DataFrame, benchmark: str = "task_type", w: Weights | None = None) -> DataFrame:
    """A4 summary rows per benchmark, router and threshold, with the p95 utility."""
    attrs = [single_or_mixed(c).alias(c) if c in selected.columns else F.lit(None).cast("string").alias(c) for c in ("selected_model", *_ATTRS, "selected_budget")]
    rows = selected.groupBy(F.col(benchmark).alias("benchmark"), "router_name", "threshold").agg(
        *selection_metrics(), *attrs, mean("route_confidence").alias("avg_route_confidence"),
        F.avg(F.coalesce("fallback_triggered", F.lit(False)).cast("double")).alias("fallback_rate"), F.avg(F.col("matched").cast("double")).alias("match_rate"))
    name = F.concat(F.lit("phase2_"), "router_name")
    return rows.withColumn("policy", name).withColumn("policy_family", name).withColumn("utility", summary_utility(w, "p95"))


def choose_routers(dev_rows: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Per benchmark the sweep's first best threshold and the candidate with the best dev summary (utility desc, accuracy
    desc, cost asc, then the candidates' order)."""
    sweep = Window.partitionBy("benchmark", "router_name").orderBy(F.desc("utility"), F.asc("threshold"))
    best = dev_rows.withColumn("_t", F.row_number().over(sweep)).where("_t = 1")
    place = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("router_name"))
    order = Window.partitionBy("benchmark").orderBy(F.desc("utility"), F.desc("accuracy"), F.asc("avg_cost"), F.asc("_place"))
    threshold = F.max(F.when(F.col("router_name") == UNCERTAIN, F.col("threshold"))).over(Window.partitionBy("benchmark"))
    ranked = best.withColumn("uncertainty_threshold", threshold).withColumn("_place", place).where("_place > 0").withColumn("_rn", F.row_number().over(order))
    return ranked.where("_rn = 1").select(
        "benchmark", F.col("router_name").alias("official_router_name"), F.col("policy").alias("official_router_policy"),
        "uncertainty_threshold", F.col("utility").alias("dev_utility"))


def select_on_dev(dev: DataFrame, decisions: DataFrame, primary: str, candidates: Sequence[str], fallback: str = "threshold",
                  thresholds: Sequence[float] = THRESHOLD_SWEEP, benchmark: str = "task_type", w: Weights | None = None) -> DataFrame:
    """B14, first half: the selection table (one row per benchmark) from the dev grid and all routers' decisions."""
    # the winners' rows are summed up and dropped: each trace is met once a router and threshold, with what the sums need only
    needed = ("sample_id", "id", benchmark, "selected_model", "selected_budget", *_ATTRS, "is_correct", "cost_usd", "latency_s")
    dev = with_sample_id(dev)
    dev = dev.select(*[c for c in dict.fromkeys(needed) if c in dev.columns])
    plain = decisions.select(*DECISION, F.lit(None).cast("double").alias("threshold"))
    every = plain.unionByName(_uncertain(decisions, primary, fallback, thresholds))
    return choose_routers(router_rows(replayed(dev, every), benchmark, w), candidates)


def replay_on_test(test: DataFrame, decisions: DataFrame, selection: DataFrame, primary: str, fallback: str = "threshold",
                   benchmark: str = "task_type") -> DataFrame:
    """B14, second half: all routers replayed on the test grid, the uncertainty-aware one at its benchmark's threshold.
    ``is_official`` marks the rows of the router that dev picked."""
    picked = selection.select(F.col("benchmark").alias("_b"), "uncertainty_threshold", "official_router_name")
    test = with_sample_id(test)
    of_sample = test.groupBy("sample_id").agg(F.min(benchmark).alias("_s")).join(picked, F.col("_s").eqNullSafe(F.col("_b")))
    at = of_sample.select("sample_id", F.col("uncertainty_threshold").alias("threshold"))
    plain = decisions.select(*DECISION, F.lit(None).cast("double").alias("threshold"))
    chosen = replayed(test, plain.unionByName(_uncertain(decisions, primary, fallback, at)))
    official = F.col("router_name") == F.col("official_router_name")
    return chosen.join(picked, F.col(benchmark).eqNullSafe(F.col("_b")), "left").withColumn("is_official", F.coalesce(official, F.lit(False))).drop(
        "_b", "uncertainty_threshold", "official_router_name")


def integrated_summary(test: DataFrame, selected: DataFrame, benchmark: str = "task_type", w: Weights | None = None) -> DataFrame:
    """Per benchmark: all baseline families (B7) and all replayed routers (A4), with the official p95 utility."""
    base = baselines(test, [benchmark], w).withColumnRenamed(benchmark, "benchmark").withColumn("selected_budget", F.col("selected_budget").cast("string"))
    none = lambda t: F.lit(None).cast(t)
    base = base.withColumns({"router_name": none("string"), "avg_route_confidence": none("double"), "fallback_rate": none("double"), "match_rate": none("double")})
    base = base.withColumn("utility", summary_utility(w, "p95"))
    columns = ["benchmark", "policy", "policy_family", "router_name", "selected_model", *_ATTRS, "selected_budget", *METRIC_COLUMNS,
               "avg_route_confidence", "fallback_rate", "match_rate", "utility"]
    return cut_lineage(base.select(*columns).unionByName(router_rows(selected, benchmark, w).select(*columns)))
