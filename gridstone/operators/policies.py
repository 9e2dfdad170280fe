"""Fixed, aggregate, fallback and oracle policies.

The reference filters the trace table once per policy and loops over models
and budgets.  Here every fixed / model-only / budget-only statistic comes from
ONE ``cube(selected_model, selected_budget)`` aggregation (one scan, one
shuffle of partial aggregates), and the winners are applied as scalar
subqueries over that tiny table.  Only the oracle and safe-fallback policies need
a per-sample pass, each a single hash aggregate keyed by ``sample_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.config import RECOVERABLE_ERRORS, Weights
from gridstone.functions.utility import summary_utility, with_sample_id, without_failed
from gridstone.operators.summaries import METRIC_COLUMNS, first_non_null, metrics_by, selection_metrics, summarize_selection
from gridstone.session import cut_lineage

MODEL = "selected_model"
BUDGET = "selected_budget"


def rank_order() -> list:
    """Best-first order of summary rows: utility desc, accuracy desc, avg_cost asc."""
    return [F.desc("utility"), F.desc("accuracy"), F.asc("avg_cost")]


def model_budget_stats(df: DataFrame, w: Weights | None = None, exact: bool = True) -> DataFrame:
    """Accuracy, avg cost, avg/p95 latency, n and utility per (model, budget)."""
    return metrics_by(df, (MODEL, BUDGET), exact).withColumn("utility", summary_utility(w, "avg"))


def policy_stats(df: DataFrame, w: Weights | None = None, exact: bool = True) -> DataFrame:
    """All fixed-policy statistics in one cube: level in {model_budget, model, budget, all}."""
    level = (
        F.when(F.col("_gid") == 0, "model_budget").when(F.col("_gid") == 1, "model")
        .when(F.col("_gid") == 2, "budget").otherwise("all")
    )
    st = df.cube(MODEL, BUDGET).agg(*selection_metrics(exact), F.grouping_id().alias("_gid"))
    return st.withColumn("level", level).drop("_gid").withColumn("utility", summary_utility(w, "avg"))


def _ranked(stats: DataFrame) -> DataFrame:
    """Rank rows of the (tiny, dimension-bounded) stats table inside each level."""
    win = Window.partitionBy("level").orderBy(*rank_order(), F.asc_nulls_last(MODEL), F.asc_nulls_last(BUDGET))
    return stats.withColumn("level_rank", F.row_number().over(win))


def best_choices(df: DataFrame, w: Weights | None = None, exact: bool = True) -> DataFrame:
    """One row per level with the winning model / budget / (model, budget)."""
    return _ranked(policy_stats(df, w, exact)).filter(F.col("level_rank") == 1).drop("level_rank")


def _winner(df: DataFrame, level: str, w: Weights | None, exact: bool) -> DataFrame:
    """The level's winner, written: the cube is aggregated once however many values are taken from it."""
    return cut_lineage(best_choices(df, w, exact).filter(F.col("level") == level))


def aggregate_policy(df: DataFrame, w: Weights | None = None, exact: bool = True) -> DataFrame:
    """All rows of the best (model, budget) with ``policy_selected_utility``.

    The winner is a scalar subquery over the tiny stats table: a filter on the
    trace table, no join and no driver round trip.
    """
    best = _winner(df, "model_budget", w, exact)
    m, b, u = best.select(MODEL).scalar(), best.select(BUDGET).scalar(), best.select("utility").scalar()
    return df.filter((F.col(MODEL) == m) & (F.col(BUDGET) == b)).withColumn("policy_selected_utility", u)


def model_only(df: DataFrame, w: Weights | None = None, exact: bool = True) -> DataFrame:
    """All rows of the best model."""
    return df.filter(F.col(MODEL) == _winner(df, "model", w, exact).select(MODEL).scalar())


def budget_only(df: DataFrame, w: Weights | None = None, exact: bool = True) -> DataFrame:
    """All rows of the best budget."""
    return df.filter(F.col(BUDGET) == _winner(df, "budget", w, exact).select(BUDGET).scalar())


def fixed_model_budget(df: DataFrame, exact: bool = True) -> DataFrame:
    """B1: one summary row per (model, budget) pair — one aggregation, no loop."""
    return df.groupBy(MODEL, BUDGET).agg(*selection_metrics(exact)).select(
        F.concat(F.lit("fixed_"), F.col(MODEL), F.lit("_budget_"), F.col(BUDGET).cast("string")).alias("policy"),
        MODEL, BUDGET, *METRIC_COLUMNS,
    )


def fixed_budget(df: DataFrame, exact: bool = True) -> DataFrame:
    """B2: one summary row per budget (several rows per sample: n counts rows, T12)."""
    return df.groupBy(BUDGET).agg(*selection_metrics(exact)).select(
        F.concat(F.lit("fixed_budget_"), F.col(BUDGET).cast("string")).alias("policy"), BUDGET, *METRIC_COLUMNS
    )


def _tiebreak(df: DataFrame) -> list[Column]:
    extra = [F.col(c) for c in (MODEL, BUDGET, "id") if c in df.columns]
    return extra


def oracle_policy(df: DataFrame, exclude_failed: bool = False) -> DataFrame:
    """Cheapest correct row per sample, else cheapest row.

    An aggregate ``min_by(row, key)`` keyed by sample: combines map-side, so a hot
    sample never sends all its rows to one task.  Texts are not ranked: join them
    to the result by ``id`` where they are wanted.  ``exclude_failed`` leaves failed calls out (T4).
    """
    df = with_sample_id(without_failed(df) if exclude_failed else df).drop("query", "output_text")
    key = F.struct(
        (~F.col("is_correct").cast("boolean")).alias("k0"), F.col("cost_usd").alias("k1"), F.col("latency_s").alias("k2"),
        F.col(BUDGET).alias("k3"), *[c.alias(f"t{i}") for i, c in enumerate(_tiebreak(df))],
    )
    row = F.struct(*[F.col(c) for c in df.columns if c != "sample_id"])
    return df.groupBy("sample_id").agg(F.min_by(row, key).alias("_r")).select("sample_id", "_r.*")


def safe_fallback(
    df: DataFrame,
    primary: DataFrame,
    fallback_budget: Column,
    errors: Sequence[str] = RECOVERABLE_ERRORS,
) -> DataFrame:
    """Primary rows with a recoverable error are replaced by the sample's cheapest
    row (cost, latency, model) at the fallback budget; reason ``recoverable_error:<type>``.
    Samples without such a row keep the primary row.

    ``fallback_budget`` is a column expression (a literal or a scalar subquery).
    The reference rescans the table per failing row (O(n^2)); here it is one
    hash aggregate by sample plus one equi join on ``sample_id``.
    """
    df = with_sample_id(df)
    primary = with_sample_id(primary)
    cols = [c for c in primary.columns if c in df.columns]
    key = F.struct(F.col("cost_usd"), F.col("latency_s"), F.col(MODEL), *[F.col(c) for c in ("id",) if c in df.columns])
    fb = (
        df.filter(F.col(BUDGET) == fallback_budget)
        .groupBy("sample_id")
        .agg(F.min_by(F.struct(*[F.col(c) for c in cols if c != "sample_id"]), key).alias("_fb"))
    )
    err = F.coalesce(F.col("error_type").cast("string"), F.lit(""))
    hit = err.isin(*errors) & F.col("_fb").isNotNull()
    j = primary.join(fb, "sample_id", "left")
    out = [F.when(hit, F.col(f"_fb.{c}")).otherwise(F.col(c)).alias(c) if c != "sample_id" else F.col(c) for c in cols]
    return j.select(
        *out,
        hit.alias("fallback_triggered"),
        F.when(hit, F.concat(F.lit("recoverable_error:"), err)).alias("fallback_reason"),
    )


def policy_table(df: DataFrame, w: Weights | None = None, errors: Sequence[str] = RECOVERABLE_ERRORS, exact: bool = True) -> DataFrame:
    """Fixed (model, budget), fixed budget, oracle, model-only, budget-only,
    aggregate and safe-fallback policies in one table."""
    df = with_sample_id(df)
    ranked = cut_lineage(_ranked(policy_stats(df, w, exact)))
    metrics = [F.col(c) for c in METRIC_COLUMNS]
    b = F.col(BUDGET).cast("string")
    top = F.col("level_rank") == 1
    fixed = ranked.filter(F.col("level") == "model_budget").select(
        F.concat(F.lit("fixed_"), F.col(MODEL), F.lit("_budget_"), b).alias("policy"), *metrics)
    fixed_b = ranked.filter(F.col("level") == "budget").select(F.concat(F.lit("fixed_budget_"), b).alias("policy"), *metrics)
    model_best = ranked.filter((F.col("level") == "model") & top).select(
        F.concat(F.lit("model_only_best_"), F.col(MODEL)).alias("policy"), *metrics)
    budget_best = ranked.filter((F.col("level") == "budget") & top).select(
        F.concat(F.lit("budget_only_best_"), b).alias("policy"), *metrics)
    agg_best = ranked.filter((F.col("level") == "model_budget") & top)
    aggregate = agg_best.select(F.concat(F.lit("aggregate_utility_budget_"), b).alias("policy"), *metrics)
    oracle = summarize_selection(oracle_policy(df), "oracle_lowest_cost_correct", exact)
    best_m, best_b = agg_best.select(MODEL).scalar(), agg_best.select(BUDGET).scalar()
    fb_b = ranked.filter((F.col("level") == "budget") & top).select(BUDGET).scalar()
    primary = df.filter((F.col(MODEL) == best_m) & (F.col(BUDGET) == best_b))
    safe = safe_fallback(df, primary, fb_b, errors)
    safe_sum = summarize_selection(
        safe, F.concat(F.lit("aggregate_utility_safe_fallback_budget_"), fb_b.cast("string")), exact)
    parts = [fixed, fixed_b, oracle.select("policy", *metrics), model_best, budget_best, aggregate, safe_sum.select("policy", *metrics)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Winners of up to so many groups are broadcast.
BROADCAST_GROUPS = 10_000
_ATTRS = ["selected_model_provider", "selected_model_tier", "selected_model_alias"]


def _best_first(partition: list[str]) -> Column:
    order = [*rank_order(), F.asc_nulls_last(MODEL), F.asc_nulls_last(BUDGET)]
    return F.row_number().over(Window.partitionBy(*partition, "level").orderBy(*order))


def baselines(df: DataFrame, by: Sequence[str] = (), w: Weights | None = None, errors: Sequence[str] = RECOVERABLE_ERRORS,
              exact: bool = True) -> DataFrame:
    """The fixed (model, budget), model-only, budget-only, aggregate and safe-fallback rows of every group of ``by``
    (one group without it), with family, model attributes and metrics.

    The table is aggregated once, by grouping sets; the small written result ranks the winners and names the rows.  Only
    the safe-fallback row reads the table again, for the primary and the fallback rows of each sample."""
    keys = list(by) or ["_all"]
    df = with_sample_id(df) if by else with_sample_id(df).withColumn("_all", F.lit(0))
    df = df.withColumns({c: F.lit(None).cast("string") for c in _ATTRS if c not in df.columns})
    order_col = "id" if "id" in df.columns else "sample_id"
    first = [first_non_null(c, order_col).alias(c) for c in _ATTRS]
    stats = cut_lineage(df.groupingSets([[*keys, MODEL, BUDGET], [*keys, MODEL], [*keys, BUDGET]], *keys, MODEL, BUDGET).agg(
        *selection_metrics(exact), *first, F.grouping(MODEL).alias("_no_model"), F.grouping(BUDGET).alias("_no_budget")))
    level = F.when(F.col("_no_budget") == 1, "model").when(F.col("_no_model") == 1, "budget").otherwise("model_budget")
    stats = stats.withColumn("level", level).withColumn("utility", summary_utility(w, "avg"))
    model_attrs = {c: F.max(F.when(F.col("level") == "model", F.col(c))).over(Window.partitionBy(*keys, MODEL)) for c in _ATTRS}
    ranked = stats.withColumns(model_attrs).withColumn("_place", _best_first(keys))
    m, b, none = F.col(MODEL), F.col(BUDGET).cast("string"), lambda t: F.lit(None).cast(t)
    metrics, attrs, no_attrs = [F.col(c) for c in METRIC_COLUMNS], [F.col(c) for c in _ATTRS], [none("string").alias(c) for c in _ATTRS]
    budget = F.col(BUDGET).cast("bigint").alias(BUDGET)
    of = lambda name, top=True: ranked.filter((F.col("level") == name) & ((F.col("_place") == 1) if top else F.lit(True)))
    parts = [
        of("model_budget", False).select(*keys, F.concat(F.lit("fixed_model_budget_"), m, F.lit("_"), b).alias("policy"),
                                         F.lit("fixed_model_budget").alias("policy_family"), m, *attrs, budget, *metrics),
        of("model").select(*keys, F.concat(F.lit("model_only_best_"), m).alias("policy"), F.lit("model_only").alias("policy_family"),
                           m, *attrs, none("bigint").alias(BUDGET), *metrics),
        of("budget").select(*keys, F.concat(F.lit("budget_only_best_"), b).alias("policy"), F.lit("budget_only").alias("policy_family"),
                            none("string").alias(MODEL), *no_attrs, budget, *metrics),
        of("model_budget").select(*keys, F.concat(F.lit("aggregate_utility_"), m, F.lit("_"), b).alias("policy"),
                                  F.lit("joint_aggregate_utility").alias("policy_family"), m, *attrs, budget, *metrics)]
    win = lambda name, c: F.max(F.when((F.col("level") == name) & (F.col("_place") == 1), F.col(c)))
    winners = ranked.groupBy(*keys).agg(win("model_budget", MODEL).alias("_model"), win("model_budget", BUDGET).alias("_budget"), win("budget", BUDGET).alias("_fallback"))
    safe = _safe_rows(df, winners, keys, errors, order_col)
    safe_row = safe.groupBy(*keys, "_model", "_budget", "_fallback").agg(*selection_metrics(exact), *first).select(
        *keys, F.concat(F.lit("aggregate_utility_safe_fallback_"), "_model", F.lit("_"), F.col("_budget").cast("string"), F.lit("_to_"), F.col("_fallback").cast("string")).alias("policy"),
        F.lit("joint_safe_fallback").alias("policy_family"), F.col("_model").alias(MODEL), *attrs, F.col("_budget").cast("bigint").alias(BUDGET), *metrics)
    out = parts[0]
    for p in [*parts[1:], safe_row]:
        out = out.unionByName(p)
    return out if by else out.drop("_all")


def _safe_rows(df: DataFrame, winners: DataFrame, keys: list[str], errors: Sequence[str], order_col: str) -> DataFrame:
    """The winning pair's rows of every group, those with a recoverable error replaced by the sample's cheapest row at the
    winning budget (B6), with the group's winners."""
    row = [c for c in dict.fromkeys(("is_correct", "cost_usd", "latency_s", *_ATTRS, order_col)) if c != "sample_id"]
    small = F.broadcast(winners) if winners.count() <= BROADCAST_GROUPS else winners
    renamed = small.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "_model", "_budget", "_fallback")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    failed = F.col("error_type").cast("string") if "error_type" in df.columns else F.lit(None).cast("string")
    narrow = df.select(*keys, "sample_id", MODEL, BUDGET, failed.alias("_error"), *[c for c in row if c not in keys]).join(renamed, same)
    cheapest = F.struct("cost_usd", "latency_s", MODEL, order_col)
    at_fallback = narrow.filter(F.col(BUDGET) == F.col("_fallback")).groupBy(*[f"_w_{k}" for k in keys], F.col("sample_id").alias("_sample")).agg(
        F.min_by(F.struct(*row), cheapest).alias("_fb"))
    at_fallback = at_fallback.select(*[F.col(f"_w_{k}").alias(f"_f_{k}") for k in keys], "_sample", "_fb")
    matched = F.col("sample_id") == F.col("_sample")
    for k in keys:
        matched = matched & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
    primary = narrow.filter((F.col(MODEL) == F.col("_model")) & (F.col(BUDGET) == F.col("_budget"))).join(at_fallback, matched, "left")
    hit = F.coalesce(F.col("_error"), F.lit("")).isin(*errors) & F.col("_fb").isNotNull()
    return primary.select(*keys, "sample_id", "_model", "_budget", "_fallback", *[F.when(hit, F.col(f"_fb.{c}")).otherwise(F.col(c)).alias(c) for c in row if c not in keys])


def baseline_table(df: DataFrame, w: Weights | None = None, errors: Sequence[str] = RECOVERABLE_ERRORS, exact: bool = True) -> DataFrame:
    """B7 of the whole table; sorted by family, accuracy desc, cost asc."""
    return baselines(df, (), w, errors, exact).orderBy(F.asc("policy_family"), F.desc("accuracy"), F.asc("avg_cost"), F.asc("policy"))


def choose_fallback(df: DataFrame, w: Weights | None = None, exact: bool = True) -> DataFrame:
    """Safe fallback budget (budget of the aggregate-utility winner) + diagnostics."""
    from gridstone.operators.labels import best_per_model

    df = with_sample_id(df)
    ab = best_choices(df, w, exact).filter(F.col("level") == "model_budget")
    n_labels = best_per_model(df.withColumns({"query": F.lit(None), "task_type": F.lit(None)}), w).select(F.countDistinct(BUDGET)).scalar()
    return ab.withColumn("candidate_budget_count", n_labels).select(
        F.lit("fallback_to_aggregate_utility").alias("safe_policy"),
        F.col(BUDGET).alias("fallback_budget"),
        F.col("accuracy").alias("fallback_accuracy"),
        F.col("avg_cost").alias("fallback_avg_cost"),
        F.col("avg_latency").alias("fallback_avg_latency"),
        F.col("candidate_budget_count").cast("bigint").alias("candidate_budget_count"),
        F.col("utility").alias("aggregate_utility"),
    )
