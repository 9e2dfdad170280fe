"""Budget and model dimension expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.config import (
    ALIAS_PROVIDER, BUDGET_LEVELS, BUDGET_PROMPTS, DEFAULT_BACKEND, DEFAULT_COST_PER_1K, EFFORT_BY_BUDGET, MAX_OUTPUT_TOKENS_BY_BUDGET, MOCK, MODEL_ALIASES, PROMPT_TEMPLATE_VERSION,
    REASONING_MODE_BY_BUDGET, REPAIR_BUDGET, TIER_NAME_TOKENS,
)


def clamp_budget(b: Column) -> Column:
    """P5: nearest level; equal distance → the smaller level (levels tried in ascending order)."""
    best = F.array_min(F.array(*[F.struct(F.abs(b - F.lit(x)).alias("d"), F.lit(x).alias("x")) for x in BUDGET_LEVELS]))
    return F.when(b.isNull(), F.lit(None)).otherwise(best["x"])


def repair_budget(b: Column) -> Column:
    """A value that is not a level becomes 1024."""
    return F.when(b.isin(*BUDGET_LEVELS), b).otherwise(F.lit(REPAIR_BUDGET))


def budget_dimension(spark) -> DataFrame:
    """The budget dimension (4 rows) as a literal DataFrame."""
    rows = []
    for b in BUDGET_LEVELS:
        controls = {"reasoning_effort": EFFORT_BY_BUDGET[b]}
        if b in REASONING_MODE_BY_BUDGET:
            controls["reasoning_mode"] = REASONING_MODE_BY_BUDGET[b]
        rows.append((b, f"budget-{b}", EFFORT_BY_BUDGET[b], MAX_OUTPUT_TOKENS_BY_BUDGET[b], controls, PROMPT_TEMPLATE_VERSION,
                     BUDGET_PROMPTS[b]))
    return spark.createDataFrame(rows, "legacy_budget int, budget_id string, effort_level string, max_output_tokens int, "
                                       "provider_controls map<string,string>, prompt_template_version string, prompt_instruction string")


def with_budget_config(df: DataFrame, budget_col: str = "selected_budget") -> tuple[DataFrame, DataFrame]:
    """Attach the budget config (broadcast of the 4-row dimension); unknown levels are
    returned separately with a reason instead of raising."""
    dim = F.broadcast(budget_dimension(df.sparkSession))
    j = df.join(dim, F.col(budget_col) == F.col("legacy_budget"), "left")
    good = j.filter(F.col("budget_id").isNotNull()).drop("legacy_budget")
    bad = j.filter(F.col("budget_id").isNull()).select(*df.columns, F.lit("unsupported_budget").alias("reject_reason"))
    return good, bad


def infer_tier(name: Column) -> Column:
    """flash/cheap/mini → cheap; plus/mid → mid; max/strong/pro → strong; else null."""
    low = F.lower(name)
    expr = None
    for tier, tokens in TIER_NAME_TOKENS:
        cond = None
        for t in tokens:
            c = F.instr(low, t) > 0
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, tier) if expr is None else expr.when(cond, tier)
    return expr


def with_cost(df: DataFrame, price_col: str = "cost_per_1k_tokens", tokens_col: str = "total_tokens") -> DataFrame:
    """cost = tokens / 1000 × price (default price when unknown)."""
    price = F.coalesce(F.col(price_col), F.lit(DEFAULT_COST_PER_1K)) if price_col in df.columns else F.lit(DEFAULT_COST_PER_1K)
    return df.withColumn("cost_usd", F.col(tokens_col) / F.lit(1000.0) * price)


def resolve_models(df: DataFrame, name_col: str, ids: dict[str, str] | None = None, prices: dict[str, float] | None = None,
                   backend: str = DEFAULT_BACKEND) -> DataFrame:
    """``df`` with ``model_id, backend, provider, tier, alias, cost_per_1k_tokens`` of the named model.

    A name is an alias, the model id that stands behind an alias (white space around it does not matter), or any other
    model, whose tier is read from its name.  ``ids`` and ``prices`` replace the aliases' own; models called mock cost
    nothing.  The aliases are a fixed literal, so no row moves."""
    ids, prices = ids or {}, prices or {}
    known = [(alias, ids.get(alias, "").strip() or model, tier, float(prices.get(alias, price))) for alias, model, tier, price in MODEL_ALIASES]
    name = F.col(name_col)
    found = F.lit(None).cast("struct<alias:string,model:string,tier:string,price:double>")
    for alias, model, tier, price in reversed(known):
        entry = F.struct(F.lit(alias).alias("alias"), F.lit(model).alias("model"), F.lit(tier).alias("tier"), F.lit(price).alias("price"))
        found = F.when(F.btrim(name) == model, entry).otherwise(found)
    for alias, model, tier, price in known:  # an alias goes before a model id
        entry = F.struct(F.lit(alias).alias("alias"), F.lit(model).alias("model"), F.lit(tier).alias("tier"), F.lit(price).alias("price"))
        found = F.when(name == alias, entry).otherwise(found)
    df = df.withColumn("_known", found)
    k = F.col("_known")
    model = F.coalesce(k["model"], name)
    mock = model.startswith(MOCK)
    own = F.when(mock, F.lit(MOCK)).otherwise(F.lit(backend))
    made = {
        "model_id": model, "backend": F.when(mock, MOCK).otherwise(F.when(k.isNotNull(), F.lit(DEFAULT_BACKEND)).otherwise(F.lit(backend))),
        "provider": F.when(k.isNotNull(), ALIAS_PROVIDER).otherwise(F.when(own == MOCK, MOCK).otherwise(F.lit(DEFAULT_BACKEND))),
        "tier": F.when(k.isNotNull(), k["tier"]).otherwise(infer_tier(name)), "alias": F.coalesce(k["alias"], name),
        "cost_per_1k_tokens": F.when(k.isNotNull(), k["price"]).otherwise(F.when(mock, 0.0).otherwise(F.lit(DEFAULT_COST_PER_1K)))}
    return df.withColumns(made).drop("_known")
