"""Trace table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.functions.text import blank_to_null
from gridstone.sources.literals import parse_literal, write_literal


def latest_traces(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recent traces by id (top-k: TakeOrderedAndProject, no full sort)."""
    return df.orderBy(F.desc("id")).limit(n)


# FIXED VALUES: columns of the trace table that older files may lack, their types and defaults.
DEFAULTS = {
    "schema_version": ("int", 2), "query_id": ("string", None), "benchmark": ("string", None), "query_text": ("string", None),
    "selected_model_provider": ("string", None), "selected_model_tier": ("string", None), "selected_model_alias": ("string", None),
    "selected_budget_id": ("string", None), "budget_config": ("string", "{}"), "parsed_output": ("string", None),
    "judge_metadata": ("string", "{}"), "error_type": ("string", None), "router_features": ("string", "{}"),
    "route_reason": ("string", None), "candidate_set_signature": ("string", None), "prompt_template_version": ("string", None),
    "provider_response_meta": ("string", "{}"), "route_confidence": ("double", None), "fallback_triggered": ("boolean", False),
    "fallback_reason": ("string", None),
}
NOT_NULL = ("schema_version", "budget_config", "judge_metadata", "router_features", "provider_response_meta", "fallback_triggered")


def conform_traces(df: DataFrame) -> DataFrame:
    """Every column of the trace table, missing ones with their default, null ones too where null is not allowed."""
    made = {}
    for name, (kind, default) in DEFAULTS.items():
        if name not in df.columns:
            made[name] = F.lit(default).cast(kind)
        elif name in NOT_NULL:
            made[name] = F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind))
    return df.withColumns(made) if made else df


def append_traces(df: DataFrame, path: str) -> None:
    """Append traces with defaults filled: query id from the sample, budget id from the budget."""
    df = conform_traces(df)
    df = df.withColumn("query_id", F.coalesce("query_id", F.col("sample_id"), F.lit("")))
    df = df.withColumn("selected_budget_id", F.coalesce("selected_budget_id", F.concat(F.lit("budget-"), F.col("selected_budget").cast("string"))))
    df.write.mode("append").parquet(path)


def read_traces(spark, path: str) -> DataFrame:
    """All traces of a table, whatever the age of its files, in id order."""
    return conform_traces(spark.read.option("mergeSchema", "true").parquet(path)).orderBy("id")


# ---------------------------------------------------------------------------
# CSV files with dict literals (S7), stored JSON columns
# ---------------------------------------------------------------------------

LITERAL_COLUMNS = ("budget_config", "judge_metadata", "router_features", "provider_response_meta", "metadata")
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "lineSep": "\n", "nullValue": "", "emptyValue": '""'}


def write_trace_csv(df: DataFrame, path: str) -> None:
    """Traces as CSV; map columns are written as dict literals, texts may hold quotes, commas and line ends."""
    maps = {c: write_literal(F.col(c)) for c, t in df.dtypes if t.startswith("map<")}
    (df.withColumns(maps) if maps else df).write.options(**_CSV).csv(path)


def read_trace_csv(spark, path: str, schema: str) -> DataFrame:
    """Traces of CSV files by a schema; columns that it calls ``map<string,string>`` are parsed from dict literals.
    Numbers that look like answers stay text if the schema says so.  A file with line ends in its fields is read by one task."""
    fields = spark.createDataFrame([], schema).schema
    maps = [f.name for f in fields if f.dataType.simpleString().startswith("map<")]
    raw = ", ".join(f"`{f.name}` {'string' if f.name in maps else f.dataType.simpleString()}" for f in fields)
    df = spark.read.schema(raw).options(**_CSV).csv(path)
    return df.withColumns({c: parse_literal(F.col(c)) for c in maps}) if maps else df


def decode_traces(df: DataFrame) -> DataFrame:
    """Stored traces with their JSON columns as maps, the query's text and id and the budget's id filled in: the id from
    ``metadata`` (sample, then query), the budget's from its stored configuration, else from the level."""
    empty = F.create_map().cast("map<string,string>")
    df = conform_traces(df if "metadata" in df.columns else df.withColumn("metadata", F.lit("{}")))
    df = df.withColumns({c: F.coalesce(F.from_json(F.coalesce(blank_to_null(F.col(c)), F.lit("{}")), "map<string,string>"), empty) for c in LITERAL_COLUMNS})
    made = {"query_id": F.coalesce(blank_to_null(F.col("query_id")), F.try_element_at("metadata", F.lit("sample_id")), F.try_element_at("metadata", F.lit("query_id")), F.lit("")),
            "selected_budget_id": F.coalesce(blank_to_null(F.col("selected_budget_id")), F.try_element_at("budget_config", F.lit("budget_id")),
                                             F.concat(F.lit("budget-"), F.col("selected_budget").cast("string")))}
    if "query" in df.columns:
        made["query_text"] = F.coalesce(blank_to_null(F.col("query_text")), F.col("query"))
    return df.withColumns(made)
