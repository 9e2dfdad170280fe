"""Trace tables derived from the driver's parquet tables.

The driver's test data holds no model traces, so we derive three views
(defined in FIXTURES.md §3) with plain DataFrame code:

* ``samples``   — one benchmark sample per ``documents`` row;
* ``grid``      — every sample × 3 models × 3 budgets, one trace each;
* ``trace_log`` — one trace per ``events`` row (real timestamps).

The model × budget product is a fixed 9-entry literal dimension, expanded with
``explode`` inside the scan stage: no join, no shuffle, partitioning of the
document scan is kept, and the work grows linearly with ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture model pool and budget axis of the derived grid (our test fixture).
FIXTURE_MODELS = ((0, "m-cheap", "cheap", 0.0003), (1, "m-mid", "mid", 0.0012), (2, "m-strong", "strong", 0.0040))
FIXTURE_BUDGETS = ((0, 0), (1, 256), (2, 1024))

BACKSLASH = "\\"
NEWLINE = "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: an input of few splits would leave most of them idle
    in a stage that works hard on each row.  Large inputs have more splits and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _s(c: Column) -> Column:
    return c.cast("string")


def samples_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_from_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id"))


def samples_from_documents(docs: DataFrame) -> DataFrame:
    """One sample per row of ``docs`` (doc_id, text, n_chars), a table or a stream."""
    d = F.col("doc_id")
    m4 = d % 4
    task = F.when(m4 == 0, "gsm8k").when(m4 == 1, "math").when(m4 == 2, "humaneval").otherwise("custom")
    split = F.when(d % 10 < 6, "train").when(d % 10 < 8, "dev").otherwise("test")
    suffix = (
        F.when(m4 == 0, F.concat(F.lit(" Add "), _s(d % 97), F.lit(" and "), _s(d % 13), F.lit(". How many in total?")))
        .when(m4 == 1, F.concat(F.lit(" Solve x^2 - "), _s(d % 9), F.lit("*x + "), _s(d % 7), F.lit(" = 0.")))
        .when(m4 == 2, F.lit(" def solve(xs): return the sum; assert solve([1, 2]) == 3"))
        .otherwise(F.lit(""))
    )
    expected = F.when(m4 == 2, F.lit("pass")).otherwise(_s(d % 97 + d % 13))
    return docs.select(
        d,
        F.concat(F.lit("doc_"), _s(d)).alias("sample_id"),
        task.alias("task_type"),
        split.alias("split"),
        F.concat("text", suffix).alias("query"),
        expected.alias("expected_answer"),
        "n_chars",
    )


def _fixture_dimension() -> Column:
    rows = [
        F.struct(
            F.lit(mi).alias("mi"), F.lit(model).alias("model_id"), F.lit(tier).alias("tier"),
            F.lit(price).alias("cost_per_1k"), F.lit(bi).alias("bi"), F.lit(budget).alias("budget"),
        )
        for mi, model, tier, price in FIXTURE_MODELS
        for bi, budget in FIXTURE_BUDGETS
    ]
    return F.array(*rows)


def grid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_from_samples(samples_view(spark, sf_dir))


def grid_from_samples(s: DataFrame) -> DataFrame:
    """Nine traces per sample, of a table or a stream."""
    x = s.select("*", F.explode(_fixture_dimension()).alias("c")).select(
        "doc_id", "sample_id", "query", "task_type", "split", "expected_answer", "n_chars", "c.*"
    )
    d, mi, bi = F.col("doc_id"), F.col("mi"), F.col("bi")
    h = (d * 31 + mi * 17 + bi * 7) % 100
    tpl = (d * 13 + mi * 29 + bi * 11) % 8
    a = _s(d % 97 + d % 13 + F.when((d * 31 + mi * 17 + bi * 7) % 3 == 0, 1).otherwise(0))
    a2 = _s((d % 97 + d % 13 + F.when((d * 31 + mi * 17 + bi * 7) % 3 == 0, 1).otherwise(0)) * 2)
    correct = h < mi * 15 + bi * 5 + 45
    failed = h >= 97
    tokens = (F.col("n_chars") % 500).cast("bigint") + 50 + bi * 64
    text = (
        F.when(tpl == 0, F.concat(F.lit("Final answer: "), a))
        .when(tpl == 1, F.concat(F.lit("**Answer:**" + NEWLINE + "It takes **"), a, F.lit(" minutes** (or 2 hours).")))
        .when(tpl == 2, F.concat(F.lit("We get " + BACKSLASH + "boxed{" + BACKSLASH + "frac{"), a2, F.lit("}{2}}.")))
        .when(tpl == 3, F.concat(F.lit("Step 1 gives 5. So the total is "), a, F.lit(".00")))
        .when(tpl == 4, F.concat(F.lit("So #### 1,"), F.lpad(a, 3, "0")))
        .when(tpl == 5, F.lit("I cannot solve this."))
        .when(tpl == 6, F.concat(F.lit("After solving," + NEWLINE + "x = "), a))
        .otherwise(F.lit("```python" + NEWLINE + "def solve(xs):" + NEWLINE + "    return sum(xs)" + NEWLINE + "```"))
    )
    return x.select(
        (d * 9 + mi * 3 + bi).alias("id"),
        "sample_id", "query", "task_type", "split", "expected_answer",
        F.col("model_id").alias("selected_model"),
        F.col("tier").alias("selected_model_tier"),
        F.col("budget").alias("selected_budget"),
        correct.alias("is_correct"),
        F.when(failed, "APIConnectionError").when(h >= 90, "parse_error").when(correct, F.lit(None).cast("string"))
        .otherwise("wrong_answer").alias("error_type"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(tokens).alias("total_tokens"),
        F.when(failed, F.lit(0.0)).otherwise(tokens / F.lit(1000.0) * F.col("cost_per_1k")).alias("cost_usd"),
        F.when(failed, F.lit(0.0)).otherwise(((h * 37) % 500) / F.lit(100.0) + bi * F.lit(2.0)).alias("latency_s"),
        F.when(failed, F.lit("")).otherwise(text).alias("output_text"),
    )


def trace_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return trace_log_from_events(ev)


def trace_log_from_events(ev: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return ev.select(
        e.alias("id"),
        F.concat(F.lit("user_"), _s(F.col("user_id"))).alias("sample_id"),
        F.col("event_type").alias("task_type"),
        F.col("ts").alias("created_at"),
        F.when(e % 3 == 0, "m-cheap").when(e % 3 == 1, "m-mid").otherwise("m-strong").alias("selected_model"),
        F.when(F.floor(e / 3).cast("bigint") % 3 == 0, 0).when(F.floor(e / 3).cast("bigint") % 3 == 1, 256)
        .otherwise(1024).alias("selected_budget"),
        F.col("value").alias("latency_s"),
        (F.col("value") / F.lit(1000.0)).alias("cost_usd"),
        F.get_json_object("props", "$.k").cast("bigint").alias("total_tokens"),
        ((F.col("event_type") != "error") & (e % 7 != 0)).alias("is_correct"),
    )
