"""Utility expressions (P2, P3) and sample-id resolution.

Two utilities exist (trap T1): policy *choice* uses average latency, official
*ranking* uses p95 latency falling back to the average, then 0.  Each caller
names the latency column it wants; there is no shared default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.config import Weights


def row_utility(w: Weights | None = None, correct: str = "is_correct", cost: str = "cost_usd", latency: str = "latency_s") -> Column:
    """Row utility ``alpha*correct - beta*cost - gamma*latency``."""
    w = w or Weights()
    return (
        F.lit(w.alpha) * F.coalesce(F.col(correct).cast("double"), F.lit(0.0))
        - F.lit(w.beta) * F.coalesce(F.col(cost).cast("double"), F.lit(0.0))
        - F.lit(w.gamma) * F.coalesce(F.col(latency).cast("double"), F.lit(0.0))
    )


def with_utility(df: DataFrame, w: Weights | None = None, latency_col: str = "latency_s", name: str = "utility") -> DataFrame:
    return df.withColumn(name, row_utility(w, latency=latency_col))


def summary_utility(w: Weights | None = None, latency: str = "avg") -> Column:
    """Summary utility (P3): ``latency='avg'`` (policy choice) or ``'p95'`` (official ranking)."""
    w = w or Weights()
    acc = F.coalesce(F.col("accuracy").cast("double"), F.lit(0.0))
    cost = F.coalesce(F.col("avg_cost").cast("double"), F.lit(0.0))
    if latency == "p95":
        lat = F.coalesce(F.col("p95_latency").cast("double"), F.col("avg_latency").cast("double"), F.lit(0.0))
    else:
        lat = F.coalesce(F.col("avg_latency").cast("double"), F.lit(0.0))
    return F.lit(w.alpha) * acc - F.lit(w.beta) * cost - F.lit(w.gamma) * lat


def with_sample_id(df: DataFrame) -> DataFrame:
    """Existing ``sample_id``, else ``metadata['sample_id']``, else the row id as text."""
    cols = set(df.columns)
    candidates = []
    if "sample_id" in cols:
        candidates.append(F.col("sample_id").cast("string"))
    if "metadata" in cols:
        meta_type = df.schema["metadata"].dataType.typeName()
        if meta_type == "map":
            candidates.append(F.col("metadata").getItem("sample_id").cast("string"))
        elif meta_type == "struct" and "sample_id" in df.schema["metadata"].dataType.fieldNames():
            candidates.append(F.col("metadata.sample_id").cast("string"))
    if "id" in cols:
        candidates.append(F.col("id").cast("string"))
    if not candidates:
        raise ValueError("no column to derive sample_id from")
    return df.withColumn("sample_id", F.coalesce(*candidates))


def without_failed(df: DataFrame) -> DataFrame:
    """T4: rows of calls that failed (an error and no tokens) left out; such rows cost nothing and would win every
    choice of the cheapest row."""
    failed = (F.col("total_tokens") == 0) & F.col("error_type").isNotNull()
    return df.filter(~F.coalesce(failed, F.lit(False)))
