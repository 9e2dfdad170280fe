"""Query catalog: every registered query = Spark builder + DuckDB oracle SQL.

Each builder takes ``(spark, sf_dir)`` and reads the driver's tables (or the
views Spark derives from them), so its work grows with the data.  Double
columns are rounded to 6 places on both sides before the value hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from gridstone.plans.sql_views import with_views
from gridstone.plans.sqlfrag import expand_sums, round_doubles


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: list[str] = field(default_factory=list)
    headline: bool = False
    note: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places as round(x*1e6)/1e6: Spark and DuckDB agree on it bit for bit."""
    return df.select(*[
        (F.round(F.col(f.name) * F.lit(1e6)) / F.lit(1e6)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def register(name: str, sql: str | None, doubles: list[str] | None = None, headline: bool = False, ctes: tuple = (), note: str = ""):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        full = round_doubles(expand_sums(with_views(sql, *ctes)), doubles or []) if sql is not None else None

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        REGISTRY[name] = QuerySpec(name, build, full, list(doubles or []), headline, note)
        return fn

    return deco


def load_all() -> dict[str, QuerySpec]:
    # importing the query modules fills the registry
    from gridstone.plans import queries_core  # noqa: F401
    from gridstone.plans import queries_text  # noqa: F401
    from gridstone.plans import queries_more  # noqa: F401
    from gridstone.plans import queries_reports  # noqa: F401
    from gridstone.plans import queries_learned  # noqa: F401
    from gridstone.plans import queries_extra  # noqa: F401
    from gridstone.plans import queries_streams  # noqa: F401
    from gridstone.plans import queries_sources  # noqa: F401

    return REGISTRY
