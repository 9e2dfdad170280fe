"""Training labels: best row per group (W1–W3) and difficulty buckets.

"Best row per group" is an aggregate ``min_by(row, key)`` where the key is a
struct of the sort columns with descending ones negated (a sort-based aggregate
in Spark, as its buffer is a struct; rows are kept narrow).  It combines map-side, so a hot group (a third of all rows) is pre-reduced in every task
before the shuffle and never lands whole on one task.  Ties that the reference
resolves by input order are broken by ``(model, budget, id)`` (T10).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.config import DIFFICULTY_TASK_BONUS, DIFFICULTY_TASK_BONUS_DEFAULT, Weights
from gridstone.functions.budgets import repair_budget
from gridstone.functions.features import SURFACE_COLUMNS, surface_counts
from gridstone.functions.utility import row_utility, with_sample_id
from gridstone.session import cut_lineage

MODEL = "selected_model"
BUDGET = "selected_budget"


def top1(df: DataFrame, keys: list[str], order: list[Column], value_cols: list[str]) -> DataFrame:
    """One row per ``keys``: the row with the smallest ``order`` struct."""
    row = F.struct(*[F.col(c) for c in value_cols])
    k = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(row, k).alias("_best")).select(*keys, "_best.*")


def _tail(df: DataFrame, cols: tuple[str, ...]) -> list[Column]:
    return [F.col(c) for c in cols if c in df.columns]


def best_joint(df: DataFrame, w: Weights | None = None, queries: DataFrame | None = None, columns: Sequence[str] = ("query", "task_type")) -> DataFrame:
    """Best (model, budget) per sample by utility desc, correct desc, cost asc, latency asc.

    With ``queries`` (sample_id, query, task_type) the ranked rows hold no text; it is joined to the winners.  ``columns``
    names what of ``queries`` is joined, for instance features in place of the text."""
    df = with_sample_id(df).withColumn("utility", row_utility(w))
    order = [-F.col("utility"), ~F.col("is_correct").cast("boolean"), F.col("cost_usd"), F.col("latency_s"),
             *_tail(df, (MODEL, BUDGET, "id"))]
    if queries is None:
        return top1(df, ["sample_id"], order, ["query", "task_type", MODEL, BUDGET])
    best = top1(df, ["sample_id"], order, [MODEL, BUDGET])
    return best.join(queries.select("sample_id", *columns), "sample_id").select("sample_id", *columns, MODEL, BUDGET)


def best_per_model(df: DataFrame, w: Weights | None = None, queries: DataFrame | None = None, columns: Sequence[str] = ("query", "task_type")) -> DataFrame:
    """Best budget per (sample, model); keeps ``target_utility``.  ``queries`` and ``columns`` as in ``best_joint``."""
    df = with_sample_id(df).withColumn("target_utility", row_utility(w))
    order = [-F.col("target_utility"), ~F.col("is_correct").cast("boolean"), F.col("cost_usd"), F.col("latency_s"),
             F.col(BUDGET), *_tail(df, ("id",))]
    if queries is None:
        return top1(df, ["sample_id", MODEL], order, ["query", "task_type", BUDGET, "target_utility"])
    best = top1(df, ["sample_id", MODEL], order, [BUDGET, "target_utility"])
    return best.join(queries.select("sample_id", *columns), "sample_id").select("sample_id", MODEL, *columns, BUDGET, "target_utility")


def text_key(col: str | Column) -> Column:
    """128 bits that stand for a text in groups, joins and sorts; null has a key of its own."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.md5(c), F.lit("null"))


def _texts(df: DataFrame, columns: Sequence[str] = ("query",)) -> DataFrame:
    """One text per key and task: the text crosses one combining aggregate, no join or checkpoint key.  A frame
    without texts holds their ``_key`` and ``columns`` that were made from them.  Key and task are grouped as the one column
    that ``_with_text`` joins on, so a text stays where the aggregate has put it."""
    key = text_key("query") if "query" in df.columns else F.col("_key")
    made = df.select(key.alias("_key"), "task_type", *columns)
    return made.groupBy(_group().alias("_group")).agg(*[F.any_value(c).alias(c) for c in ("_key", "task_type", *columns)])


def _group() -> Column:
    """Key and task in one column: keys hold no colon, and a task that is null adds nothing."""
    return F.concat("_key", F.coalesce(F.concat(F.lit(":"), F.col("task_type").cast("string")), F.lit("")))


def _with_text(narrow: DataFrame, texts: DataFrame) -> DataFrame:
    renamed = texts.drop("_key", "task_type").withColumnRenamed("_group", "_g")
    return narrow.withColumn("_group", _group()).join(renamed, F.col("_group") == F.col("_g"), "left").drop("_group", "_g")


def _scored(queries: DataFrame) -> DataFrame:
    """``_key, task_type, difficulty_score`` once per key and task, scored in every row: no text is shuffled."""
    key = text_key("query") if "query" in queries.columns else F.col("_key")
    rows = queries.select(key.alias("_key"), "task_type", difficulty_score(queries).alias("difficulty_score"))
    return _texts(rows, ("difficulty_score",)).select("_key", "task_type", "difficulty_score")


def best_budget(df: DataFrame, with_difficulty: bool = True, queries: DataFrame | None = None, columns: Sequence[str] = ("query",)) -> DataFrame:
    """Best budget per (query, task, model): correct desc, score desc, cost, latency, budget asc;
    repaired to a level (P6) and labelled with difficulty (W4).  Grouped, joined and ranked by text keys; the texts are
    joined to the narrow result once.

    A grid repeats each text in all its traces.  With ``queries`` (query, task_type) of the samples the grid's ``query``
    holds text keys only, and a text is met once a sample.  ``queries`` may also hold ``_key``, task_type and ``columns`` made
    from the texts, which then stand in the result, with ``_key``, in place of the text."""
    score = F.col("score").cast("double") if "score" in df.columns else F.col("is_correct").cast("double")
    key = text_key("query") if queries is None else F.col("query")
    rows = df.select(key.alias("_key"), "task_type", MODEL, BUDGET, F.col("is_correct").cast("boolean").alias("_ok"), score.alias("_score"), "cost_usd", "latency_s",
                     *[c for c in ("id",) if c in df.columns])
    order = [~F.col("_ok"), -F.col("_score"), F.col("cost_usd"), F.col("latency_s"), F.col(BUDGET), *_tail(rows, ("id",))]
    out = top1(rows, ["_key", "task_type", MODEL], order, [BUDGET]).withColumn(BUDGET, repair_budget(F.col(BUDGET)))
    texts = _texts(df if queries is None else queries, columns)
    if with_difficulty:
        # a grid repeats its texts, so they are scored once they are grouped; samples are scored row by row
        scored = _scored(queries) if queries is not None else texts.select("_key", "task_type", difficulty_score(texts).alias("difficulty_score"))
        labels = _difficulty(scored).withColumnsRenamed({"_key": "_dk", "task_type": "_dt"})
        same = (F.col("_key") == F.col("_dk")) & F.col("task_type").eqNullSafe(F.col("_dt"))
        out = out.join(labels, same, "left").drop("_dk", "_dt")
    named = _with_text(out, texts)
    return named.select(*([] if "query" in columns else ["_key"]), *columns, "task_type", MODEL, BUDGET, *(["difficulty_score", "difficulty"] if with_difficulty else []))


# ---------------------------------------------------------------------------
# W4 difficulty labels with a distributed global rank
# ---------------------------------------------------------------------------

def difficulty_score(df: DataFrame) -> Column:
    c = surface_counts("query") if "query" in df.columns else {k: F.col(k) for k in SURFACE_COLUMNS}
    bonus = F.coalesce(
        F.create_map(*[x for k, v in DIFFICULTY_TASK_BONUS.items() for x in (F.lit(k), F.lit(v))])[F.col("task_type")],
        F.lit(DIFFICULTY_TASK_BONUS_DEFAULT),
    )
    raw = (c["word_count"] * 1.0 + c["digit_count"] * 2.0 + c["math_symbol_count"] * 3.0 + c["code_marker_count"] * 30.0)
    return raw + bonus


def global_row_number(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number over a total order, without a single-partition window.

    Range-partition by the order, sort inside partitions, number rows locally
    (``monotonically_increasing_id`` keeps the in-partition position in its low
    33 bits), then add per-partition offsets from a tiny count table (one row
    per partition, broadcast).  The numbered frame is checkpointed (reliable,
    shared folder) so both passes see the same partitioning.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    local = cut_lineage(local)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_pid", "_off")
    return local.join(F.broadcast(offsets), "_pid").withColumn("rn", F.col("_off") + F.col("_pos") + 1).drop("_pid", "_pos", "_off")


def difficulty_labels(queries: DataFrame) -> DataFrame:
    """easy/medium/hard per distinct (query, task_type).

    Score = words + 2·digits + 3·math symbols + 30·code markers + task bonus.
    Fewer than 3 distinct scores: min → easy, max → hard (hard wins), else
    medium.  Otherwise three rank buckets of ``qcut(rank(first), 3)``:
    easy if 3(rn−1) < n−1, medium if 3(rn−1) < 2(n−1), else hard.  Equal scores
    are ranked by the text's key, then the task.
    """
    return _with_text(_difficulty(_scored(queries)), _texts(queries)).select("query", "task_type", "difficulty_score", "difficulty")


def _difficulty(scored: DataFrame) -> DataFrame:
    """``_key, task_type, difficulty_score, difficulty`` of narrow rows (_key, task_type, difficulty_score)."""
    ranked = global_row_number(scored, ["difficulty_score", "_key", "task_type"])
    s = F.col("difficulty_score")
    stats = ranked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("difficulty_score").alias("k"), F.min("difficulty_score").alias("lo"), F.max("difficulty_score").alias("hi"))
    n, k, lo, hi = (stats.select(c).scalar() for c in ("n", "k", "lo", "hi"))
    rn = F.col("rn")
    by_rank = F.when(3 * (rn - 1) < n - 1, "easy").when(3 * (rn - 1) < 2 * (n - 1), "medium").otherwise("hard")
    few = F.when(s == hi, "hard").when(s == lo, "easy").otherwise("medium")
    return ranked.select("_key", "task_type", "difficulty_score", F.when(k < 3, few).otherwise(by_rank).alias("difficulty"))
