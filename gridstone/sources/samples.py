"""Benchmark samples as JSON lines: scan, validation, sink, counts, filters and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstone.functions.text import NUMBER, add_last_boxed, blank_to_null, last_match, normalize_number, pystrip

# FIXED VALUES: tasks and splits that a sample may name.
TASKS = ("gsm8k", "math", "humaneval")
SPLITS = ("train", "dev", "test")
FIELDS = ("sample_id", "task_type", "query", "expected_answer", "split")
BAD_LINE = "_corrupt_record"


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per line; null fields and empty metadata are left out."""
    if "metadata" in rows.columns:
        rows = rows.withColumn("metadata", F.when(F.size("metadata") > 0, F.col("metadata")))
    rows.write.json(path)


def write_samples(samples: DataFrame, path: str, rejects_path: str | None = None) -> None:
    """S3: the valid samples as JSON lines.  Samples that break a rule go to ``rejects_path`` with the rule; without it
    they are an error, and nothing is written."""
    good, bad = validate_samples(samples)
    if rejects_path:
        write_json_lines(bad, rejects_path)
    elif broken := bad.groupBy("reject_reason").count().orderBy("reject_reason").collect():
        raise ValueError("samples break rules: " + ", ".join(f"{r.reject_reason} ({r['count']})" for r in broken))
    write_json_lines(good, path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a JSON-lines folder; blank lines are skipped, lines that are not JSON keep their text in
    ``_corrupt_record`` for ``validate_samples``."""
    schema = ", ".join(f"{f} string" for f in FIELDS) + f", metadata map<string,string>, {BAD_LINE} string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE).json(path)


def reject_reason(df: DataFrame) -> Column:
    """Null for a valid sample, else the first rule that it breaks."""
    blank = lambda c: F.length(pystrip(F.col(c))) == 0
    reason = F.when(F.col(BAD_LINE).isNotNull(), "invalid_json") if BAD_LINE in df.columns else F.when(F.lit(False), "")
    for f in sorted(FIELDS):
        reason = reason.when(F.col(f).isNull(), f"missing:{f}")
    return (reason.when(blank("sample_id"), "empty_sample_id").when(~F.col("task_type").isin(*TASKS), "unsupported_task_type")
            .when(~F.col("split").isin(*SPLITS), "unsupported_split").when(blank("query"), "empty_query")
            .when(blank("expected_answer"), "empty_expected_answer"))


def validate_samples(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reject_reason``)."""
    judged = df.withColumn("reject_reason", reject_reason(df))
    good = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason", BAD_LINE)
    return good, judged.filter(F.col("reject_reason").isNotNull())


def filter_samples(df: DataFrame, task: str = "all", split: str = "all", limit: int | None = None) -> DataFrame:
    """Task and split filter, then the first ``limit`` samples by id."""
    for value, known in ((task, TASKS), (split, SPLITS)):
        if value != "all" and value not in known:
            raise ValueError(f"{value!r} is none of {('all', *known)}")
    if task != "all":
        df = df.filter(F.col("task_type") == task)
    if split != "all":
        df = df.filter(F.col("split") == split)
    return df if limit is None else df.orderBy("sample_id").limit(limit)


def summarize_samples(df: DataFrame) -> DataFrame:
    """Samples per task and split."""
    return df.groupBy("task_type", "split").agg(F.count(F.lit(1)).alias("n"))


def assign_splits(df: DataFrame, order_col: str, train: int, dev: int, test: int, bench: str) -> DataFrame:
    """One pool by offset: the first ``train`` rows, the next ``dev``, the next ``test``; ids restart in each split.

    The pool is cut to train + dev + test rows by a distributed top-k first, so the numbering window sees no more."""
    top = df.orderBy(order_col).limit(train + dev + test)
    rn = F.row_number().over(Window.orderBy(order_col))
    split = F.when(F.col("_rn") <= train, "train").when(F.col("_rn") <= train + dev, "dev").otherwise("test")
    within = F.col("_rn") - F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", train).otherwise(train + dev)
    return (top.withColumn("_rn", rn).withColumn("split", split)
            .withColumn("sample_id", F.format_string(f"{bench}_%s_%03d", F.col("split"), within)).drop("_rn"))


def assign_splits_of_pools(train_pool: DataFrame, test_pool: DataFrame, order_col: str, train: int, dev: int, test: int, bench: str) -> DataFrame:
    """S5, two pools: the first ``train`` rows of one, then ``dev`` and ``test`` rows of the other by offset."""
    return assign_splits(train_pool, order_col, train, 0, 0, bench).unionByName(assign_splits(test_pool, order_col, 0, dev, test, bench))


#: FIXED VALUES: the marker of a final number, and that of a worded answer.
HASH_MARK, WORDED = "####", "(?i)(?:final\\s+answer|answer)\\s*[:：]\\s*([^\n]+)"


def build_expected(questions: DataFrame, solution: str = "solution") -> tuple[DataFrame, DataFrame]:
    """(questions with ``expected_answer``, rejects with ``reject_reason``).

    Number tasks: the last number behind the last ``####`` (or of the whole solution).  Mathematical tasks: the last box
    that closes, else what follows ``answer:``.  Other tasks: the solution itself."""
    c, task = F.col, F.col("task_type")
    df = questions.withColumn("_s", F.coalesce(c(solution).cast("string"), F.lit("")))
    df = df.withColumn("_m", F.when(task == "math", c("_s")))
    df = add_last_boxed(df, "_m", "_box")
    number = normalize_number(last_match(F.substring_index(c("_s"), HASH_MARK, -1), "(" + NUMBER + ")"))
    worded = pystrip(F.regexp_extract(c("_m"), WORDED, 1))
    answer = F.when(task == "gsm8k", number).when(task == "math", F.coalesce("_box", blank_to_null(worded))).otherwise(blank_to_null(pystrip(c("_s"))))
    df = df.withColumn("expected_answer", answer)
    blank = F.length(pystrip(c("_s"))) == 0
    reason = F.when(c("expected_answer").isNotNull(), None).when(blank, "empty_solution").when(task == "gsm8k", "no_number").when(task == "math", "no_box_or_answer").otherwise("empty_solution")
    judged = df.withColumn("reject_reason", reason)
    return (judged.where("reject_reason is null").select(*questions.columns, "expected_answer"),
            judged.where("reject_reason is not null").select(*questions.columns, "reject_reason"))
