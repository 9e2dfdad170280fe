"""Learned routers with Spark ML.

Training rows come from the label jobs (W1–W4); features are the surface
columns (F1), and for R5–R8 also the probe columns (F2) and the embedding
columns (F3) that the caller has joined.  Pipelines are ``StringIndexer → OneHotEncoder → VectorAssembler
→ StandardScaler → classifier`` and are saved with ``PipelineModel.write()``.
sklearn parity (C=1 → regParam=1/n, balanced weights n/(k·n_c)) is structural,
not bit-exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.functions.features import PROBE_COLUMNS, SURFACE_COLUMNS, feature_frame, surface_feature_columns
from gridstone.session import cut_lineage

NUMERIC = SURFACE_COLUMNS
SEMANTIC_COLUMNS = [f"semantic_embedding_{i:02d}" for i in range(16)]
#: The 27 numerics of R5–R8.
ROUTER_NUMERIC = [*SURFACE_COLUMNS, *PROBE_COLUMNS, *SEMANTIC_COLUMNS]


def with_features(df: DataFrame, query_col: str = "query", numeric: list[str] = NUMERIC) -> DataFrame:
    """``df`` with its ``numeric`` columns made from the query; embedding columns must be there (F3), and what is not a
    finite number in them counts as 0.  A frame without a query holds features that were made before."""
    made = query_col not in df.columns
    if not made and set(numeric) <= set(NUMERIC):
        return df.select(*[c for c in df.columns if c not in NUMERIC], *surface_feature_columns(query_col))
    missing = [c for c in numeric if (made or c in SEMANTIC_COLUMNS) and c not in df.columns]
    if missing:
        raise ValueError(f"join the embedding features first, missing: {missing}" if not made else f"neither a query nor its features: {missing}")
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")).otherwise(0.0)
    return (df if made else feature_frame(df, query_col)).withColumns({c: finite(c) for c in numeric if c in SEMANTIC_COLUMNS})


def balanced_weights(df: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """sklearn ``class_weight='balanced'``: n / (k · n_c); with the number of rows and of classes.

    The table of class sizes is broadcast (a model holds a row of coefficients for each class): a join on the label would
    send all rows of a class to one task.  Two numbers come to the driver."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.agg(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    n, k = totals["n"] or 0, totals["k"]
    return df.join(F.broadcast(counts), label).withColumn("_w", F.lit(float(n)) / (F.lit(float(max(k, 1))) * F.col("_nc"))), n, k


#: A training task has so many rows at least, if there are more cores than tasks, and some so many at most.
FEW_ROWS, MANY_ROWS = 1_000, 50_000


def training_tasks(n: int, cores: int) -> int:
    """Over how many tasks ``n`` rows to train on are dealt: each pass of a fit takes long by its work, not its bytes, so the
    count must not be left to a coalescing by bytes, which gives few tasks; and no task's share grows with the table."""
    return max(1, min(cores, n // FEW_ROWS), -(-n // MANY_ROWS))


def _feature_stages(label: str, cats: list[str], numeric: list[str]) -> list:
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in cats]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in cats], outputCols=[f"{c}_ohe" for c in cats], handleInvalid="keep")
    num = VectorAssembler(inputCols=numeric, outputCol="_num")
    scale = StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True)
    feats = VectorAssembler(inputCols=["_scaled", *[f"{c}_ohe" for c in cats]], outputCol="features")
    return [*idx, ohe, num, scale, feats, StringIndexer(inputCol=label, outputCol="label", handleInvalid="error")]


def train_classifier(df: DataFrame, label: str, cats: list[str], kind: str = "logreg", seed: int = 0,
                     numeric: list[str] = NUMERIC) -> PipelineModel:
    """R5 / R11 / R12 / R13 (logreg, balanced) and one head of R7 (MLP 16-8).

    The labelled rows are written once with their features and without texts (reliable checkpoint), then again in a fixed
    order, and read by every fit.  One class gives a constant model.
    """
    made = with_features(df, numeric=numeric)
    data, n, k = balanced_weights(cut_lineage(made.drop("query")), label)
    if not n:
        raise ValueError("no labelled rows to train on")
    # the same rows in the same partitions and order, so that a seed gives the same model
    place = [c for c in data.columns if c != "_nc"]
    tasks = training_tasks(n, df.sparkSession.sparkContext.defaultParallelism)
    data = cut_lineage(data.repartition(tasks, F.xxhash64(*place)).sortWithinPartitions(*place))
    prepared = Pipeline(stages=_feature_stages(label, cats, numeric)).fit(data)
    if k == 1:
        last = SQLTransformer(statement="SELECT *, CAST(0 AS DOUBLE) AS prediction FROM __THIS__")
    elif kind == "mlp":
        rows = prepared.transform(data)
        width = rows.schema["features"].metadata["ml_attr"]["num_attrs"]
        last = MultilayerPerceptronClassifier(layers=[width, 16, 8, k], seed=seed, maxIter=200).fit(rows)
    else:
        last = LogisticRegression(weightCol="_w", regParam=1.0 / n, elasticNetParam=0.0, maxIter=500, standardization=False).fit(
            prepared.transform(data))
    return PipelineModel(stages=[*prepared.stages, last])


def _numeric(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, VectorAssembler) and s.getOutputCol() == "_num").getInputCols()


def _predict(model: PipelineModel, featured: DataFrame, label_name: str) -> DataFrame:
    scored = featured
    label_stage = next(s for s in model.stages if s.hasParam("outputCol") and s.isDefined("outputCol") and s.getOutputCol() == "label")
    for stage in model.stages:
        if stage is not label_stage:  # rows to score carry no label
            scored = stage.transform(scored)
    scored = IndexToString(inputCol="prediction", outputCol=label_name, labels=label_stage.labels).transform(scored)
    sure = F.array_max(vector_to_array("probability")) if "probability" in scored.columns else F.lit(1.0)
    return scored.withColumn("route_confidence", sure)


def score(model: PipelineModel, df: DataFrame, label_name: str = "predicted_label") -> DataFrame:
    """Predicted label (original string) and max class probability as confidence (1 of a constant model)."""
    return _predict(model, with_features(df, numeric=_numeric(model)), label_name)


@dataclass(frozen=True)
class Factorized:
    """Two heads, and the first row's labels, which stand in for labels that cannot be read as a model or budget."""

    model_head: PipelineModel
    budget_head: PipelineModel
    fallback_model: str
    fallback_budget: int


def train_factorized(df: DataFrame, cats: list[str], seed: int = 0, order: str = "sample_id") -> Factorized:
    """An MLP for ``selected_model`` and one for ``selected_budget``; the first row is the one least in ``order``."""
    heads = df.withColumn("selected_model", F.col("selected_model").cast("string")).withColumn("selected_budget", F.col("selected_budget").cast("string"))
    first = heads.agg(F.min_by(F.struct("selected_model", "selected_budget"), order).alias("f")).first()["f"]
    if first is None:
        raise ValueError("no labelled rows to train on")
    fit = lambda label, other: train_classifier(heads.drop(other), label, cats, kind="mlp", seed=seed, numeric=ROUTER_NUMERIC)
    return Factorized(fit("selected_model", "selected_budget"), fit("selected_budget", "selected_model"), first[0], int(first[1]))


def save(model: PipelineModel | Factorized, path: str) -> None:
    """A trained router as a folder in the shared storage; of two heads, with their stand-in labels beside them."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
        return
    model.model_head.write().overwrite().save(f"{path}/model_head")
    model.budget_head.write().overwrite().save(f"{path}/budget_head")
    spark = SparkSession.active()
    labels = spark.range(1).select(F.lit(model.fallback_model).alias("model"), F.lit(model.fallback_budget).alias("budget"))
    labels.write.mode("overwrite").json(f"{path}/fallback")


def load(spark: SparkSession, path: str) -> PipelineModel | Factorized:
    """What ``save`` wrote; a model that is no longer readable raises, it is not replaced by another."""
    from gridstone.operators.routers import artifact_exists

    if not artifact_exists(spark, f"{path}/model_head"):
        return PipelineModel.load(path)
    first = spark.read.schema("model string, budget int").json(f"{path}/fallback").first()
    return Factorized(PipelineModel.load(f"{path}/model_head"), PipelineModel.load(f"{path}/budget_head"), first["model"], first["budget"])


def route_factorized(router: Factorized, df: DataFrame, pool: list[str] | None = None) -> DataFrame:
    """Each head's label; the confidence is the lesser one of both heads.  A model that is not in ``pool`` becomes the
    pool's first; the budget is clamped to a level (P5)."""
    from gridstone.functions.budgets import clamp_budget

    featured = with_features(df, numeric=_numeric(router.model_head))
    one = _predict(router.model_head, featured, "_model").select(*featured.columns, "_model", F.col("route_confidence").alias("_sure"))
    two = _predict(router.budget_head, one, "_budget")
    model = F.coalesce("_model", F.lit(router.fallback_model))
    if pool:
        model = F.when(model.isin(*pool), model).otherwise(F.lit(pool[0]))
    budget = F.coalesce(F.col("_budget").try_cast("int"), F.lit(router.fallback_budget))
    return two.select(*df.columns, model.alias("route_model"), clamp_budget(budget).alias("route_budget"),
                      F.least("_sure", "route_confidence").alias("route_confidence"))


def split_joint_label(df: DataFrame, col: str = "predicted_label", pool: list[str] | None = None) -> DataFrame:
    """``model::budget`` → route_model, route_budget (budget clamped to a level, P5); a model that is not in ``pool``
    becomes the pool's first."""
    from gridstone.functions.budgets import clamp_budget

    parts = F.split(F.col(col), "::")
    model = parts[0] if not pool else F.when(parts[0].isin(*pool), parts[0]).otherwise(F.lit(pool[0]))
    return df.withColumn("route_model", model).withColumn("route_budget", clamp_budget(parts[1].try_cast("int")))


# ---------------------------------------------------------------------------
# Difficulty, budgets and the per-(sample, model) budget policy
# ---------------------------------------------------------------------------

FOLDS = 3


def train_difficulty(labelled: DataFrame) -> PipelineModel:
    """Difficulty of (query, task_type) from 8 numerics and the task; ``labelled`` holds W4's labels."""
    return train_classifier(labelled, "difficulty", ["task_type"])


def predict_difficulty(model: PipelineModel, df: DataFrame, name: str = "difficulty") -> DataFrame:
    """``df`` with the predicted difficulty; a label that is none of the three counts as medium."""
    scored = score(model, df, "_label")
    label = F.col("_label")
    return scored.select(*df.columns, F.when(label.isin("easy", "medium", "hard"), label).otherwise("medium").alias(name))


def fold_of(query_col: str, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), query_col), F.lit(folds))


def difficulty_out_of_fold(labelled: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Rows of ``labelled`` (query, task_type, difficulty) with ``predicted_difficulty`` from a model that has not seen their
    query: folds are cut by a hash of the query (``_fold`` of rows without texts), one model for each."""
    fold = fold_of("query", folds) if "query" in labelled.columns else F.col("_fold")
    parts = []
    for i in range(folds):
        rest, own = labelled.where(fold != i), labelled.where(fold == i)
        parts.append(predict_difficulty(train_difficulty(rest if not rest.isEmpty() else labelled), own, "predicted_difficulty"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train_budget(labels: DataFrame, folds: int = FOLDS) -> tuple[PipelineModel, PipelineModel]:
    """R12, stacked on R11: (difficulty model, budget model).  ``labels``: W3 rows (query, task_type, selected_model,
    selected_budget, difficulty).  The budget model reads difficulties predicted out of fold, as it will meet predicted ones.
    Labels without texts hold their ``_key`` (``null``: no text), ``_fold`` and features."""
    own = ["query"] if "query" in labels.columns else ["_key", "_fold", *NUMERIC]
    key = F.md5("query") if "query" in labels.columns else F.nullif("_key", F.lit("null"))
    texts = labels.select(*own, "task_type", "difficulty").dropDuplicates([own[0], "task_type"])
    predicted = difficulty_out_of_fold(texts, folds).select(key.alias("_q"), F.col("task_type").alias("_t"), "predicted_difficulty")
    same = (key == F.col("_q")) & F.col("task_type").eqNullSafe(F.col("_t"))
    rows = labels.drop("difficulty").join(predicted, same).drop("_q", "_t").withColumnRenamed("predicted_difficulty", "difficulty")
    budget = rows.withColumn("selected_budget", F.col("selected_budget").cast("string"))
    return train_difficulty(texts), train_classifier(budget, "selected_budget", ["task_type", "selected_model", "difficulty"])


def budget_hints(difficulty: PipelineModel, budget: PipelineModel, samples: DataFrame, models: list[str]) -> DataFrame:
    """``sample_id, model_id, difficulty, budget_hint``: R4's hints for every sample and model of the pool."""
    known = predict_difficulty(difficulty, samples.select("sample_id", *(["query"] if "query" in samples.columns else NUMERIC), "task_type"))
    every = known.withColumn("selected_model", F.explode(F.array(*[F.lit(m) for m in models])))
    return score(budget, every, "_hint").select("sample_id", F.col("selected_model").alias("model_id"), "difficulty", F.col("_hint").try_cast("int").alias("budget_hint"))


def train_policy(labels: DataFrame) -> PipelineModel:
    """Budget per (sample, model) from 8 numerics, task and model; ``labels``: W2 rows."""
    return train_classifier(labels.withColumn("selected_budget", F.col("selected_budget").cast("string")), "selected_budget", ["task_type", "selected_model"])


def predict_policy(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """``sample_id, selected_model, predicted_budget`` of distinct (sample_id, selected_model, query, task_type)."""
    return score(model, pairs, "_budget").select("sample_id", "selected_model", F.col("_budget").try_cast("int").alias("predicted_budget"))
