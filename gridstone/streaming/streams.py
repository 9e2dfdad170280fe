"""Structured Streaming jobs of the request path: routing (X1), grading and appending (X2), answering repeats once.

File-source streams with ``availableNow`` triggers; sinks, landing folders and checkpoints lie under the shared
``spark.checkpoint.dir`` (never a machine-local folder on a cluster).  ``replay`` feeds a table to a stream in slices of
rising time or key: each slice is one run of the query from the same checkpoint, so every run after the first also
recovers the state of the one before, and the result does not depend on the files that the table lies in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.config import BUDGET_LEVELS, DEFAULT_CONFIDENCE_THRESHOLD
from gridstone.functions import features as FT
from gridstone.operators import grading as G
from gridstone.operators import learn
from gridstone.operators import routers as R
from gridstone.session import shared_path

REQUEST_FIELDS = ["sample_id", "selected_model", "selected_budget", "task_type"]
SLICES = 4
#: Bytes of a row group in the landing folder: a reader deals out whole row groups, and one of the usual 128 MB would hold a slice's
#: file, so that a few tasks did all the work on its texts.
LANDING_GROUP = 4 * 1024 * 1024


def with_request_key(df: DataFrame, cols: list[str]) -> DataFrame:
    """SHA-256 of the canonical JSON of the request fields (sorted keys)."""
    return df.withColumn("request_key", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256))


# ---------------------------------------------------------------------------
# a table as a stream
# ---------------------------------------------------------------------------

def run_available_now(sdf: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream to completion into a parquet sink under the shared checkpoint folder; the sink as a batch DataFrame."""
    spark = sdf.sparkSession
    out, checkpoint = out or shared_path(spark, f"{name}-out"), checkpoint or shared_path(spark, f"{name}-ckpt")
    query = (sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


def _cuts(table: DataFrame, by: str, slices: int) -> list:
    """``slices - 1`` or fewer rising values of ``by`` that part the table about evenly."""
    got = table.agg(F.percentile_approx(by, [i / slices for i in range(1, slices)], 1000).alias("c")).first()["c"]
    return sorted(set(got or []))


def replay(table: DataFrame, by: str, name: str, run: Callable[[DataFrame], None], slices: int = SLICES, last: DataFrame | None = None) -> None:
    """Append ``table`` to a landing folder slice by slice, rising in ``by``, and call ``run`` on the folder's stream after
    each.  ``last``: rows appended in a run of their own at the end.  Rows whose ``by`` is null come with the first slice."""
    spark, landing = table.sparkSession, shared_path(table.sparkSession, f"{name}-landing")
    cuts = _cuts(table, by, slices)
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        fits = F.lit(True) if low is None else F.col(by) >= F.lit(low)
        fits = fits if high is None else fits & (F.col(by) < F.lit(high))
        parts.append(table.where(fits if low is not None else fits | F.col(by).isNull()))
    for part in [*parts, *([last] if last is not None else [])]:
        part.write.mode("append").option("parquet.block.size", LANDING_GROUP).parquet(landing)
        run(spark.readStream.schema(table.schema).parquet(landing))


# ---------------------------------------------------------------------------
# X3 repeats inside a time bound
# ---------------------------------------------------------------------------

def dedup_requests(sdf: DataFrame, bound: str = "1 hour", lateness: str = "10 minutes", key: str = "request_key",
                   time_col: str = "created_at", order: str = "id") -> DataFrame:
    """A request is answered unless the same request came at most ``bound`` before it.

    Requests of one key that follow each other within the bound are a session; its first row (by time, then ``order``) is
    answered, with ``n_requests``.  A session's row is given out, and its state dropped, when the watermark passes its end, so
    state holds the sessions of the last ``bound + lateness`` only.  Sessions are merged in every task before the shuffle,
    so a request that fills a third of the stream sends one row a task."""
    sdf.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    row = F.struct(*[c for c in sdf.columns if c != key])
    sessions = sdf.withWatermark(time_col, lateness).groupBy(key, F.session_window(time_col, bound))
    first = sessions.agg(F.min_by(row, F.struct(time_col, order)).alias("_first"), F.count(F.lit(1)).alias("n_requests"))
    return first.select(key, "_first.*", "n_requests")


def answered_requests(traces: DataFrame, name: str = "answered", bound: str = "1 hour", lateness: str = "10 minutes", slices: int = SLICES) -> DataFrame:
    """X3 over a whole trace table (id, request fields, created_at), fed in slices of rising time.  A row without a
    request, far ahead of all others, is the clock that closes the last sessions; its own stays open."""
    spark = traces.sparkSession
    traces = with_request_key(traces, REQUEST_FIELDS).withColumn("created_at", F.col("created_at").cast("timestamp"))
    out, checkpoint = shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-ckpt")
    clock = traces.agg(F.max("created_at").alias("t")).where("t is not null").select(
        *[(F.col("t") + F.expr(f"interval {bound}") * 3 + F.expr(f"interval {lateness}") if c == "created_at" else F.lit(None)).cast(traces.schema[c].dataType).alias(c)
          for c in traces.columns])
    replay(traces, "created_at", name, lambda stream: run_available_now(dedup_requests(stream, bound, lateness), name, out, checkpoint), slices, clock)
    schema = f"request_key string, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in traces.schema.fields if f.name != 'request_key')}, n_requests long"
    return spark.read.schema(schema).parquet(out)


# ---------------------------------------------------------------------------
# X1 routing
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Artifacts:
    """Trained routers that were loaded; a missing one gives the threshold rule's decisions."""

    logreg_joint: PipelineModel | None = None
    mlp_factorized: learn.Factorized | None = None
    threshold: float = DEFAULT_CONFIDENCE_THRESHOLD


@dataclass(frozen=True)
class Runtime:
    pool: list[R.PoolModel]
    artifacts: Artifacts = field(default_factory=Artifacts)
    default_router: str = "uncertainty_aware"


def load_artifacts(spark: SparkSession, folder: str | None) -> Artifacts:
    """The saved routers of a folder; those that are not there stay None."""
    there = lambda name: learn.load(spark, f"{folder}/{name}") if folder and R.artifact_exists(spark, f"{folder}/{name}") else None
    return Artifacts(there("logreg_joint"), there("mlp_factorized"))


def _decided(df: DataFrame, routed: DataFrame, name: str, confidence: Column | None = None) -> DataFrame:
    decision = F.struct(F.col("route_model").alias("model"), F.col("route_budget").cast("int").alias("budget"),
                        (F.col("route_confidence") if confidence is None else confidence).cast("double").alias("confidence"))
    return routed.select(*df.columns, decision.alias(name))


def route_requests(requests: DataFrame, runtime: Runtime) -> DataFrame:
    """``requests`` (a table or a stream) with the decision of each row's router.

    ``use_router``, ``router_name`` (null: the default), ``model_id`` and ``budget`` (the caller's own choice, if
    ``use_router`` is false) say how a row wants to be routed.  Every router is a per-row expression or a loaded model, so
    no row waits for another and nothing is kept between batches.  Unknown routers and budgets give ``reject_reason``.
    Requests without a query hold its features (F5, and F3 for loaded models), made before they were repeated or joined."""
    pool, art = runtime.pool, runtime.artifacts
    ids = [m.model_id for m in pool]
    base = requests.columns
    asked = requests.withColumnRenamed("router_name", "_asked")  # routers name themselves
    if "query" in base:  # the counts of a text are made in one pass and serve both rules
        counted = FT.with_counts(asked, asked.columns)
        counts = {k: F.col("_n_" + k) for k in FT.COUNT_COLUMNS}
        probe = dict(zip([*FT.SURFACE_COLUMNS, *FT.PROBE_COLUMNS], FT.features_from_counts()))["cheap_probe_difficulty"]
    else:
        counted, counts, probe = asked, {k: F.col(k) for k in FT.SURFACE_COLUMNS}, F.col("cheap_probe_difficulty")
    df = _decided(counted, R.route_threshold(counted, pool, difficulty=probe), "_threshold")
    df = _decided(df, R.route_joint(df, ids, difficulty=FT.heuristic_difficulty(counts=counts)), "_joint", F.lit(None))
    if art.logreg_joint is not None:
        df = _decided(df, learn.split_joint_label(learn.score(art.logreg_joint, df), pool=ids), "_logreg")
    if art.mlp_factorized is not None:
        df = _decided(df, learn.route_factorized(art.mlp_factorized, df, pool=ids), "_heads")
    c = F.col
    heads = c("_heads") if art.mlp_factorized is not None else c("_threshold")
    sure = c("_heads.confidence") >= art.threshold if art.mlp_factorized is not None else F.lit(False)
    unsure = F.struct(F.when(sure, heads["model"]).otherwise(c("_threshold.model")).alias("model"), F.when(sure, heads["budget"]).otherwise(c("_threshold.budget")).alias("budget"),
                      heads["confidence"].alias("confidence"))
    own = F.struct(c("model_id").alias("model"), c("budget").cast("int").alias("budget"), F.lit(None).cast("double").alias("confidence"))
    by_name = {"threshold": c("_threshold"), "legacy_joint_policy": c("_joint"), "logreg_joint": c("_logreg") if art.logreg_joint is not None else c("_threshold"),
               "mlp_factorized": heads, "uncertainty_aware": unsure}
    use, router = F.coalesce(c("use_router"), F.lit(True)), F.coalesce(c("_asked"), F.lit(runtime.default_router))
    chosen = F.when(~use, own)
    for name, decision in by_name.items():
        chosen = chosen.when(router == name, decision)
    fallback = use & (router == "uncertainty_aware") & ~F.coalesce(sure, F.lit(False))
    reason = F.lit("missing_artifact") if art.mlp_factorized is None else F.lit("low_confidence")
    df = df.withColumn("_chosen", chosen)
    bad = F.when(use & ~router.isin(*by_name), "unknown_router").when(~use & ~F.coalesce(c("budget").isin(*BUDGET_LEVELS), F.lit(False)), "unsupported_budget")
    return df.select(
        *[c("_asked").alias(x) if x == "router_name" else x for x in base], c("_chosen.model").alias("route_model"), c("_chosen.budget").alias("route_budget"), c("_chosen.confidence").alias("route_confidence"),
        F.when(use, router).alias("routed_by"), fallback.alias("fallback_triggered"), F.when(fallback, reason).alias("fallback_reason"), bad.alias("reject_reason"))


def routed_stream(requests: DataFrame, by: str, features: Callable[[DataFrame], DataFrame], runtime: Runtime, name: str = "routed", slices: int = SLICES,
                  keep: list[str] | None = None) -> DataFrame:
    """X1 over a whole table as a stream; ``features`` adds what the routers read (stream-static joins included).  ``keep``:
    the columns that are written (all, unless given)."""
    spark = requests.sparkSession
    out, checkpoint = shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-ckpt")
    schemas = []

    def run(stream: DataFrame) -> None:
        routed = route_requests(features(stream), runtime)
        routed = routed.select(*keep) if keep else routed
        schemas.append(routed.schema)
        run_available_now(routed, name, out, checkpoint)

    replay(requests, by, name, run, slices)
    return spark.read.schema(schemas[-1]).parquet(out)


# ---------------------------------------------------------------------------
# X2 grading and appending
# ---------------------------------------------------------------------------

def append_graded(responses: DataFrame, samples: DataFrame, out: str, checkpoint: str, outcomes: DataFrame | None = None,
                  after_batch: Callable[[int], None] | None = None) -> None:
    """A stream of responses (id, sample_id, ..., output_text) joined with the static ``samples`` (sample_id,
    task_type, expected_answer), graded (G6) and appended as traces to ``out``.

    Each micro-batch replaces its own folder ``batch_id=N``: a batch that is run again after a failure, whether it was
    written or not, leaves its traces there once.  Responses without a sample are kept, ungraded, with the error
    ``unknown_sample``.  ``after_batch`` is called when a batch is written (tests stop the query there)."""
    known = samples.select("sample_id", "task_type", "expected_answer", F.lit(True).alias("_known"))

    def write(batch: DataFrame, batch_id: int) -> None:
        joined = batch.drop("task_type", "expected_answer").join(known, "sample_id", "left").withColumn("sample_known", F.coalesce("_known", F.lit(False))).drop("_known")
        graded = G.regrade_traces(joined, outcomes)
        unknown = ~F.col("sample_known")
        traces = graded.withColumns({"error_type": F.when(unknown, "unknown_sample").otherwise(F.col("error_type")), "score": F.when(unknown, 0.0).otherwise(F.col("score")),
                                     "is_correct": F.col("is_correct") & F.col("sample_known")}).drop("sample_known")
        traces.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if after_batch:
            after_batch(batch_id)

    query = responses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def graded_stream(responses: DataFrame, by: str, samples: DataFrame, outcomes: DataFrame | None = None, name: str = "graded", slices: int = SLICES) -> DataFrame:
    """X2 over a whole table of responses as a stream; the traces with their ``batch_id``."""
    spark = responses.sparkSession
    out, checkpoint = shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-ckpt")
    replay(responses, by, name, lambda stream: append_graded(stream, samples, out, checkpoint, outcomes), slices)
    return spark.read.parquet(out)
