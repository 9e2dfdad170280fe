"""Rows to train the budget policy on hold no texts, and no class of labels is sent to one task."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gridstone.operators import learn
from gridstone.plans import queries_learned as QL


def test_rows_of_a_class_stay_where_they_are(spark):
    """Two classes, neither sizes nor rows small enough for Spark to broadcast by itself: a shuffle by label leaves two tasks with rows."""
    rows = spark.range(4_000).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("wanted")).repartition(6, "id")
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in saved:
            spark.conf.set(k, "-1")
        weighed, n, k = learn.balanced_weights(rows, "wanted")
        held = {r["p"]: r["n"] for r in weighed.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    finally:
        for key, value in saved.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert (n, k, sum(held.values())) == (4_000, 2, 4_000) and len(held) == 6 and max(held.values()) < 1_000
    assert {(r["wanted"], r["_w"]) for r in weighed.select("wanted", "_w").distinct().collect()} == {("a", 2.0), ("b", 4_000 / 6_000)}


def test_policy_is_trained_and_applied_without_texts(spark, monkeypatch, tmp_path):
    texts = [None, "", *("word 12 + x def " * (10 + i % 9) for i in range(58))]
    docs = pa.table({"doc_id": pa.array(range(60), pa.int64()), "text": texts, "n_chars": pa.array([len(t or "") for t in texts], pa.int32())})
    pq.write_table(docs, f"{tmp_path}/documents.parquet")
    met = {}
    monkeypatch.setattr(learn, "train_policy", lambda labels, f=learn.train_policy: (met.update(train=labels), f(labels))[1])
    monkeypatch.setattr(learn, "predict_policy", lambda model, pairs, f=learn.predict_policy: (met.update(pairs=pairs), f(model, pairs))[1])
    monkeypatch.setattr(QL, "_tables", {})
    made = QL.learned_policy_predictions(spark, str(tmp_path))
    assert made.count() == met["pairs"].count() == 180
    for rows in met.values():
        assert "query" not in rows.columns and max(len(str(v)) for r in rows.limit(50).collect() for v in r) < 40
