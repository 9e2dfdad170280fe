"""Rows to train on are dealt over tasks by their number, not coalesced by their bytes."""

from pyspark.ml import Pipeline

from gridstone.operators import learn


def test_no_task_grows_with_the_table_and_all_cores_work():
    assert [learn.training_tasks(n, 12) for n in (0, 1, 999, 5_000, 30_000, 600_000, 600_001, 6_000_000)] == [1, 1, 1, 5, 12, 12, 13, 120]
    assert all(-(-n // learn.training_tasks(n, c)) <= learn.MANY_ROWS for n in (1, 49_999, 50_001, 10**7) for c in (1, 8, 500))


def test_rows_of_few_bytes_are_trained_on_by_all_cores(spark, monkeypatch):
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    rows = spark.range(4_000).selectExpr("concat('s', id) AS sample_id", "'math' AS task_type", "concat('q ', id) AS query", "IF(id % 3 = 0, 'a', 'b') AS wanted")
    model = learn.train_classifier(rows, "wanted", ["task_type"])
    assert seen == [4] and learn.score(model, rows).where("predicted_label IN ('a', 'b')").count() == 4_000
