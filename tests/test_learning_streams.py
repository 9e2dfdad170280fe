"""Learned routers, artifacts and streams on small frames."""

import pytest

from gridstone.operators import learn
from gridstone.operators import routers as R

POOL = [R.PoolModel("a", "cheap"), R.PoolModel("b", "strong")]


def _labelled(spark, labels):
    rows = [(f"s{i}", ("short " * (1 + i % 4)) + str(i), "math" if i % 2 else "custom", labels[i % len(labels)]) for i in range(40)]
    return spark.createDataFrame(rows, "sample_id string, query string, task_type string, joint_label string")


@pytest.mark.parametrize("kind", ["logreg", "mlp"])
def test_training_scores_every_row(spark, kind):
    df = _labelled(spark, ["a::0", "b::1024", "a::256"])
    model = learn.train_classifier(df, "joint_label", ["task_type"], kind=kind)
    new = df.drop("joint_label").union(spark.createDataFrame([("x", "text", "never seen")], "sample_id string, query string, task_type string"))
    out = learn.split_joint_label(learn.score(model, new), pool=["a", "b"]).collect()
    assert len(out) == 41 and all(0 <= r.route_confidence <= 1 and r.route_model in "ab" for r in out)
    again = learn.score(learn.train_classifier(df, "joint_label", ["task_type"], kind=kind), new)
    assert {r.sample_id: r.predicted_label for r in out} == {r.sample_id: r.predicted_label for r in again.collect()}


def test_one_class_gives_a_constant_model(spark):
    model = learn.train_classifier(_labelled(spark, ["gone::7"]), "joint_label", ["task_type"])
    out = learn.split_joint_label(learn.score(model, _labelled(spark, ["z"]).drop("joint_label")), pool=["a", "b"]).collect()
    assert {(r.route_model, r.route_budget, r.route_confidence) for r in out} == {("a", 0, 1.0)}
    with pytest.raises(ValueError):
        learn.train_classifier(_labelled(spark, ["z"]).limit(0), "joint_label", ["task_type"])


def test_missing_artifact_keeps_the_threshold_decision(spark, tmp_path):
    samples = spark.createDataFrame([("s1", "one two 3", "custom")], "sample_id string, query string, task_type string")
    out = R.route_or_threshold(spark, samples, POOL, f"file://{tmp_path}/none", "learned", None).first()
    assert (out.router_name, out.fallback_triggered, out.fallback_reason) == ("learned", False, None)
    (tmp_path / "model").mkdir()
    assert R.route_or_threshold(spark, samples, POOL, f"file://{tmp_path}/model", "learned", lambda s, p: p) == f"file://{tmp_path}/model"
