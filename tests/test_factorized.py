"""R5-R8 over all 27 numerics: only the embedding tells these rows apart."""

import pytest
from pyspark.ml.feature import VectorAssembler

from gridstone.operators import learn

MODELS, BUDGETS = ["a", "b"], [0, 1024]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(80):
        m, b = i % 2, (i // 2) % 2
        rows.append((f"s{i:02d}", "the same text", "math", MODELS[m], BUDGETS[b], [float(m), float(b), i / 80.0, *[0.0] * 13]))
    df = spark.createDataFrame(rows, "sample_id string, query string, task_type string, selected_model string, selected_budget int, v array<double>")
    return df.select("*", *[df.v[i].alias(c) for i, c in enumerate(learn.SEMANTIC_COLUMNS)]).drop("v")


def test_two_heads_and_the_lesser_confidence(labelled):
    router = learn.train_factorized(labelled, ["task_type"])
    assert (router.fallback_model, router.fallback_budget) == ("a", 0)
    for head in (router.model_head, router.budget_head):
        num = next(s for s in head.stages if isinstance(s, VectorAssembler))
        assert len(num.getInputCols()) == 27 and head.stages[-1].getLayers()[1:] == [16, 8, 2]
    new = labelled.drop("selected_model", "selected_budget")
    got = {r.sample_id: r for r in learn.route_factorized(router, new, pool=MODELS).collect()}
    want = {r.sample_id: (r.selected_model, r.selected_budget) for r in labelled.collect()}
    assert {k: (r.route_model, r.route_budget) for k, r in got.items()} == want
    m, b = ({r.sample_id: r.route_confidence for r in learn.score(h, new).collect()} for h in (router.model_head, router.budget_head))
    assert {k: r.route_confidence for k, r in got.items()} == {k: min(m[k], b[k]) for k in m}
    assert {r.route_model for r in learn.route_factorized(router, new, pool=["z"]).collect()} == {"z"}


def test_joint_router_sees_the_embedding(labelled):
    df = labelled.selectExpr("*", "concat_ws('::', selected_model, selected_budget) AS joint_label")
    model = learn.train_classifier(df, "joint_label", ["task_type"], numeric=learn.ROUTER_NUMERIC)
    out = learn.score(model, df).where("predicted_label <> joint_label")
    assert out.count() == 0
    with pytest.raises(ValueError):
        learn.train_classifier(df.drop("semantic_embedding_03"), "joint_label", ["task_type"], numeric=learn.ROUTER_NUMERIC)
