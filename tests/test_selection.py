"""A hand-made dev and test grid with literal picks, and the learned chain against DuckDB over the written scores."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridstone.operators import learn
from gridstone.operators import routers as R
from gridstone.operators import selection as SE
from gridstone.plans import queries_learned as QL
from gridstone.plans.catalog import expand_sums, rounded, with_views
from gridstone.plans.queries_reports import FAIL_CTES, FINAL_SQL, selection_ctes
from gridstone.plans.sqlfrag import round_doubles
from tools.oracle_check import key, norm

SF = "/root/testdata/sf0.001"
GRID = "id long, sample_id string, task_type string, split string, selected_model string, selected_budget int, is_correct boolean, error_type string, cost_usd double, latency_s double"
DECISIONS = "router_name string, sample_id string, route_model string, route_budget int, route_confidence double, fallback_triggered boolean"


def grid(spark):
    """Samples d1, d2 (dev) and t1, t2 (test) of one benchmark: model m0 is wrong and cheap, m1 right and dear on one of two."""
    rows, i = [], 0
    for sample, split in (("d1", "dev"), ("d2", "dev"), ("t1", "test"), ("t2", "test")):
        for model, right, cost in (("m0", sample[1] == "2", 0.001), ("m1", True, 0.01)):
            rows.append((i := i + 1, sample, "gsm8k", split, model, 0, right, None, cost, 1.0))
    return spark.createDataFrame(rows, GRID)


def decisions(spark, sure):
    rows = []
    for s in ("d1", "d2", "t1", "t2"):
        rows += [("threshold", s, "m0", 0, 0.5, False), ("joint", s, "m0", 0, 0.9, False), ("heads", s, "m1", 0, sure if s.endswith("1") else 0.6, False)]
    return spark.createDataFrame(rows, DECISIONS)


def test_dev_picks_the_router_and_threshold(spark):
    dev = grid(spark).where("split = 'dev'")
    # sure decisions are kept on d1 at .75, the cheap model on d2: right everywhere at half the cost of always m1
    got = SE.select_on_dev(dev, decisions(spark, 0.8), "heads", ["joint", "heads", SE.UNCERTAIN]).collect()
    assert [(r.benchmark, r.official_router_name, r.official_router_policy, r.uncertainty_threshold) for r in got] == [
        ("gsm8k", SE.UNCERTAIN, "phase2_uncertainty_aware", 0.65)]
    # no threshold helps: the heads alone are as good, and come first
    got = SE.select_on_dev(dev, decisions(spark, 0.6), "heads", ["joint", "heads", SE.UNCERTAIN]).first()
    assert (got.official_router_name, got.uncertainty_threshold) == ("heads", 0.55)


def test_test_rows_use_the_picked_threshold(spark):
    g = grid(spark)
    selection = SE.select_on_dev(g.where("split = 'dev'"), decisions(spark, 0.8), "heads", ["joint", "heads", SE.UNCERTAIN])
    rows = SE.replay_on_test(g.where("split = 'test'"), decisions(spark, 0.8), selection, "heads").collect()
    official = {r.sample_id: (r.selected_model, r.fallback_triggered, r.threshold) for r in rows if r.is_official}
    assert official == {"t1": ("m1", False, 0.65), "t2": ("m0", True, 0.65)} and len(rows) == 8


def test_summary_has_all_families(spark):
    g = grid(spark)
    selection = SE.select_on_dev(g.where("split = 'dev'"), decisions(spark, 0.8), "heads", ["joint", "heads", SE.UNCERTAIN])
    test = g.where("split = 'test'")
    got = SE.integrated_summary(test, SE.replay_on_test(test, decisions(spark, 0.8), selection, "heads"))
    families = [r.policy_family for r in got.orderBy("policy").collect()]
    assert sorted(families) == sorted(["fixed_model_budget"] * 2 + ["model_only", "budget_only", "joint_aggregate_utility", "joint_safe_fallback"]
                                      + [f"phase2_{r}" for r in ("threshold", "joint", "heads", SE.UNCERTAIN)])


@pytest.fixture(scope="module")
def duck(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    con.execute(f"CREATE VIEW scores AS SELECT * FROM read_parquet('{QL.score_table(spark, SF)}/*.parquet')")
    return con


CASES = {"learned_selection": ("SELECT * FROM picked", ()), "learned_integrated_summary": ("SELECT * FROM integ", ()),
         "learned_final_comparison": (FINAL_SQL.replace("official_rule_policy", "official_learned_policy"), ()),
         "learned_failures": ("""SELECT r.task_type AS benchmark, c.failure_class, coalesce(r.error_type, 'none') AS error_type, count(*) AS count,
  exact_avg(r.cost_usd) AS avg_cost, exact_avg(r.latency_s) AS avg_latency FROM testsel r JOIN classified c ON r.id = c.id WHERE r.is_official AND NOT r.is_correct GROUP BY ALL""", FAIL_CTES)}


@pytest.mark.parametrize("name", CASES)
def test_learned_chain_equals_sql_over_the_written_scores(spark, duck, name):
    body, more = CASES[name]
    got = rounded(getattr(QL, name)(spark, SF))
    doubles = [f.name for f in got.schema.fields if f.dataType.typeName() == "double"]
    result = duck.execute(round_doubles(expand_sums(with_views(body, *selection_ctes(QL.PRIMARY, QL.LEARNED), *more)), doubles))
    names = [d[0] for d in result.description]
    cols = sorted(got.columns)
    assert cols == sorted(names)
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=key)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=key) == want and want


def test_no_report_calls_a_rule_learned(spark):
    names = {r.official_router_name for r in QL.learned_selection(spark, SF).collect()}
    assert names <= set(QL.LEARNED)


def test_scores_are_whole_and_saved_models_give_the_same(spark, tmp_path):
    scores = QL.learned_scores(spark, SF)
    n = scores.groupBy("router_name").count().collect()
    assert {r.router_name for r in n} == {"threshold", "logreg_joint", "mlp_factorized"} and len({r["count"] for r in n}) == 1
    assert scores.where("route_confidence is null or route_confidence < 0 or route_confidence > 1 or route_model is null").isEmpty()
    labels, rest = QL.learning_rows(spark, SF)
    model = QL.train_joint(labels)
    learn.save(model, f"{tmp_path}/m")
    first = {tuple(r) for r in QL.route_joint(model, rest).select("sample_id", "route_model", "route_budget", "route_confidence").collect()}
    again = {tuple(r) for r in QL.route_joint(learn.load(spark, f"{tmp_path}/m"), rest).select("sample_id", "route_model", "route_budget", "route_confidence").collect()}
    assert first == again


def test_missing_artifact_routes_by_threshold(spark, tmp_path):
    samples = spark.createDataFrame([("a", "q 1 2 3", "gsm8k")], "sample_id string, query string, task_type string")
    got = R.route_or_threshold(spark, samples, QL.POOL, f"{tmp_path}/none", "logreg_joint", lambda rows, path: rows).first()
    assert got.router_name == "logreg_joint" and got.route_model == "m-cheap"


def test_a_sample_without_primary_decision_is_a_missing_artifact(spark):
    fallback = decisions(spark, 0.8).where("router_name = 'threshold'").drop("router_name")
    primary = decisions(spark, 0.8).where("router_name = 'heads' and sample_id <> 'd1'")
    got = {r.sample_id: (r.fallback_reason, r.route_confidence) for r in R.route_uncertain(primary, fallback, 0.7).collect()}
    assert got["d1"] == ("missing_artifact", 0.5) and got["d2"] == ("low_confidence", 0.6) and F
