"""Hints and budget predictions are whole and sane; what follows from them equals DuckDB over the written tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridstone.config import BUDGET_LEVELS
from gridstone.operators import labels as L
from gridstone.operators import learn
from gridstone.operators import routers as R
from gridstone.plans import queries_learned as QL
from gridstone.plans import queries_more as QM
from gridstone.plans.catalog import REGISTRY, expand_sums, load_all, rounded, with_views
from gridstone.plans.sqlfrag import round_doubles
from gridstone.sources.views import samples_view
from tools.oracle_check import key, norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck(spark):
    load_all()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    con.execute(f"CREATE VIEW hints AS SELECT * FROM read_parquet('{QL.hint_table(spark, SF)}/*.parquet')")
    con.execute(f"CREATE VIEW pred AS SELECT * FROM read_parquet('{QL.policy_table(spark, SF)}/*.parquet')")
    return con


def _equal(con, df, sql):
    got = rounded(df)
    doubles = [f.name for f in got.schema.fields if f.dataType.typeName() == "double"]
    result = con.execute(round_doubles(expand_sums(sql), doubles))
    names, cols = [d[0] for d in result.description], sorted(got.columns)
    assert cols == sorted(names)
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=key)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=key) == want and want


def test_hints_and_predictions_are_whole(spark, duck):
    hints = QL.learned_hints(spark, SF)
    assert hints.count() == 600 and {r.difficulty for r in hints.select("difficulty").distinct().collect()} <= {"easy", "medium", "hard"}
    assert {r.budget_hint for r in hints.select("budget_hint").distinct().collect()} <= set(BUDGET_LEVELS)
    predictions = QL.learned_policy_predictions(spark, SF)
    assert predictions.select("sample_id", "selected_model").distinct().count() == predictions.count() == 600
    assert {r.predicted_budget for r in predictions.select("predicted_budget").distinct().collect()} <= {0, 256, 1024}


def _hinted_sql(hints):
    step = "list_position([0, 256, 1024, 4096], {})"
    scored = QM.JOINT_SQL.replace("SELECT *, 1.0 * acc - 5.0 * cost - 0.02 * lat AS u", "SELECT q.*, 1.0 * acc - 5.0 * cost - 0.02 * lat - coalesce(abs("
                                  + step.format("budget") + " - " + step.format("h.budget_hint") + ") * 0.03, 0) AS u")
    head, tail = scored.rsplit("AS c(mi, model_id, budget, bi, idx))", 1)
    scored = head + f"AS c(mi, model_id, budget, bi, idx)) q LEFT JOIN {hints} h ON h.sample_id = q.sample_id AND h.model_id = q.model_id" + tail
    return with_views(f"SELECT sample_id, task_type, route_model, route_budget, route_difficulty, route_utility FROM ({scored})", QM.FIRSTQ)


def test_hint_branch_of_the_joint_rule_equals_sql(spark, duck):
    _equal(duck, QL.hinted_joint_router(spark, SF), _hinted_sql("hints"))
    # hints of every level, and samples without any
    made = samples_view(spark, SF).where("doc_id % 9 > 0").select("sample_id", "doc_id", F.explode(F.array(*map(F.lit, QM.MODEL_IDS))).alias("model_id"))
    made = made.select("sample_id", "model_id", F.element_at(F.array(*map(F.lit, BUDGET_LEVELS)), F.pmod(F.xxhash64("doc_id", "model_id"), F.lit(4)).cast("int") + 1).alias("budget_hint"))
    duck.register("made", made.toArrow())
    out = R.route_joint(QM.sample_queries(spark, SF), QM.MODEL_IDS, made)
    names = ["sample_id", "task_type", "route_model", "route_budget", "route_difficulty", "route_utility"]
    _equal(duck, out.select(*names), _hinted_sql("made"))
    plain = REGISTRY["joint_router"].build(spark, SF).select("sample_id", F.col("route_utility").alias("u"))
    moved = out.join(plain, "sample_id").where("route_utility < u - 0.001")
    assert 0 < moved.count() < out.count()  # the hints act


def test_calibration_of_the_learned_policy_equals_sql(spark, duck):
    sql = REGISTRY["calibration"].sql
    start = sql.index("pred AS (")
    end = sql.index(",\npolrep AS")
    _equal(duck, QL.learned_calibration(spark, SF), sql[:start] + sql[end + 2 :])
    replayed = {r.policy: r for r in QL.learned_policy_replay(spark, SF).collect()}
    raw, safe = replayed["learned_policy_raw"], replayed["learned_policy_calibrated"]
    assert raw.n == safe.n == 120 and (safe.safe_mode or (raw.accuracy, raw.avg_cost) == (safe.accuracy, safe.avg_cost))
    if safe.safe_mode:
        fixed = duck.execute(with_views(f"SELECT avg(CAST(is_correct AS DOUBLE)) FROM grid WHERE split = 'test' AND selected_budget = {safe.fallback_budget}")).fetchone()[0]
        assert abs(fixed - safe.accuracy) < 1e-9


def test_out_of_fold_difficulty_never_sees_its_own_query(spark):
    """A label that only the query itself tells can be learned in fold, not out of fold."""
    rows = [(f"word{'x' * (i % 5)} {i % 10}{i % 10} " * (1 + i % 7), "math", ["easy", "medium", "hard"][i % 3]) for i in range(90)]
    labelled = spark.createDataFrame(rows, "query string, task_type string, difficulty string").dropDuplicates(["query"])
    got = learn.difficulty_out_of_fold(labelled)
    assert got.count() == labelled.count() and set(got.columns) == {*labelled.columns, "predicted_difficulty"}
    folds = got.groupBy(F.pmod(F.xxhash64(F.lit("fold"), "query"), F.lit(3)).alias("f")).count().count()
    assert folds == 3


def test_labels_of_narrow_keys_keep_texts(spark):
    samples = samples_view(spark, SF).select("query", "task_type")
    got = L.difficulty_labels(samples)
    assert got.exceptAll(got.dropDuplicates(["query", "task_type"])).isEmpty() and got.select("query").exceptAll(samples.select("query").distinct()).count() == 0
    assert "query" not in L._difficulty(samples.select(L.text_key("query").alias("_key"), "task_type", F.lit(1.0).alias("difficulty_score"))).columns
