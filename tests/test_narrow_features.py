"""Texts are counted once a sample; joins, training, scoring and sinks hold no texts."""

from pyspark.sql import functions as F

from gridstone.functions import features as FT
from gridstone.operators import labels as L
from gridstone.operators import learn
from gridstone.operators import routers as R
from gridstone.plans import queries_learned as QL
from gridstone.streaming import streams as ST

SF = "/root/testdata/sf0.001"
TEXTS = ["solve 1 + 2", None, "", "def f(x): return 3 ", "solve 1 + 2", "a b c　d\x1ce f"]


def samples(spark):
    return spark.createDataFrame([(f"s{i}", t, "math" if i % 2 else "custom", i) for i, t in enumerate(TEXTS)], "sample_id string, query string, task_type string, id int")


def test_fast_white_space_is_the_same_class(spark):
    every = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    found = [r.c for r in every.where(F.col("c").rlike(FT.FAST_WS)).collect()]
    assert sorted(found) == sorted(FT.WS_CHARS) and every.where(F.col("c").rlike(FT.FAST_WS) != F.col("c").rlike(FT.WS)).isEmpty()
    assert [r.w for r in samples(spark).select(FT.words(F.coalesce("query", F.lit(""))).alias("w")).collect()][5] == list("abcdef")


def test_best_budget_of_keys_equals_that_of_texts(spark):
    some = samples(spark)
    grid = some.select("*", F.explode(F.array(*map(F.lit, (0, 256, 1024)))).alias("selected_budget")).withColumns(
        {"selected_model": F.lit("m"), "is_correct": F.col("selected_budget") > F.col("id") * 200, "cost_usd": F.col("selected_budget") * 1.0, "latency_s": F.lit(1.0)})
    want = L.best_budget(grid)
    keyed = grid.withColumn("query", L.text_key("query"))
    got = L.best_budget(keyed, queries=some)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    made = FT.feature_frame(some.withColumn("_key", L.text_key("query"))).drop("query")
    narrow = L.best_budget(keyed, queries=made, columns=FT.SURFACE_COLUMNS)
    cols = ["selected_budget", "difficulty_score", "difficulty"]
    assert "query" not in narrow.columns and sorted(map(str, narrow.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_classes_are_broadcast_and_rows_stay_where_they_are(spark, capsys):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(20)], "label int, x double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        learn.balanced_weights(df, "label")[0].explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_learned_rows_hold_no_texts(spark):
    labels, rest = QL.learning_rows(spark, SF)
    assert "query" not in labels.columns and "query" not in rest.columns and set(learn.ROUTER_NUMERIC) <= set(rest.columns)
    made = QL.made_features(spark, SF)
    assert "query" not in made.columns and made.count() == 200


def test_routing_by_features_equals_routing_by_texts(spark):
    some = samples(spark).withColumns({"use_router": F.lit(True), "router_name": F.when(F.col("id") % 2 == 0, "legacy_joint_policy"), "model_id": F.lit(None).cast("string"), "budget": F.lit(None).cast("int")})
    runtime = ST.Runtime([R.PoolModel("a", "cheap"), R.PoolModel("b", "strong")])
    names = ["sample_id", "route_model", "route_budget", "route_confidence", "routed_by", "fallback_triggered"]
    want = ST.route_requests(some, runtime).select(*names).collect()
    got = ST.route_requests(FT.feature_frame(some).drop("query"), runtime).select(*names).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    out = ST.routed_stream(some, "id", lambda d: d, runtime, "narrow", 2, keep=names)
    assert out.columns == names and sorted(map(str, out.collect())) == sorted(map(str, want))
