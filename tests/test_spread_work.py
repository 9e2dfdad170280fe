"""The landing folder of a stream is dealt out in small row groups; dev selection ranks narrow rows."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gridstone.operators import selection as SE
from gridstone.streaming import streams as ST


def test_a_slice_in_one_file_is_dealt_out_in_row_groups(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ST, "shared_path", lambda spark, name: str(tmp_path / name))
    noise = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{i}")), 512) for i in range(8)])
    table = spark.range(20_000).select("id", noise.alias("text")).coalesce(1)  # some 20 MB
    seen = []
    ST.replay(table, "id", "texts", lambda stream: seen.append(stream.schema), slices=1)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(str(tmp_path / "texts-landing/*.parquet"))]
    assert len(seen) == 1 and len(groups) == 1 and groups[0] >= 3
    assert spark.read.parquet(str(tmp_path / "texts-landing")).exceptAll(table).isEmpty()


def test_dev_selection_ranks_no_column_that_the_sums_do_not_need(spark):
    dev = spark.createDataFrame([("a", 1, "math", "m", b, b > 0, 1.0, 1.0, "wide", "wide") for b in (0, 256)], "sample_id string, id int, task_type string, selected_model string, "
                                "selected_budget int, is_correct boolean, cost_usd double, latency_s double, expected_answer string, error_type string")
    made = SE.recorded(spark.createDataFrame([("a", "m", 256, 0.9)], "sample_id string, route_model string, route_budget int, route_confidence double"), "threshold")
    both = made.unionByName(made.withColumn("router_name", F.lit("heads")))
    got = SE.select_on_dev(dev, both, "heads", ("heads", SE.UNCERTAIN))
    plan = got._jdf.queryExecution().analyzed().toString()
    ranked = [line for line in plan.splitlines() if "min_by" in line]
    assert ranked and not any("expected_answer" in line or "error_type" in line for line in ranked)
    assert [(r.benchmark, r.official_router_name) for r in got.collect()] == [("math", "heads")]
