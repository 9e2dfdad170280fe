"""The request path as streams: repeats inside a bound (X3), routing (X1), grading and appending."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridstone.operators import grading as G
from gridstone.operators import routers as R
from gridstone.plans import queries_learned as QL
from gridstone.plans.catalog import load_all
from gridstone.plans.queries_streams import learned_routed_requests
from gridstone.session import shared_path
from gridstone.sources.views import trace_log_view
from gridstone.streaming import streams as ST

AT = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
SF = "/root/testdata/sf0.001"


def _events(spark):
    """Requests repeated within minutes, hours and days, dealt so that every file holds early and late rows."""
    rng = random.Random(2)
    rows = []
    for i in range(600):
        user = 0 if i % 3 == 0 else i % 20  # one request is a third of all rows
        rows.append((9 * i, AT + dt.timedelta(minutes=rng.randrange(60 * 24 * 4)), user, "click", float(i), '{"k": %d}' % i))
    rows += [(9 * (600 + i), None, 3, "click", 0.0, "{}") for i in range(3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def _plain(events):
    """First rows of runs whose members follow each other within the hour, by user: (event id, size of the run)."""
    last, first, size = {}, {}, {}
    for event_id, ts, user, *_ in sorted((tuple(r) for r in events if r.ts is not None), key=lambda r: (r[1], r[0])):
        if user not in last or ts - last[user] > HOUR:
            first[user] = event_id
            size[event_id] = 0
        size[first[user]] += 1
        last[user] = ts
    return set(size.items())


@pytest.mark.parametrize("layout", ["file", "folder", "partitioned"])
def test_repeats_are_bounded_in_time_whatever_the_layout(spark, tmp_path, layout):
    events, path = _events(spark), tmp_path / "sf" / "events.parquet"
    if layout == "file":
        events.coalesce(1).write.parquet(str(tmp_path / "one"))
        path.parent.mkdir()
        path.write_bytes(next((tmp_path / "one").glob("*.parquet")).read_bytes())
    elif layout == "folder":
        events.write.parquet(str(path))
    else:
        events.write.partitionBy("event_type").parquet(str(path))
    sf = f"file://{path.parent}"
    got = [(r.id, r.n_requests) for r in load_all()["stream_traces"].build(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain(events.collect()) and len(got) < 500


def test_a_repeat_inside_the_hour_goes_and_one_two_hours_later_stays(spark):
    rows = [(i, AT + dt.timedelta(minutes=m), u, "click", 1.0, "{}") for i, (m, u) in enumerate([(0, 1), (9, 2), (50, 1), (170, 1), (171, 2)])]
    rows = [(9 * i, *rest) for i, *rest in rows]
    spark_rows = spark.createDataFrame(rows, SCHEMA)
    from gridstone.sources.views import trace_log_from_events

    for slices in (1, 2, 5):
        got = ST.answered_requests(trace_log_from_events(spark_rows), f"bound{slices}", slices=slices)
        assert sorted(r.id for r in got.collect()) == [0, 9, 27, 36]
    assert ST.answered_requests(trace_log_from_events(spark_rows.where("false")), "none").count() == 0


def test_state_is_dropped_behind_the_watermark(spark, monkeypatch):
    kept = []
    run = ST.run_available_now

    def watched(stream, name, out, checkpoint):
        run(stream, name, out, checkpoint)
        kept.append(spark.read.format("statestore").load(checkpoint).count())

    monkeypatch.setattr(ST, "run_available_now", watched)
    from gridstone.sources.views import trace_log_from_events

    got = ST.answered_requests(trace_log_from_events(_events(spark)), "evict")
    assert got.count() > 250 and max(kept) <= 25 and kept[-1] == 1  # the clock's own session


def test_routing_a_stream_equals_the_batch_routers(spark):
    got = {(r.sample_id, r.routed_by): tuple(r)[2:6] for r in learned_routed_requests(spark, SF).collect()}
    scores = spark.read.parquet(QL.score_table(spark, SF))
    of = lambda name: scores.where(F.col("router_name") == name).drop("router_name")
    for name in ("logreg_joint", "mlp_factorized"):
        want = {r.sample_id: (r.route_model, r.route_budget, r.route_confidence) for r in of(name).collect()}
        assert all(got[s, name][:3] == w for s, w in want.items()) and len(want) == 80
    unsure = R.route_uncertain(of("mlp_factorized"), of("threshold"))
    want = {r.sample_id: (r.route_model, r.route_budget, r.route_confidence, r.fallback_triggered) for r in unsure.collect()}
    assert all(got[s, "uncertainty_aware"] == w for s, w in want.items())
    assert len(got) == 600


def _responses(spark):
    rows = [(i, f"s{i % 40}", f"Final answer: {i % 7}") for i in range(120)] + [(500, "nobody", "Final answer: 3"), (501, "s1", None)]
    samples = spark.createDataFrame([(f"s{i}", "gsm8k" if i % 2 else "custom", str(i % 5)) for i in range(40)], "sample_id string, task_type string, expected_answer string")
    return spark.createDataFrame(rows, "id long, sample_id string, output_text string").repartition(4), samples


def _rows(df):
    return sorted((r.id, r.sample_id, r.score, r.is_correct, r.extracted_answer, r.error_type) for r in df.collect())


def test_graded_stream_equals_batch_also_after_a_restart(spark):
    responses, samples = _responses(spark)
    graded = G.regrade_traces(responses.join(samples, "sample_id"))
    want = sorted([*_rows(graded), (500, "nobody", 0.0, False, "3", "unknown_sample")])
    assert _rows(ST.graded_stream(responses, "id", samples)) == want

    out, checkpoint, failed = shared_path(spark, "restart-out"), shared_path(spark, "restart-ckpt"), []

    def lost(batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after the batch was written, before it was committed")

    def run(stream):
        try:
            ST.append_graded(stream, samples, out, checkpoint, after_batch=lost)
        except Exception as error:  # noqa: BLE001
            assert "lost after the batch" in str(error)
            ST.append_graded(stream, samples, out, checkpoint, after_batch=lost)

    ST.replay(responses, "id", "restart", run)
    assert failed == [1] and _rows(spark.read.parquet(out)) == want
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 4


def test_trace_log_keeps_its_columns(spark):
    got = ST.answered_requests(trace_log_view(spark, SF), "columns", slices=2)
    assert set(got.columns) == {*trace_log_view(spark, SF).columns, "request_key", "n_requests"}
