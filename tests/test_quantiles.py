"""Exact percentiles: the split way equals numpy and the one-task way, whatever the groups, nulls, ties and splits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.operators import quantiles as QU
from gridstone.operators import summaries as S

P = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def rows():
    rng = random.Random(4)
    out = [("big", rng.choice([1.0, 2.5, rng.random() * 1000])) for _ in range(4000)]
    out += [("small", 3.0), (None, 5.0), (None, 7.0), ("small", None), ("none", None), ("negative", -1.5), ("negative", -0.5), ("big", 1e18), ("tie", 2.0), ("tie", 2.0)]
    return out


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("small", [0, 1 << 18])
def test_quantiles_equal_numpy(spark, monkeypatch, parts, small):
    spark.conf.set("spark.sql.shuffle.partitions", str(max(parts, 4)))
    data = rows()
    got = {r[0]: tuple(r)[1:] for r in QU.quantiles(spark.createDataFrame(data, "k string, x double").repartition(parts), ["k"], "x", P, small).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    groups = {}
    for k, x in data:
        if x is not None:
            groups.setdefault(k, []).append(x)
    assert got.keys() == groups.keys()
    for k, xs in groups.items():
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[k], np.quantile(xs, list(P.values()))))


def test_without_keys_and_without_values(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "k string, x double")
    want = np.quantile([x for _, x in rows() if x is not None], 0.95)
    for small in (0, 1 << 18):
        assert math.isclose(QU.quantiles(df, (), "x", {"q": 0.95}, small).first().q, want)
        assert QU.quantiles(df.where("x is null"), (), "x", {"q": 0.95}, small).collect() == []


def test_summaries_keep_groups_without_latency(spark, monkeypatch):
    monkeypatch.setattr(QU, "SMALL", 0)
    df = spark.createDataFrame([("a", "m", 0, True, 0.5, 1.0), ("a", "m", 0, False, 0.5, 2.0), (None, "n", 0, True, 0.1, None)],
                               "task_type string, selected_model string, selected_budget int, is_correct boolean, cost_usd double, latency_s double")
    got = {r.selected_model: r for r in S.summarize_latency(df).collect()}
    assert (got["m"].p50_latency, got["m"].p95_latency, got["m"].n) == (1.5, 1.95, 2) and got["n"].p95_latency is None and got["n"].n == 1
    assert S.dashboard_kpis(df).first().p95_latency == 1.95
    assert S.dashboard_kpis(df.where("false")).first().traces == 0 and S.summarize_selection(df.where("false"), "x").first().p95_latency == 0.0
    assert S.metrics_by(df, ["selected_model"]).where("n = 2").first().accuracy == 0.5 and F
