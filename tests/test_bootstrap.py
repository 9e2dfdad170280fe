"""A11 by value counts: literal draws, moments at every mean, intervals against resampling of rows."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridstone.operators import reports as RE


def uniform(seed, rep, group, x):
    return (int(hashlib.md5(f"{seed}:{rep}:{group}:{x}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def draw(u, n):
    """Smallest k whose cumulative probability exceeds u; beyond 16 the rounded normal quantile with its skewness term."""
    if n <= 16:
        p = c = math.exp(-n)
        k = 0
        while u >= c and k < 96:
            k += 1
            p *= n / k
            c += p
        return k
    z = statistics.NormalDist().inv_cdf(u)
    return max(0, math.floor(n + math.sqrt(n) * z + (z * z - 1) / 6 + 0.5))


def frame(spark, groups):
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "g string, x double").repartition(5)


def test_weights_are_the_literal_draws(spark):
    groups = {"a": [0.0] * 3 + [1.0] * 5 + [2.5], "b": [1.0] * 40 + [0.0] * 300, None: [7.0] * 2}
    got = {(r.g, r["_x"], r["_rep"]): r["_w"] for r in RE.bootstrap_weights(frame(spark, groups), "x", ["g"], 200, 9).collect()}
    want = {(g, x, rep): draw(uniform(9, rep, g or "", x), xs.count(x)) for g, xs in groups.items() for x in set(xs) for rep in range(200)}
    assert got.keys() == want.keys() and len(got) == 200 * 6  # replicates times distinct values, not rows
    assert sum(got[k] != want[k] for k in want) == 0


@pytest.mark.parametrize("n", [1, 2, 7, 16, 17, 100, 5000, 10**9])
def test_draws_have_the_poisson_mean_and_variance(spark, n):
    u = (F.col("id") + 0.5) / 20000.0
    m, v = spark.range(20000).select(RE.poisson_draw(u, F.lit(float(n))).cast("double").alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(m - n) < 0.02 * math.sqrt(n) and abs(v / n - 1) < 0.02


def test_intervals_are_those_of_resampling(spark):
    rng = random.Random(3)
    xs = [float(rng.randrange(5)) for _ in range(400)]
    got = RE.bootstrap_ci(frame(spark, {"a": xs, "b": [1.0]}), "x", ["g"], b=800).orderBy("g").collect()
    means = sorted(statistics.fmean(rng.choices(xs, k=400)) for _ in range(800))
    assert got[0].mean == statistics.fmean(xs)
    assert abs(got[0].lower - means[19]) < 0.04 and abs(got[0].upper - means[779]) < 0.04
    assert (got[1].mean, got[1].lower) == (1.0, 1.0)
    assert RE.bootstrap_ci(frame(spark, {"a": xs}).where("false"), "x", ["g"]).collect() == []
