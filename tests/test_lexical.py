"""vocabulary, explained variance and projections against a dense numpy version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.operators import lexical as LX

STOP = ("the", "of", "and")


def texts():
    rng = random.Random(7)
    words = "solve the arithmetic problem of number and code function return équation 42 x1 value tests _a".split()
    rows = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    return rows + ["", None, "the of and", "a b c", "Solve THE Problem! solve-problem", "x" * 5000]


def dense(rows, terms, dim):
    lists = []
    for t in rows:
        kept = [w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in STOP]
        lists.append(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])
    n_of, df = Counter(w for ws in lists for w in ws), Counter(w for ws in lists for w in set(ws))
    names = sorted(sorted(n_of, key=lambda w: (-n_of[w], w))[:terms])
    x = np.array([[ws.count(w) * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w in names] for ws in lists])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    v = v[:dim] * np.sign(v[np.arange(dim), np.abs(v[:dim]).argmax(axis=1)])[:, None]
    out = x @ v.T
    return names, x, out, out.var(axis=0) / x.var(axis=0).sum()


@pytest.mark.parametrize("parts", [1, 5])
def test_model_equals_dense_numpy(spark, parts):
    rows = texts()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string").repartition(parts)
    model = LX.fit(frame, dim=8, terms=40, stop_words=STOP)
    names, x, out, explained = dense(rows, 40, 8)
    assert list(model.terms) == names and np.allclose(model.explained, explained)
    got = {r.id: [r[f"semantic_embedding_{i:02d}"] for i in range(8)] for r in LX.transform(model, frame.withColumn("semantic_embedding_00", F.lit(9))).collect()}
    assert np.allclose(np.array([got[i] for i in range(len(rows))]), out, atol=1e-9)
    assert np.allclose(np.linalg.norm(x - out @ model.components), np.sqrt(max((x**2).sum() - (out**2).sum(), 0)))


def test_few_texts_give_zeros_beyond_the_rank(spark):
    frame = spark.createDataFrame([("aa bb",), ("aa cc",), ("dd",)], "text string")
    rows = LX.transform(LX.fit(frame), frame).collect()
    assert all(r.semantic_embedding_02 == 0 for r in rows) and any(r.semantic_embedding_01 != 0 for r in rows)
    empty = LX.fit(frame.where("false"))
    assert LX.transform(empty, frame).first().semantic_embedding_00 == 0.0 and LX.transform(empty, frame.where("false")).count() == 0
