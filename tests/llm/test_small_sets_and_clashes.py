"""Near-duplicates of very short texts lose no link; mixing and dropping bear null ids, repeated ids and clashing columns."""

import random

import brute
from pyspark.sql import functions as F

from gridstone.llm import near_dup, source_mix


def short_pairs(pairs):
    """Pairs of 3 of 4, 6 of 8 and 9 of 12 shared shingles (7 and 8, 11 and 11, 13 and 16 words), of words of their own."""
    out = []
    for i in range(pairs):
        kind = i % 3
        if kind == 0:  # 3 shingles, all in the 4 of the longer text
            a = [f"p{i}w{k}" for k in range(7)]
            b = [*a, f"p{i}x"]
        elif kind == 1:  # 7 shingles each, 6 shared, 8 together
            a = [f"p{i}w{k}" for k in range(11)]
            b = [*a[:-1], f"p{i}x"]
        else:  # 9 shingles, all in the 12 of the longer text
            a = [f"p{i}w{k}" for k in range(13)]
            b = [*a, *[f"p{i}x{k}" for k in range(3)]]
        out += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    return out


def test_no_link_of_short_texts_is_lost(spark):
    data = short_pairs(20000)
    got = near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(8))
    lost = got.where("component_id <> doc_id - doc_id % 2").count()
    assert lost == 0


def test_short_texts_of_common_words_equal_brute_force(spark):
    rng = random.Random(6)
    lines = ["all rights reserved by the author", "see the next page for more", "a b c d e f g h"]
    data = [(i, " ".join(rng.choice(lines) for _ in range(rng.randrange(1, 6))) + rng.choice(["", " x", " y z"])) for i in range(300)]
    data += [(1000 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))) for i in range(400)]
    got = {r[0]: tuple(r)[1:] for r in near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.near(data)


def test_one_of_rows_that_repeat_an_id_stays_whatever_its_columns(spark):
    frame = spark.createDataFrame([(1, "one two"), (1, "three four"), (None, "x"), (None, "x")], "doc_id long, text string")
    frame = frame.withColumn("m", F.create_map(F.lit("k"), F.col("text"))).withColumn("small", F.lit(1)).withColumn("key", F.lit(2))
    assert sorted((r.doc_id or 0) for r in near_dup.drop_duplicates(frame).collect()) == [0, 0, 1]


def test_mix_draws_rows_without_an_id_apart(spark):
    rows = [(None, f"text {i}", "a") for i in range(2000)] + [(7, f"again {i}", "a") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_src", F.lit(1)).withColumn("row", F.lit(2)).withColumn("key", F.lit(3))
    out = source_mix.mix(docs, total=8000)
    got = out.groupBy("text").agg(F.count(F.lit(1)).alias("n")).collect()
    assert abs(sum(r.n for r in got) - 8000) < 400 and len({r.n for r in got}) > 4
    assert out.select("shuffle_key").distinct().count() == out.count()
    assert {"_src", "row", "key", "copy", "rate", "shuffle_key"} < set(out.columns)
    want = {t: brute.copies(17, brute.mix_key(i, t), 2.0) for i, t, _ in rows}
    assert {r.text: r.n for r in got} == {t: n for t, n in want.items() if n}
