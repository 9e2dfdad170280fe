"""Whole tables of texts are counted by their bytes, with the results of the column expressions."""

import random

from pyspark.sql import functions as F

from gridstone.config import MATH_SYMBOLS, PUNCTUATION, SURFACE_CODE_MARKERS
from gridstone.functions import features as FT

#: İ becomes i and a dot, the Kelvin sign becomes k; the last ones share bytes with wide white space.
ODD = ["İmport x", "import x", "IMPORT X", "DeF f", "Kelvin returN", "\x85a\xa0b c　", " ​  ", "\u0085Å₅ゅ\u0080ႀ₀é", "😀 😀", "", " ", "a", " a", "a "]


def texts():
    rng = random.Random(5)
    parts = [*FT.WS_CHARS, *MATH_SYMBOLS, *PUNCTUATION, *FT.DIGITS, *SURFACE_CODE_MARKERS, *"abXYéİK₅​😀"]
    return [*ODD, None, *["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(500)], "9 é+. " * 20000]


def by_columns(df):
    counts = FT.surface_counts("query")
    return df.select("id", *[counts[k].alias("_n_" + k) for k in FT.COUNT_COLUMNS])


def test_counts_by_bytes_equal_those_of_the_columns(spark):
    some = spark.createDataFrame(list(enumerate(texts())), "id int, query string").repartition(3)
    got, want = FT.with_counts(some, ["id"]), by_columns(some)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_table_of_texts_is_read_by_one_arrow_function(spark):
    some = spark.createDataFrame([(0, "a 1")], "id int, query string")
    plan = FT.feature_frame(some)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan and "split(" not in plan
    assert FT.feature_frame(spark.createDataFrame([], "query string")).count() == 0


def test_other_types_are_counted_as_their_text(spark):
    row = FT.feature_frame(spark.range(7, 8).select(F.col("id").alias("query"))).first()
    assert (row["char_count"], row["digit_count"], row["word_count"]) == (1.0, 1.0, 1.0)
