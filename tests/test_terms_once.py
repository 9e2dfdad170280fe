"""a text's terms are made and spread once for both counts, and tasks in Python get known terms only."""

from collections import Counter

from pyspark.sql import functions as F

from gridstone.operators import lexical as LX

TEXTS = ["aa bb aa cc", "bb bb", "", None, "aa", "zz yy aa bb"]


def test_vocabulary_counts_in_one_pass(spark, capsys):
    listed = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(LX.terms_of(F.col("t"), ()).alias("terms"))
    got = {r.term: (r.n, r.df) for r in LX.vocabulary(listed).collect()}
    rows = [r.terms for r in listed.collect()]
    assert rows[0] == ["aa", "bb", "aa", "cc", "aa bb", "bb aa", "aa cc"] and rows[2] == rows[3] == []
    n, df = Counter(t for r in rows for t in r), Counter(t for r in rows for t in set(r))
    assert got == {t: (n[t], df[t]) for t in n}
    LX.vocabulary(listed).explain()
    assert capsys.readouterr().out.count("Generate explode") == 1


def test_only_known_terms_leave_the_jvm(spark):
    df = spark.createDataFrame([(["aa", "bb", "aa"],)], "t array<string>")
    assert df.select(LX._known(F.col("t"), ("aa", "zz"))).first()[0] == ["aa", "aa"] and df.select(LX._known(F.col("t"), ())).first()[0] == []
