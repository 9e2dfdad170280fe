"""S7, S9, S5, G7, S2, S3 on small hand-made rows; dict literals against Python's own reader."""

import ast
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridstone.functions.utility import with_sample_id
from gridstone.sources import literals as LT
from gridstone.sources import samples as SP
from gridstone.sources import traces as TR

CASES = [
    {}, {"a": "b"}, {"it's": 'say "x"', "both": "'\"'"}, {"n": 1, "f": -2.5e-3, "t": True, "no": False, "none": None}, {"lines": "a\nb\r\tc", "slash": "C:\\new\\x41"},
    {"nested": {"l": [1, "two, 2", (3, None)], "d": {"k": "v"}}, "tuple": (1,), "empty": [], "et": ()}, {"é日": "😀", "\x07": "\x1b[0m"}, {1: "one", 2.5: "x"}, {"comma, colon: {brace}": "], )"}]
BAD = [None, "", "abc", "[1, 2]", "{'a': }", "{'a': 1", "None", "{'a' 1}", "{'a': nan}"]


def plain(value):
    return {str(k): None if v is None else json.dumps(v) if isinstance(v, (dict, list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in value.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        if v is not None and v[:1] in "[{":
            assert json.loads(got[k]) == json.loads(v)
        elif v is not None and got[k] != v:
            assert float(got[k]) == float(v)
        else:
            assert got[k] == v


def test_literals_are_read_as_python_reads_them(spark):
    rows = [(i, repr(c)) for i, c in enumerate(CASES)]
    got = {r.i: r.m for r in spark.createDataFrame(rows, "i int, t string").select("i", LT.parse_literal(F.col("t")).alias("m")).collect()}
    for i, c in enumerate(CASES):
        same(got[i], plain(c))
    bad = spark.createDataFrame([(b,) for b in BAD], "t string").select(LT.parse_literal(F.col("t")).alias("m")).collect()
    assert [r.m for r in bad] == [{}] * len(BAD)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text(alphabet="ab'\"\\\n,:{}é \t", max_size=6), st.text(alphabet="ab'\"\\\n,:{}[]é \r", max_size=10), max_size=4), min_size=1, max_size=12))
def test_written_literals_come_back(spark, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, m map<string,string>")
    out = frame.select("i", LT.write_literal(F.col("m")).alias("t")).collect()
    assert [ast.literal_eval(r.t) for r in sorted(out)] == values
    again = spark.createDataFrame([(i, repr(v)) for i, v in enumerate(values)], "i int, t string").select("i", LT.parse_literal(F.col("t")).alias("m")).collect()
    assert [r.m for r in sorted(again)] == values


def test_trace_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith lines', {"sample_id": "s,1", "note": "it's\n\"x\""}, "007"), (2, None, {}, None), (3, "é\\n", {"k": None}, "1,000")]
    schema = "id long, output_text string, metadata map<string,string>, extracted_answer string"
    TR.write_trace_csv(spark.createDataFrame(rows, schema).coalesce(1), f"{tmp_path}/csv")
    got = TR.read_trace_csv(spark, f"{tmp_path}/csv", schema)
    assert [tuple(r) for r in got.orderBy("id").collect()] == rows
    # The id of the metadata, else the row's
    assert [r.sample_id for r in with_sample_id(got).orderBy("id").collect()] == ["s,1", "2", "3"]


def test_stored_columns_are_decoded(spark):
    rows = [(1, "q", 256, '{"budget_id": "b-x"}', '{"sample_id": "s1"}', None), (2, "q2", 0, "", '{"query_id": 7}', ""), (3, None, 1024, "not json", None, "given")]
    df = spark.createDataFrame(rows, "id long, query string, selected_budget int, budget_config string, metadata string, query_id string")
    got = TR.decode_traces(df).orderBy("id").collect()
    assert [(r.query_id, r.selected_budget_id, r.query_text, r.budget_config) for r in got] == [
        ("s1", "b-x", "q", {"budget_id": "b-x"}), ("7", "budget-0", "q2", {}), ("given", "budget-1024", None, {})]


def test_expected_answers_and_rejects(spark):
    rows = [(1, "gsm8k", "12 then 13 #### 1,234.50"), (2, "gsm8k", "#### none"), (3, "gsm8k", "so 7 and -8"), (4, "math", r"x \boxed{1} then \boxed{\frac{1}{2}}"), (5, "math", r"\boxed{a"),
            (6, "math", "The final answer:  42 apples \nmore"), (7, "math", "no idea"), (8, "gsm8k", None), (9, "humaneval", " pass "), (10, "gsm8k", "#### 5 #### 6"), (11, "math", r"\boxed{ }"), (12, "gsm8k", "3.00")]
    good, bad = SP.build_expected(spark.createDataFrame(rows, "id int, task_type string, solution string"))
    assert {r.id: r.expected_answer for r in good.collect()} == {1: "1234.5", 3: "-8", 4: r"\frac{1}{2}", 6: "42 apples", 9: "pass", 10: "6", 12: "3"}
    assert {r.id: r.reject_reason for r in bad.collect()} == {2: "no_number", 5: "no_box_or_answer", 7: "no_box_or_answer", 8: "empty_solution", 11: "no_box_or_answer"}


def test_two_pools_and_validation(spark, tmp_path):
    a, b = spark.range(5).select(F.col("id").alias("k")), spark.range(100, 110).select(F.col("id").alias("k"))
    got = {(r.k, r.split, r.sample_id) for r in SP.assign_splits_of_pools(a, b, "k", 3, 2, 4, "x").collect()}
    assert got == {(i, "train", f"x_train_{i + 1:03d}") for i in range(3)} | {(100, "dev", "x_dev_001"), (101, "dev", "x_dev_002")} | {(102 + i, "test", f"x_test_{i + 1:03d}") for i in range(4)}
    fields = "sample_id string, task_type string, query string, expected_answer string, split string"
    rows = [("s1", "math", "q", "1", "dev"), ("\t", "math", "q", "1", "dev"), ("s2", "math", "\n\t ", "1", "dev"), ("s3", "math", "q", "\u3000\x1f", "test")]
    df = spark.createDataFrame(rows, fields)
    with pytest.raises(ValueError, match="empty_expected_answer \\(1\\), empty_query \\(1\\), empty_sample_id \\(1\\)"):
        SP.write_samples(df, f"{tmp_path}/s")
    SP.write_samples(df, f"{tmp_path}/s", f"{tmp_path}/bad")
    assert [r.sample_id for r in SP.read_samples(spark, f"{tmp_path}/s").collect()] == ["s1"] and spark.read.json(f"{tmp_path}/bad").count() == 3
