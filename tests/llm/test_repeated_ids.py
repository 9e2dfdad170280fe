"""Rows that repeat a vec_id are all searched, as the query's SQL says."""

import random

import duckdb

from gridstone.llm.oracles import ORACLES
from gridstone.llm.queries import op4_vector_search


def test_repeated_ids_match_the_sql(spark, tmp_path):
    rng = random.Random(8)
    vector = lambda: [rng.choice([-1.5, -0.25, 0.5, 1.0]) for _ in range(6)]
    data = [(i, vector()) for i in range(120)] + [(i, vector()) for i in (7, 7, 50, 50, 99)]
    data += [(7, [9.0] * 6)] * 2 + [(50, [8.0] * 6)] * 9 + [(3, [9.5] * 6)] * 9
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/sf/embeddings.parquet")
    got = op4_vector_search(spark, f"file://{tmp_path}/sf")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/sf/embeddings.parquet/*.parquet')")
    want = con.execute(ORACLES["op4_vector_search"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())
