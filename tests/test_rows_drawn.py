"""A11 with a key: every row is drawn in every replicate, not its value's count."""

import hashlib
import math

from gridstone.operators import reports as RE
from gridstone.plans.queries_reports import BOOT_CTES


def literal(rep, key):
    u = int(hashlib.md5(f"0:{rep}:{key}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, c = 0, math.exp(-1.0), math.exp(-1.0)
    while u >= c:
        k += 1
        p /= k
        c += p
    return k


def test_every_row_has_a_draw_of_its_own(spark):
    rows = [(i, "a" if i % 3 else None, float(i % 2)) for i in range(60)] + [(99, "a", None)]
    got = RE.bootstrap_weights(spark.createDataFrame(rows, "id int, g string, x double").repartition(4), "x", ["g"], 50, 0, key="id")
    want = {}
    for i, g, x in rows[:60]:
        for rep in range(50):
            want[g, x, rep] = want.get((g, x, rep), 0) + literal(rep, i)
    assert {(r.g, r["_x"], r["_rep"]): r["_w"] for r in got.collect()} == want


def test_the_sql_draws_rows_too():
    assert "CAST(id AS VARCHAR) AS k" in BOOT_CTES[0][1] and "GROUP BY" not in BOOT_CTES[0][1]
