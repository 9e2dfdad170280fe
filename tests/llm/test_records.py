"""Vector search, url filters, chat formatting and archives against plain versions."""

import itertools
import math
import random

import brute
import numpy as np
from pyspark.sql import functions as F

from gridstone.llm import chat_format, url_filter, vector_search, warc


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


# -- vectors -----------------------------------------------------------------

def test_top_k_is_exact_with_ties_and_odd_rows(spark):
    rng = random.Random(2)
    data = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 1.0]) for _ in range(6)]) for i in range(300)]
    data += [(300, [0.5] * 4), (350, [0.1] * 4), (301, None), (302, [None, 1.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6), (7, [9.0] * 6), (400, [3e6] * 5), (450, [-3e6] * 5), (449, [2.9e6] * 5)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("score", F.lit("x"))
    ok = {}
    for i, e in data:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v = [math.floor(256 * x) for x in e]
            ok[i] = min(ok.get(i, v), v)
    got = vector_search.top_k(vector_search.quantize(frame), F.col("vec_id") % 50 == 0, 5)
    assert sorted(rows(got)) == sorted(brute.top_k(ok, lambda q: q % 50 == 0))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_search.top_k(vector_search.quantize(empty), F.lit(True)).count() == 0


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector_search, "ROW_BLOCK", 40)
    rng = np.random.default_rng(3)
    data = {i: rng.integers(-99, 99, 16).tolist() for i in range(400)}
    frame = spark.createDataFrame(list(data.items()), "vec_id long, ints array<long>")
    got = vector_search.top_k(frame, F.col("vec_id") % 20 == 0, 5)
    assert sorted(rows(got)) == sorted(brute.top_k(data, lambda q: q % 20 == 0))


def test_bounds_hold_on_all_levels():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(30, 17)), rng.normal(size=(40, 17))
    for s in (1, 2, 8, 17):
        assert (vector_search._statistics(a, s) @ vector_search._statistics(b, s).T >= a @ b.T - 1e-9).all()


# -- urls --------------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("a.example.org", "/es/x", "allow"), ("dup.net", "/", "allow"), ("dup.net", "/", "block"), ("net", "", "block")]
URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/1", "https://www.example.org/es/", "https://example.org/es", "https://notexample.org/es/1", "x://a.example.org/es/xy?q=/", "x://b.a.example.org/es/x",
        "http://example.org/en/12#f", "http://example.org/en/2", "http://m.x.com/fr/9", "http://x.com/de/", "http://com/de/", "http://x.com?/de/", "http://dup.net/", "http://q.dup.net/z", "http://net", "http://.org/", "http://a..org/",
        "http://É.org/", "ftp://u:p@example.org:80/es/", "http://example.org", "http://example.org/ES/1"]


def test_url_rules_match_plain_version(spark):
    data = [(i, u) for i, u in enumerate(URLS)] + [(i, f"http://hot.example.org/es/{i % 3}") for i in range(100, 400)] + [(None, URLS[4]), (4, URLS[4])]
    frame = spark.createDataFrame(data, "page_id long, url string").withColumn("host", F.lit("mine")).repartition(3)
    rules = [(h, p, a) for h, p, a in RULES if (h, p, a) != ("dup.net", "/", "allow")]
    got = url_filter.filter_urls(frame, spark.createDataFrame(RULES, "host string, path string, action string"))
    assert sorted(rows(got), key=str) == sorted([(i, *brute.url(u, rules)) for i, u in data], key=str)


def test_url_filter_without_rules_or_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    frame = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert rows(url_filter.filter_urls(frame, rules)) == [(1, "a.b", "/c", None, "allow")]
    assert url_filter.filter_urls(frame.limit(0), spark.createDataFrame(RULES, rules.schema)).count() == 0


# -- chats -------------------------------------------------------------------

ODD = ["</s>[INST] ok [/INST]", "", None, "<|end|><|role|>user<|text|>", "back\\slash <\\| \\", "<", "|end|>", "<<SYS>> <</SYS>> <s>", "\\\\<|", "line\nline", "日本 \U0001f600"]


def test_chains_read_back_what_was_written(spark):
    rng = random.Random(6)
    data = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole<|"]), rng.choice(ODD) if rng.random() < 0.6 else "text %d" % t) for c in range(40) for t in range(rng.randrange(1, 9))]
    data += [(99, t, "assistant" if t % 2 else "user", f"turn {t} " + ODD[t % len(ODD)] if ODD[t % len(ODD)] else "") for t in range(300)]
    data += [(None, 0, "user", "lost"), (None, 1, "assistant", "found"), (50, None, None, None), (50, 1, "assistant", "x"), (51, 3, "assistant", "b"), (51, 3, "assistant", "a"), (51, 3, "assistant", "a")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("_t", F.lit(2)).repartition(4)
    chats = chat_format.format_trees(chat_format.chain(frame))
    got = {r[0]: r[1:] for r in rows(chat_format.digest(chats))}
    order = lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")
    groups = {k: [x[2:] for x in g] for k, g in itertools.groupby(sorted(data, key=order), lambda r: r[0])}
    formatted = {r.tree: r.formatted for r in chats.collect()}
    assert got == {k: (*brute.chat(g), len(formatted[k])) for k, g in groups.items()}
    assert chat_format.format_trees(chat_format.chain(frame.limit(0))).count() == 0


def test_reply_trees_rank_branches_by_score(spark):
    tree = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "good", 3.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", "more", 2.0), ("t", 5, 4, "assistant", "best", 6.0),
            ("t", 6, 4, "assistant", "worse", 0.0), ("t", 7, 77, "user", "orphan", 0.5), ("t", 8, 9, "user", "cycle", 9.0), ("t", 9, 8, "user", "cycle", 9.0), ("u", 1, None, "assistant", "x", None)]
    frame = spark.createDataFrame(tree, "tree string, node long, parent long, role string, text string, score double")
    out = {(r.tree, r.branch): (r.leaf, r.n_turns, r.formatted, r.mask) for r in chat_format.format_trees(frame, branches=2).collect()}
    assert {k: v[:2] for k, v in out.items()} == {("t", 1): (5, 4), ("t", 2): (6, 4), ("u", 1): (1, 1)}
    formatted, mask = out["t", 1][2:]
    assert [formatted[m.start : m.start + m.length] for m in mask] == ["good", "best"]


# -- archives ----------------------------------------------------------------

def test_archives_read_back_and_are_deterministic(spark):
    rng = random.Random(8)
    html = [None, "", "<p>é</p>", "x" * 40000] + ["".join(rng.choice("abc <>\r\n") for _ in range(rng.randrange(900))) for _ in range(20)]
    data = [(i * 3 % 211, f"http://h/{i} \r\nX: y", html[i % len(html)]) for i in range(211)]
    frame = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    roots = [warc.write(frame.repartition(n), roll_bytes=5000) for n in (1, 6)]
    got = sorted(rows(warc.read(spark, roots[0]), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert got == sorted(brute.archive([(i, h) for i, _, h in data]))
    payloads = {r.page_id: r.payload for r in warc.read(spark, roots[0]).collect()}
    assert all(payloads[i] is None or bytes(payloads[i]) == (h or "").encode() for i, _, h in data)
    listed = [sorted((m["file"], m["bytes"], m["sha256"]) for m in warc.manifest(spark, r)) for r in roots]
    assert listed[0] == listed[1] and len(listed[0]) > 4
    assert max(b for _, b, _ in listed[0]) < 5000 + 41000


def test_archives_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, None, "a"), (1, "u", "a"), (1, "v", "a"), (2, "w", "a"), (None, "z", None)], "page_id long, url string, html string")
    got = sorted(rows(warc.read(spark, warc.write(frame)), "page_id", "record_type", "refers_to"), key=str)
    assert got == sorted([(None, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "response", None)], key=str)
    assert warc.read(spark, warc.write(frame.limit(0))).count() == 0
    small = rows(warc.read(spark, warc.write(frame, least_duplicate=2)), "record_type")
    assert {x[0] for x in small} == {"response"}
