"""Operators over documents against plain versions, on texts with every odd case."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.llm import near_dup, quality_rules, secret_scan, sentence_pieces, source_mix, suffix_dedup

EMPTY = "doc_id long, text string, source string, n_chars long"


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


# -- quality rules -----------------------------------------------------------

def test_quality_statistics_match_plain_version(docs, texts):
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r[0]: r[1:] for r in rows(quality_rules.apply_rules(docs), "doc_id", *stats)}
    assert got == {i: brute.quality(t) for i, t in texts}


def test_quality_verdict_follows_the_rule_table(docs):
    judged = quality_rules.apply_rules(docs).collect()
    for r in judged:
        rules = all(r[size] < n or low <= r[stat] <= high for _, stat, low, high, size, n in quality_rules.THRESHOLDS)
        assert r.kept == (rules and not r.base_failed)
    kept = {r.doc_id for r in judged if r.kept}
    assert 126 in kept and not kept & {116, 117, 118, 119, 122, 133}


def test_quality_stage_keeps_rows_and_columns(spark, docs):
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns
    assert quality_rules.keep_good(spark.createDataFrame([], EMPTY)).count() == 0
    clash = docs.withColumn("n_words", F.lit("mine")).withColumn("_words", F.lit(1))
    assert quality_rules.keep_good(clash).columns == clash.columns
    assert set(rows(quality_rules.apply_rules(clash), "doc_id", "n_words")) == set(rows(quality_rules.apply_rules(docs), "doc_id", "n_words"))


# -- secrets -----------------------------------------------------------------

def test_secret_scan_matches_plain_version(docs, texts):
    got = {r[0]: r[1:] for r in rows(secret_scan.scan(docs))}
    assert got == {i: brute.secrets(t) for i, t in texts}
    assert "bare_key" in got[128][4] and "login" in got[128][4] and got[131][4] == ""
    assert "short_secret" in got[132][4] and "endpoint" in got[132][4] and "login" not in got[132][4]


def test_secret_scan_repeated_null_and_many(spark):
    many = " ".join(f"token={i:012d} login=user{i} secret: s{i:06d}" for i in range(400))
    data = [(1, many), (1, many), (None, "password=abcdefabcdef1"), (None, None), (2, many + " é")]
    got = sorted(rows(secret_scan.scan(spark.createDataFrame(data, "doc_id long, text string"))), key=str)
    assert got == sorted([(i, *brute.secrets(t)) for i, t in data], key=str)
    assert secret_scan.scan(spark.createDataFrame([], EMPTY)).count() == 0


def test_redaction_cuts_spans_and_keeps_columns(docs, texts):
    clash = docs.withColumn("spans", F.lit("mine")).withColumn("key", F.lit(3))
    out = secret_scan.redact(clash)
    assert out.columns == clash.columns and {r.spans for r in out.collect()} == {"mine"}
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    for i, t in texts:
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute.secrets(t)[4].split(",") if s]
        want, at = "", 0
        for s, e in spans:
            if s >= at:
                want += t[at:s] + "[REDACTED]"
            at = max(at, e)
        want = (want + t[at:]) if spans else t
        assert got[i] == (want, len(want) if spans else len(t or ""))


# -- near-duplicates ---------------------------------------------------------

def test_near_duplicates_match_plain_version(docs, texts):
    got = {r[0]: r[1:] for r in rows(near_dup.near_duplicates(docs))}
    assert got == brute.near(texts)


def test_near_duplicates_of_a_large_group(spark):
    """One base with copies of growing distance: leaders miss some links, the exact bound clears the rest."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    data = [(9000, " ".join(base))]
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        data.append((i, " ".join(words)))
    data += [(9001 + i, " ".join(base)) for i in range(40)]
    got = {r[0]: r[1:] for r in rows(near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4)))}
    assert got == brute.near(data)


def test_near_duplicates_defined_results(spark):
    long = " ".join(f"w{i}" for i in range(40))
    data = [(None, long), (1, long), (1, long), (2, long + " x"), (3, None), (4, "")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(rows(near_dup.near_duplicates(frame)), key=str)
    assert got == sorted([(None, 36, None, True), (1, 36, 1, True), (1, 36, 1, True), (2, 37, 1, False), (3, 0, 3, True), (4, 0, 4, True)], key=str)
    kept = sorted((r.doc_id or 0) for r in near_dup.drop_duplicates(frame.withColumn("n", F.lit(7)).withColumn("comp", F.lit("x"))).collect())
    assert kept == [0, 1, 3, 4]
    empty = near_dup.drop_duplicates(spark.createDataFrame([], EMPTY))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "source", "n_chars"]


def test_sketch_estimates_are_close():
    rng = np.random.default_rng(1)
    for n, shared in ((50, 45), (400, 340), (3000, 2000)):
        pool = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        doc = np.repeat([0, 1], n)
        regs = near_dup.sketch(doc, np.concatenate([pool[:n], pool[n - shared :]]), 2)
        got = near_dup.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0]
        assert abs(got - shared / (2 * n - shared)) < 0.12


# -- suffixes ----------------------------------------------------------------

def test_suffix_removal_matches_plain_version(docs, texts):
    got = {r[0]: r[1:] for r in rows(suffix_dedup.digest(suffix_dedup.remove_repeats(docs)))}
    assert got == brute.repeats([(i, (t or "").encode()) for i, t in texts])


def test_suffix_removal_of_frequent_digits(docs, texts, monkeypatch):
    """With tiny group and block sizes every way is taken: windows as rows of their own, texts in pieces."""
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    got = {r[0]: r[1:] for r in rows(suffix_dedup.digest(suffix_dedup.remove_repeats(docs)))}
    assert got == brute.repeats([(i, (t or "").encode()) for i, t in texts])


def test_suffix_spans_and_defined_results(spark):
    a = "".join(chr(97 + i * i % 23) + str(i % 7) for i in range(80))
    data = [(None, a), (5, "zz" + a), (5, a + "yy"), (6, a), (6, a), (7, None)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").withColumn("spans", F.lit(1)))
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans or []]) for r in out.collect()]
    assert (None, 160, a.encode(), []) in got and (7, 0, b"", []) in got
    assert (5, 162, b"zz", [(2, 162)]) in got and (5, 162, b"yy", [(0, 160)]) in got
    assert got.count((6, 160, b"", [(0, 160)])) == 2
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0


# -- mixing ------------------------------------------------------------------

def test_mix_draws_the_hash_seeded_poisson_counts(spark, docs, texts):
    weights = spark.createDataFrame([("src0", 1.0), ("src1", 3.0)], "source string, weight double")
    out = source_mix.mix(docs.withColumn("copy", F.lit("x")), weights, seed=4, total=600)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.copy)
    size = {s: sum(i % 3 == s for i, _ in texts) for s in range(3)}
    want = {i: brute.copies(4, brute.mix_key(i, t), {0: 1, 1: 3, 2: 0}[i % 3] / 4 * 600 / size[i % 3]) for i, t in texts}
    assert {i: sorted(c) for i, c in got.items()} == {i: list(range(1, n + 1)) for i, n in want.items() if n}
    assert any(n > 12 for n in want.values())


def test_mix_counts_are_poisson_and_shuffled(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 3000, "big").alias("source"))
    counts = [r["n"] for r in frame.select(source_mix.poisson_copies(1, F.col("doc_id").cast("string"), F.lit(2.5)).alias("n")).collect()]
    assert abs(np.mean(counts) - 2.5) < 0.1 and abs(np.var(counts) - 2.5) < 0.25
    high = [r["n"] for r in frame.select(source_mix.poisson_copies(1, F.col("doc_id").cast("string"), F.lit(90.0)).alias("n")).collect()]
    assert abs(np.mean(high) - 90) < 1 and abs(np.var(high) - 90) < 9
    out = source_mix.mix(frame).collect()
    share = sum(r.source is None for r in out) / len(out)
    assert abs(share - 0.5) < 0.05
    order = [r.doc_id for r in out]
    assert order != sorted(order)
    assert source_mix.mix(spark.createDataFrame([], EMPTY)).count() == 0


# -- sentence pieces ---------------------------------------------------------

@pytest.fixture(scope="module")
def pieces():
    with open(sentence_pieces.MODEL, "rb") as f:
        return sentence_pieces.read_model(f.read())


def test_encoding_is_the_best_path_and_decodes(docs, texts, pieces):
    scores = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4, 5)}
    byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
    unknown = min(s for _, s, kind in pieces if kind == 1) - 10
    out = sentence_pieces.encode(docs.withColumn("ids", F.lit(1)))
    assert out.columns == ["doc_id", "text", "source", "n_chars", "ids", "n_tokens"]
    got = {r.doc_id: r for r in sentence_pieces.decode(out).collect()}
    for i, t in texts:
        assert got[i].decoded == (t or "") and got[i].n_tokens == len(got[i].ids)
        if len(t or "") < 900:
            assert got[i].ids == brute.viterbi(t or "", scores, byte_ids, unknown)
    assert all(r.round_trip for r in sentence_pieces.tokenize(docs).collect())


def test_encoding_equals_the_library_on_a_unigram_model(pieces):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(sentence_pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for k, p in enumerate(proto.pieces):  # scores without ties, exact in single precision
        if p.type == 1:
            p.score = -float(10 + (k * 7919) % 32749) / 1024 - (p.piece.count("▁▁") * 30)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own = sentence_pieces.Vocabulary.from_pieces(sentence_pieces.read_model(proto.SerializeToString()))
    encoder = sentence_pieces.Encoder(own)
    for text in ("a quick brown fox jumped over it", "Überraschung  zwei Räume", "où est la bibliothèque, s'il vous plaît ?", "x" * 300, "日本 ok"):
        ids, _ = encoder.encode([text])
        best = sum(own.scores[i] for i in ids if i >= 259)
        other = sum(own.scores[i] for i in library.encode(text) if i >= 259)
        assert ids.tolist() == library.encode(text) or abs(best - other) < 1e-6
        assert own.decode(ids).decode() == text


def test_long_units_and_double_array(pieces):
    keys = [(b"a", 0), (b"ab", 1), (b"abc", 2), (b"b", 3), ("é".encode(), 4)]
    base, check, value = sentence_pieces.double_array(keys)
    for key, number in keys:
        state = 0
        for b in key:
            t = base[state] + b + 1
            assert check[t] == state
            state = t
        assert value[state] == number
    v = sentence_pieces.Vocabulary.from_pieces(pieces)
    unit = " " + "".join("abcdefghij"[i * i % 10] for i in range(40))
    assert v.solve_one(unit.encode()).tobytes() == v.solve([unit.encode()])[0]
    assert sentence_pieces.Encoder(v).encode(["z" * 20000])[1][0] > 1000
