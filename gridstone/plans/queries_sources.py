"""Registered queries: sample files, trace files, response reuse, embedding features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstone.functions import features as FT
from gridstone.functions.utility import with_sample_id
from gridstone.operators import grid as GR
from gridstone.operators import lexical as LX
from gridstone.plans import sqlfrag as Q
from gridstone.plans.catalog import register
from gridstone.session import shared_path
from gridstone.sources import samples as SP
from gridstone.sources import traces as TR
from gridstone.sources.views import samples_view, table, trace_log_view
from gridstone.streaming.streams import REQUEST_FIELDS, with_request_key

# Sample files are derived from the documents, with some fields broken by rule.
RAW_SQL = """SELECT CASE WHEN d % 53 = 5 THEN '  ' ELSE sample_id END AS sample_id, CASE WHEN d % 51 = 4 THEN 'bogus' ELSE task_type END AS task_type,
  CASE WHEN d % 50 = 3 THEN chr(10) || chr(9) ELSE query END AS query, CASE WHEN d % 59 = 6 THEN NULL WHEN d % 61 = 7 THEN chr(12288) ELSE expected_answer END AS expected_answer,
  CASE WHEN d % 47 = 8 THEN 'extra' ELSE split END AS split FROM (SELECT *, doc_id AS d FROM samples)"""
REASON_SQL = f"""CASE WHEN expected_answer IS NULL THEN 'missing:expected_answer' WHEN {Q.pystrip('sample_id')} = '' THEN 'empty_sample_id'
  WHEN task_type NOT IN ('gsm8k', 'math', 'humaneval') THEN 'unsupported_task_type' WHEN split NOT IN ('train', 'dev', 'test') THEN 'unsupported_split'
  WHEN {Q.pystrip('query')} = '' THEN 'empty_query' WHEN {Q.pystrip('expected_answer')} = '' THEN 'empty_expected_answer' END"""
JUDGED = ("judged", f"SELECT *, {REASON_SQL} AS reject_reason FROM ({RAW_SQL})")


def sample_files(spark, sf) -> str:
    """A JSON-lines folder with one line per document, written by Spark to the shared folder."""
    d = F.col("doc_id")
    broken = lambda n, r, value, field: F.when(d % n == r, F.lit(value)).otherwise(F.col(field))
    rows = samples_view(spark, sf).select(
        broken(53, 5, "  ", "sample_id").alias("sample_id"), broken(51, 4, "bogus", "task_type").alias("task_type"), broken(50, 3, "\n\t", "query").alias("query"),
        F.when(d % 59 == 6, F.lit(None)).when(d % 61 == 7, "\u3000").otherwise(F.col("expected_answer")).alias("expected_answer"),
        broken(47, 8, "extra", "split").alias("split"))
    path = shared_path(spark, "samples")
    SP.write_json_lines(rows, path)
    return path


@register("sample_scan", "SELECT task_type, split, count(*) AS n FROM judged WHERE reject_reason IS NULL GROUP BY ALL", ctes=(JUDGED,))
def sample_scan(spark, sf):
    """Samples written as JSON lines, read back, validated and counted."""
    good, _ = SP.validate_samples(SP.read_samples(spark, sample_files(spark, sf)))
    return SP.summarize_samples(good)


@register("sample_rejects", "SELECT sample_id, reject_reason, count(*) AS n FROM judged WHERE reject_reason IS NOT NULL GROUP BY ALL", ctes=(JUDGED,))
def sample_rejects(spark, sf):
    """Rejected samples with their reason."""
    _, bad = SP.validate_samples(SP.read_samples(spark, sample_files(spark, sf)))
    return bad.groupBy("sample_id", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@register("sample_filter", """SELECT sample_id, task_type, split, query FROM judged WHERE reject_reason IS NULL AND task_type = 'math' AND split = 'dev'
ORDER BY sample_id LIMIT 25""", ctes=(JUDGED,))
def sample_filter(spark, sf):
    """The first 25 math samples of the dev split."""
    good, _ = SP.validate_samples(SP.read_samples(spark, sample_files(spark, sf)))
    return SP.filter_samples(good, "math", "dev", 25).select("sample_id", "task_type", "split", "query")


@register("split_builder", """SELECT doc_id, split, concat('bench_', split, '_', lpad(CAST(rn - CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 60 ELSE 80 END AS VARCHAR), 3, '0')) AS sample_id
FROM (SELECT doc_id, rn, CASE WHEN rn <= 60 THEN 'train' WHEN rn <= 80 THEN 'dev' ELSE 'test' END AS split
      FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 100)""")
def split_builder(spark, sf):
    """60 / 20 / 20 samples by offset."""
    return SP.assign_splits(table(spark, sf, "documents").select("doc_id"), "doc_id", 60, 20, 20, "bench").select("doc_id", "split", "sample_id")


@register("trace_store", """SELECT id, sample_id, selected_budget, concat('budget-', CAST(selected_budget AS VARCHAR)) AS selected_budget_id, sample_id AS query_id,
  2 AS schema_version, '{}' AS budget_config, CASE WHEN id % 2 = 0 THEN latency_s / 100 END AS route_confidence, false AS fallback_triggered, latency_s FROM trace_log""",
          ["route_confidence", "latency_s"])
def trace_store(spark, sf):
    """Two appends, the second of an older schema, and a full scan."""
    log, path = trace_log_view(spark, sf), shared_path(spark, "trace-store")
    TR.append_traces(log.filter("id % 2 = 0").withColumn("route_confidence", F.col("latency_s") / 100), path)
    log.filter("id % 2 <> 0").select("id", "sample_id", "selected_budget", "latency_s", F.col("sample_id").alias("query_id"),
                                     F.concat(F.lit("budget-"), F.col("selected_budget").cast("string")).alias("selected_budget_id")).write.mode("append").parquet(path)
    return TR.read_traces(spark, path).select("id", "sample_id", "selected_budget", "selected_budget_id", "query_id", "schema_version", "budget_config",
                                              "route_confidence", "fallback_triggered", "latency_s")


KEYS = ", ".join(REQUEST_FIELDS)
RESPONSES = ("responses", f"SELECT {KEYS}, max(id) AS write_seq FROM trace_log WHERE id % 3 <> 0 GROUP BY {KEYS}")


def _responses(spark, sf):
    """Recorded answers, the later write of a request replacing the earlier one."""
    keyed = with_request_key(trace_log_view(spark, sf), REQUEST_FIELDS)
    written = keyed.select("request_key", *REQUEST_FIELDS, F.col("id").alias("write_seq"), F.concat(F.lit("answer "), F.col("id").cast("string")).alias("output_text"),
                           F.when(F.col("id") % 5 == 0, "APIConnectionError").alias("error_type"))
    return keyed, GR.upsert_responses(written.filter("write_seq % 3 = 1"), written.filter("write_seq % 3 = 2"), seq="write_seq")


@register("response_upsert", f"SELECT {KEYS}, write_seq, concat('answer ', CAST(write_seq AS VARCHAR)) AS output_text FROM responses", ctes=(RESPONSES,))
def response_upsert(spark, sf):
    """Last write wins per request fingerprint."""
    return _responses(spark, sf)[1].select(*REQUEST_FIELDS, "write_seq", "output_text")


@register("response_reuse", f"""SELECT t.id, r.write_seq IS NOT NULL AS cache_hit, CASE WHEN r.write_seq IS NOT NULL THEN concat('answer ', CAST(r.write_seq AS VARCHAR)) END AS reused_text
FROM trace_log t LEFT JOIN responses r USING ({KEYS})""", ctes=(RESPONSES,))
def response_reuse(spark, sf):
    """Every request looked up among the recorded answers."""
    keyed, responses = _responses(spark, sf)
    return GR.attach_responses(keyed, responses).select("id", "cache_hit", F.col("_resp_text").alias("reused_text"))


@register("trace_assembly", f"""SELECT t.id, CASE WHEN g.write_seq IS NOT NULL AND g.write_seq % 5 <> 0 THEN 1.0 ELSE 0.0 END AS score,
  coalesce(g.write_seq % 5 <> 0, false) AS is_correct,
  CASE WHEN g.write_seq % 10 = 0 THEN 'parse_error' WHEN r.write_seq % 5 = 0 THEN 'APIConnectionError' END AS error_type
FROM trace_log t LEFT JOIN responses r USING ({KEYS}) LEFT JOIN (SELECT * FROM responses WHERE write_seq % 2 = 0) g USING ({KEYS})""", ["score"], ctes=(RESPONSES,))
def trace_assembly(spark, sf):
    """Requests, answers and grades put together; failed calls stay as traces of score 0."""
    keyed, responses = _responses(spark, sf)
    seq = F.col("write_seq")
    grades = responses.filter(seq % 2 == 0).select("request_key", F.when(seq % 5 != 0, 1.0).otherwise(0.0).alias("score"), (seq % 5 != 0).alias("is_correct"),
                                                   F.when(seq % 10 == 0, "parse_error").alias("error_type"))
    requests = keyed.select("id", "request_key")
    return GR.assemble_traces(requests, responses, grades).select("id", "score", "is_correct", "error_type")


@register("embedding_features", "SELECT sample_id, " + ", ".join(f"coalesce(CAST(embedding[{i + 1}] AS DOUBLE), 0) AS semantic_embedding_{i:02d}" for i in range(16))
          + " FROM samples LEFT JOIN embeddings ON doc_id = vec_id", [f"semantic_embedding_{i:02d}" for i in range(16)])
def embedding_features(spark, sf):
    """first 16 components of the precomputed vector of each sample."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = FT.with_embedding_features(samples_view(spark, sf).select("doc_id", "sample_id"), vectors, "doc_id")
    return out.drop("doc_id")


@register("split_pools", """SELECT doc_id, split, concat('pool_', split, '_', lpad(CAST(rn - CASE split WHEN 'test' THEN 20 ELSE 0 END AS VARCHAR), 3, '0')) AS sample_id FROM (
  SELECT doc_id, rn, 'train' AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 2 = 0) WHERE rn <= 60
  UNION ALL SELECT doc_id, rn, CASE WHEN rn <= 20 THEN 'dev' ELSE 'test' END FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 2 = 1) WHERE rn <= 40)""")
def split_pools(spark, sf):
    """60 training samples of one pool (even ids), 20 + 20 of the other."""
    docs = table(spark, sf, "documents").select("doc_id")
    even = F.col("doc_id") % 2 == 0
    return SP.assign_splits_of_pools(docs.where(even), docs.where(~even), "doc_id", 60, 20, 20, "pool").select("doc_id", "split", "sample_id")


# Solutions are derived from the documents: marked, plain, boxed, worded and without an answer.
SOLUTION_SQL = """SELECT sample_id, task_type, concat(query, CASE WHEN task_type = 'gsm8k' THEN CASE doc_id % 3 WHEN 0 THEN concat(' 12 #### 1,', lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0'), '.50')
    WHEN 1 THEN ' #### none' ELSE concat(' gives ', CAST(doc_id AS VARCHAR)) END
  WHEN task_type = 'math' THEN CASE doc_id % 3 WHEN 0 THEN concat(' so ', chr(92), 'boxed{0} or ', chr(92), 'boxed{', CAST(doc_id AS VARCHAR), '}')
    WHEN 1 THEN concat(chr(10), 'Final answer:  ', CAST(doc_id AS VARCHAR), ' units', chr(10), 'done') ELSE ' unknown' END ELSE '' END) AS solution FROM samples"""
ANSWERED = ("answered", f"""SELECT *, CASE WHEN task_type = 'gsm8k' THEN CASE WHEN instr(num, '.') > 0 THEN regexp_replace(rtrim(num, '0'), '[.]$', '') ELSE num END
  WHEN task_type = 'math' THEN coalesce(nullif(list_extract(regexp_extract_all(solution, '\\\\boxed\\{{([^{{}}]*)\\}}', 1), -1), ''),
    nullif({Q.pystrip("regexp_extract(solution, '(?i)(?:final[ ]+answer|answer)[ ]*[:：][ ]*([^' || chr(10) || ']+)', 1)")}, '')) ELSE nullif({Q.pystrip('solution')}, '') END AS expected_answer
FROM (SELECT *, replace(list_extract(regexp_extract_all(list_extract(string_split(solution, '####'), -1), '[-+]?[0-9][0-9,]*(?:[.][0-9]+)?'), -1), ',', '') AS num FROM ({SOLUTION_SQL}))""")


def _questions(spark, sf):
    d, tail = F.col("doc_id"), F.col("doc_id").cast("string")
    number = (F.when(d % 3 == 0, F.concat(F.lit(" 12 #### 1,"), F.lpad((d % 1000).cast("string"), 3, "0"), F.lit(".50"))).when(d % 3 == 1, " #### none").otherwise(F.concat(F.lit(" gives "), tail)))
    boxed = (F.when(d % 3 == 0, F.concat(F.lit(" so \\boxed{0} or \\boxed{"), tail, F.lit("}"))).when(d % 3 == 1, F.concat(F.lit("\nFinal answer:  "), tail, F.lit(" units\ndone"))).otherwise(" unknown"))
    task = F.col("task_type")
    added = F.when(task == "gsm8k", number).when(task == "math", boxed).otherwise("")
    return samples_view(spark, sf).select("sample_id", "task_type", F.concat("query", added).alias("solution"))


@register("expected_answers", "SELECT sample_id, task_type, expected_answer FROM answered WHERE expected_answer IS NOT NULL", ctes=(ANSWERED,))
def expected_answers(spark, sf):
    """Expected answers of a question set."""
    return SP.build_expected(_questions(spark, sf))[0].select("sample_id", "task_type", "expected_answer")


@register("expected_rejects", f"""SELECT sample_id, task_type, CASE WHEN {Q.pystrip('solution')} = '' THEN 'empty_solution' WHEN task_type = 'gsm8k' THEN 'no_number'
  WHEN task_type = 'math' THEN 'no_box_or_answer' ELSE 'empty_solution' END AS reject_reason FROM answered WHERE expected_answer IS NULL""", ctes=(ANSWERED,))
def expected_rejects(spark, sf):
    """Questions whose solution holds no answer, with the reason."""
    return SP.build_expected(_questions(spark, sf))[1].select("sample_id", "task_type", "reject_reason")


CSV_SCHEMA = "id long, task_type string, selected_budget int, latency_s double, output_text string, metadata map<string,string>"


@register("trace_csv", """SELECT id, CASE WHEN id % 5 = 0 THEN CAST(id AS VARCHAR) ELSE sample_id END AS sample_id, task_type, selected_budget, latency_s,
  concat('line "', task_type, '",', chr(10), 'it''s ', CAST(id AS VARCHAR)) AS output_text, concat('say "x", it''s', chr(10), 'path ', chr(92), CAST(id AS VARCHAR)) AS note FROM trace_log""", ["latency_s"])
def trace_csv(spark, sf):
    """S7 + P1: traces with dict-literal metadata written as CSV and read back; the sample id comes from the metadata, else the row's id."""
    row = F.col("id").cast("string")
    note = F.concat(F.lit("say \"x\", it's\npath \\"), row)
    meta = F.when(F.col("id") % 5 == 0, F.create_map(F.lit("note"), note)).otherwise(F.create_map(F.lit("sample_id"), F.col("sample_id"), F.lit("note"), note))
    text = F.concat(F.lit('line "'), F.col("task_type"), F.lit("\",\nit's "), row)
    path = shared_path(spark, "trace-csv")
    TR.write_trace_csv(trace_log_view(spark, sf).select("id", "task_type", "selected_budget", "latency_s", text.alias("output_text"), meta.alias("metadata")), path)
    back = with_sample_id(TR.read_trace_csv(spark, path, CSV_SCHEMA))
    return back.select("id", "sample_id", "task_type", "selected_budget", "latency_s", "output_text", F.try_element_at("metadata", F.lit("note")).alias("note"))


@register("trace_decoded", """SELECT id, CASE id % 3 WHEN 0 THEN sample_id WHEN 1 THEN concat('q', CAST(id AS VARCHAR)) ELSE '' END AS query_id,
  CASE WHEN id % 4 = 0 THEN 'custom' ELSE concat('budget-', CAST(selected_budget AS VARCHAR)) END AS selected_budget_id, task_type AS query_text FROM trace_log""")
def trace_decoded(spark, sf):
    """Stored JSON columns decoded; query id, budget id and query text filled in from them."""
    i = F.col("id")
    quoted = lambda k, v: F.to_json(F.create_map(F.lit(k), v))
    stored = trace_log_view(spark, sf).select(
        "id", "selected_budget", F.col("task_type").alias("query"), F.when(i % 4 == 0, quoted("budget_id", F.lit("custom"))).otherwise("{}").alias("budget_config"),
        F.when(i % 3 == 0, quoted("sample_id", F.col("sample_id"))).when(i % 3 == 1, quoted("query_id", F.concat(F.lit("q"), i.cast("string")))).otherwise("").alias("metadata"))
    path = shared_path(spark, "trace-stored")
    stored.write.parquet(path)
    return TR.decode_traces(spark.read.parquet(path)).select("id", "query_id", "selected_budget_id", "query_text")


#: Stop words of the registered lexical queries.
STOP = ("the", "of", "and", "to", "in", "is", "de", "la", "le", "les", "et", "des", "el", "los", "der", "die", "das", "und")
_TOKENS = "regexp_extract_all(lower(concat(task_type, ' ', query)), '[\\p{L}\\p{N}_]{2,}')"
_STOPPED = ", ".join(Q.lit(w) for w in ("the", "of", "and", "to", "in", "is", "de", "la", "le", "les", "et", "des", "el", "los", "der", "die", "das", "und"))


def _lexical_texts(spark, sf, split=None):
    samples = samples_view(spark, sf)
    samples = samples if split is None else samples.where(F.col("split") == split)
    return samples.select("sample_id", F.concat_ws(" ", "task_type", "query").alias("text"))


KEPT = ("kept", f"SELECT sample_id, list_filter({_TOKENS}, lambda w: w NOT IN ({_STOPPED})) AS w FROM samples WHERE split = 'train'")
GRAMS = ("grams", "SELECT sample_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM kept")


@register("lexical_vocabulary", "SELECT term, count(*) AS n, count(DISTINCT sample_id) AS df FROM grams GROUP BY term ORDER BY n DESC, term LIMIT 256", ctes=(KEPT, GRAMS),
          note="the limit is the feature: the model's 256 terms")
def lexical_vocabulary(spark, sf):
    """the terms of the lexical model, with their counts."""
    return LX.vocabulary(_lexical_texts(spark, sf, "train").select(LX.terms_of(F.col("text"), STOP).alias("terms")))


@register("lexical_vectors", None, note="singular vectors: equal to a dense numpy version in the tests")
def lexical_vectors(spark, sf):
    """the model fitted on the train split, applied to every sample."""
    model = LX.fit(_lexical_texts(spark, sf, "train"), stop_words=STOP)
    return LX.transform(model, _lexical_texts(spark, sf)).drop("text")
