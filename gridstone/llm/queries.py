"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm import chat_format, context_identifiers, lexical_search, near_dup, quality_rules, secret_scan, sentence_pieces, source_mix, spelling_variants, suffix_dedup, url_filter, vector_search, warc
from gridstone.llm.common import table
from gridstone.llm.oracles import ORACLES  # noqa: F401

#: Fixed rules of the url query: host, path, action.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.tokenize(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(vector_search.every_row(table(spark, sf_dir, "embeddings"), 5), F.col("vec_id") % 50 == 0, 5)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest(chat_format.format_trees(chat_format.chain(turns)))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources at equal target weight, as many rows on average as there are documents."""
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_identifiers.digest(context_identifiers.find(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_sentence_pieces, op2_quality_rules, op3_secret_scan, op4_vector_search, op5_url_filter, op6_chat_format,
    op7_suffix_dedup, op8_near_dup, op9_source_mix, op10_warc, op11_lexical_search, op12_private_data, op13_spelling_variants)}
