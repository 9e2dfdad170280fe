"""The corpus pipeline: stages that each read what the one before them kept, written as Parquet in between.

Defined results: a null or empty text fails the first stage; very long texts pass or fail by the same ratios as others and are
carried whole; of equal and near texts the one with the smallest id stays, of rows that share that id one; rows without an id
are linked with nothing and are mixed by their text; further columns, whatever their names, are carried through all stages
but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridstone.llm import near_dup, quality_rules, secret_scan, sentence_pieces, source_mix
from gridstone.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near-duplicates stays."""
    return near_dup.drop_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: reported secrets are cut out of the texts."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: all sources at equal weight; a document comes as often as its Poisson count says."""
    return source_mix.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the token ids of every document, checked by decoding them."""
    return sentence_pieces.tokenize(docs)


STAGES = [("quality rules", quality), ("near-duplicates", duplicates), ("secret scans", secrets), ("mixing sources", mixing), ("sentence pieces", tokens)]

#: Tokenization has no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
