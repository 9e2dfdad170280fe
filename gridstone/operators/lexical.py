"""Lexical semantic vectors (F4): 1-2-gram TF-IDF over the most frequent terms, reduced by a truncated SVD.

Fitting sees a reference table of texts.  Terms are counted by a combining aggregate and the ``TERMS`` most frequent ones
kept.  The TF-IDF rows are never gathered: each task sums its rows' Gram matrix (at most ``TERMS`` x ``TERMS``), the cells are
added up in Spark, and the eigenvectors of that small matrix are the right singular vectors of the whole table.  Their
signs are fixed: the component of largest size is positive.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gridstone.operators.summaries import total

TERMS, DIM = 256, 16
#: A token is a run of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Rows whose dense vectors are held at a time.
ROWS = 1024


@dataclass(frozen=True)
class Lexical:
    """A fitted model: terms with their inverse document frequencies, components (rows) by falling singular value, and the
    share of the table's variance that each explains."""

    terms: tuple[str, ...]
    idf: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    stop_words: tuple[str, ...]
    dim: int = DIM


def terms_of(text: Column, stop_words: Sequence[str]) -> Column:
    """The text's tokens without stop words, and the pairs of neighbours among them."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    kept = F.filter(tokens, lambda t: ~t.isin(*stop_words)) if stop_words else tokens

    def listed(k: Column) -> Column:
        n = F.greatest(F.size(k) - 1, F.lit(0))
        return F.concat(k, F.zip_with(F.slice(k, 1, n), F.slice(k, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))

    return F.transform(F.array(kept), listed)[0]  # inside, the text is taken apart once


def _known(terms: Column, names: Sequence[str]) -> Column:
    """``terms`` without those that a model does not hold, so that tasks in Python get no others."""
    return F.filter(terms, lambda t: t.isin(*names)) if names else F.slice(terms, 1, 0)


def vocabulary(listed: DataFrame, terms: int = TERMS) -> DataFrame:
    """``term, n, df`` of the ``terms`` most frequent terms (ties: the smaller term); ``listed``: rows with ``terms``."""
    # in a row's sorted terms the first of each run stands for the row, so one pass gives both counts
    first = lambda s: F.transform(s, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(s, i - 1) != t)).cast("int").alias("first")))
    every = listed.select(F.explode(F.transform(F.array(F.sort_array("terms")), first)[0]).alias("t"))
    counts = every.groupBy("t.term").agg(F.count(F.lit(1)).alias("n"), F.sum("t.first").alias("df"))
    return counts.orderBy(F.desc("n"), "term").limit(terms)


def _vectors(rows: list[list[str]], place: dict[str, int], idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length (zero if a text holds no known term)."""
    x = np.zeros((len(rows), len(idf)))
    for i, held in enumerate(rows):
        for t, n in Counter(held).items():
            if t in place:
                x[i, place[t]] = n
    x *= idf
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=x, where=size > 0)


def fit(texts: DataFrame, text: str = "text", dim: int = DIM, terms: int = TERMS, stop_words: Sequence[str] | None = None) -> Lexical:
    """A model of the texts of a table; ``stop_words``: Spark's English list unless given."""
    stop = tuple(StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words)
    listed = texts.select(terms_of(F.col(text), stop).alias("terms"))
    n = listed.count()
    known = sorted(vocabulary(listed, terms).collect(), key=lambda r: r.term)
    if not known:
        return Lexical((), np.zeros(0), np.zeros((0, 0)), np.zeros(0), stop, dim)
    names = tuple(r.term for r in known)
    idf = np.log((1 + n) / (1 + np.array([r.df for r in known], float))) + 1
    place = {t: i for i, t in enumerate(names)}

    def gram(batches):
        sums, cells = np.zeros(len(names)), np.zeros((len(names), len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _vectors(batch.column("terms").slice(at, ROWS).to_pylist(), place, idf)
                sums += x.sum(axis=0)
                cells += x.T @ x
        i, j = np.nonzero(np.triu(cells))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((i, np.full(len(sums), -1))), pa.int32()), pa.array(np.concatenate((j, np.arange(len(sums)))), pa.int32()), pa.array(np.concatenate((cells[i, j], sums)))],
            names=["i", "j", "v"])

    added = listed.select(_known(F.col("terms"), names).alias("terms")).mapInArrow(gram, "i int, j int, v double").groupBy("i", "j").agg(total("v").alias("v")).collect()
    sums, cells = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for r in added:
        if r.i < 0:
            sums[r.j] = r.v
        else:
            cells[r.i, r.j] = cells[r.j, r.i] = r.v
    values, vectors = np.linalg.eigh(cells)
    rank = max(1, min(dim, n - 1, len(names) - 1))
    top = vectors[:, ::-1][:, :rank].T
    top = top * np.sign(top[np.arange(rank), np.abs(top).argmax(axis=1)])[:, None]
    means = sums / n
    whole = float((np.diag(cells) / n - means**2).sum())
    explained = np.array([v @ cells @ v / n - (means @ v) ** 2 for v in top]) / (whole or 1.0)
    return Lexical(names, idf, top, explained, stop, dim)


def transform(model: Lexical, df: DataFrame, text: str = "text", prefix: str = "semantic_embedding_") -> DataFrame:
    """``df`` with ``dim`` columns of the reduced vectors, zeros beyond the model's rank."""
    place, columns = {t: i for i, t in enumerate(model.terms)}, [f"{prefix}{i:02d}" for i in range(model.dim)]
    kept = [c for c in df.columns if c not in columns]
    packed = df.select(F.struct(*kept).alias("_row"), _known(terms_of(F.col(text), model.stop_words), model.terms).alias("_terms"))

    def reduce(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = np.zeros((part.num_rows, model.dim))
                if len(model.terms):
                    out[:, : len(model.components)] = _vectors(part.column("_terms").to_pylist(), place, model.idf) @ model.components.T
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * model.dim)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["_row", "_v"])

    schema = StructType([packed.schema["_row"], StructField("_v", ArrayType(DoubleType()))])
    made = packed.mapInArrow(reduce, schema)
    return made.select("_row.*", *[F.col("_v")[i].alias(c) for i, c in enumerate(columns)])
