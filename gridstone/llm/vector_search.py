"""Exact top-k search by multi-resolution segment statistics.

A vector's segments have means and deviations.  For a segment of w components with means p, q and deviations s, t the
inner product is at most w * (p * q + s * t), and the squared distance at least w * ((p - q)^2 + (s - t)^2); both follow
from the same two numbers.  Sums over the segments of a level bound the whole, and more segments bound it closer.  A block
of candidates is tested level by level, coarse to fine, against the k-th best score that the block has shown for the
query; exact integer products are computed for what is left.

The query set (a stated part of the rows) meets all rows in blocks: a block of queries and a block of candidates are
found by an equi-join on block numbers and handled in one task; each gives k rows per query at most.  Group sizes are set
by ``QUERY_BLOCK`` and ``ROW_BLOCK``, not by the data, and nothing passes through the driver.

Defined results: vectors that are null, hold a null or a non-finite component, or have a null id take no part; rows that
repeat an id are all queries and candidates, but not of each other (``every_row``), or the smallest of their vectors counts
(``quantize``); vectors of unlike lengths are never compared; a query with fewer than k candidates
returns all of them; an empty table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 1024, 8192
LEVELS = (2, 8)
SCHEMA = "query_id long, vec_id long, score long"


def integer_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, ints: each component as floor(scale * x), x as double; rows that take no part are left out."""
    x = F.transform("embedding", lambda v: F.col("scale") * v.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where(good).withColumn("scale", F.lit(float(scale)))
    return rows.select("vec_id", F.transform(x, lambda v: F.floor(v)).alias("ints"))


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``integer_rows``, of rows that repeat an id the one with the smallest vector."""
    return integer_rows(vectors, scale).groupBy("vec_id").agg(F.min("ints").alias("ints"))


def every_row(vectors: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """``integer_rows`` with all rows that repeat an id; of equal rows the first k, as no answer holds more of them."""
    counted = integer_rows(vectors, scale).groupBy("vec_id", "ints").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    return counted.select("vec_id", "ints", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def _statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Per row and segment sqrt(w) * mean and sqrt(w) * deviation: a product of two such rows bounds the inner product."""
    parts = np.array_split(np.arange(m.shape[1]), min(segments, m.shape[1]))
    means = np.stack([m[:, p].mean(axis=1) * len(p) ** 0.5 for p in parts], axis=1)
    deviations = np.stack([m[:, p].std(axis=1) * len(p) ** 0.5 for p in parts], axis=1)
    return np.concatenate([means, deviations], axis=1)


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return rows @ q


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query, row id, score) of each query's k best rows of this block, by bounds first; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    # Exact in floating point while no sum can reach 2^53; otherwise products are taken in 64-bit integers.
    small = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) < 2.0**53
    q, r = (queries.astype(np.float64), rows.astype(np.float64)) if small else (queries, rows)
    qf, rf = queries.astype(np.float64), rows.astype(np.float64)
    levels = [(_statistics(qf, s), _statistics(rf, s)) for s in LEVELS] if rows.shape[1] else []
    out_q, out_id, out_score = [], [], []
    for n in range(len(queries)):
        left = np.nonzero(ids != query_ids[n])[0]
        floor_score = -np.inf
        for qs, rs in levels:
            if len(left) <= 4 * k:
                break
            bound = rs[left] @ qs[n]
            if floor_score == -np.inf:  # the k rows that look best give a score that k rows reach
                seeds = left[np.argpartition(-bound, k)[: 2 * k]]
                floor_score = np.partition(_exact(q[n], r[seeds]), -k)[-k]
            # Bounds are floating-point sums: a margin far above their error keeps every row that could tie.
            left = left[bound >= floor_score - 1.0 - 1e-9 * abs(float(floor_score))]
        score = _exact(q[n], r[left])
        top = np.argsort(-score, kind="stable")[:k] if small else np.lexsort((np.arange(len(score)), -score))[:k]
        out_q.append(np.full(len(top), query_ids[n]))
        out_id.append(ids[left[top]])
        out_score.append(score[top].astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest integer inner products of each query id (rows where ``is_query``
    over vec_id holds) with all rows of other ids of ``vectors`` (vec_id, ints)."""
    sized = vectors.withColumn("dim", F.size("ints"))
    counts = sized.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(is_query, 1)).alias("queries")).first()
    query_blocks = max(1, -(-counts["queries"] // QUERY_BLOCK))
    row_blocks = max(1, -(-counts["rows"] // ROW_BLOCK))
    # Each block of queries is sent to every block of rows, and each block of rows to every block of queries.
    q = sized.where(is_query).select(
        "dim", "vec_id", "ints", F.lit(True).alias("query"), F.pmod(F.xxhash64(F.lit(1), "vec_id", "ints"), F.lit(query_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("rb"))
    r = sized.select(
        "dim", "vec_id", "ints", F.lit(False).alias("query"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"),
        F.pmod(F.xxhash64(F.lit(2), "vec_id", "ints"), F.lit(row_blocks)).alias("rb"))

    def block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        a = np.stack(left["ints"].to_numpy()).astype(np.int64).reshape(len(left), -1)
        b = np.stack(right["ints"].to_numpy()).astype(np.int64).reshape(len(right), -1)
        got = best_of_block(a, left["vec_id"].to_numpy(), b, right["vec_id"].to_numpy(), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    keys = ["dim", "qb", "rb"]
    found = q.drop("query").groupBy(*keys).cogroup(r.drop("query").groupBy(*keys)).applyInPandas(block, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
