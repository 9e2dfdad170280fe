"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture and so a mean repetition rate (target rows / rows it has).  A document's
number of copies is a Poisson variate with that mean: a uniform number from a hash of (seed, document) is put through
the inverse Poisson distribution.  No state, no sampling pass: a retried task draws the same copies.  The copies then
go to random partitions and are ordered there by a second hash, which shuffles the mixture globally.

A mean above ``CHUNK`` is drawn as the sum of independent variates of equal smaller means, so the distribution has no
cap at any rate.

Defined results: a null text is carried along; a null source is a source of its own; draws and places in the
shuffle come from the id and a hash of the text, so rows with null or repeated ids are drawn apart unless their texts are equal,
too; very long texts are hashed whole; sources without a target weight share ``other`` (0 by default: they are left out); an
empty table gives an empty result; extra columns are carried along, and those named ``copy``, ``rate`` or
``shuffle_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import materialize, partitions

#: The table of rates is broadcast up to this many sources (well under a megabyte); beyond, it is a plain join.
BROADCAST_SOURCES = 5_000
CHUNK = 16.0
#: Largest count looked at in one chunk: at mean 16 the distribution is 1 to double precision long before.
TERMS = 96


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5, the same in every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def inverse_poisson(u: Column, mean: Column) -> Column:
    """Smallest k whose cumulative Poisson probability exceeds ``u``."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"), (u < F.exp(-mean)).alias("done"))

    def step(a, j):
        p = a["p"] * mean / j
        c = a["c"] + p
        return F.when(a["done"], a).otherwise(
            F.struct(p.alias("p"), c.alias("c"), j.alias("k"), ((u < c) | (c == a["c"])).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["k"]


def poisson_copies(seed: int, key: Column, mean: Column) -> Column:
    """Number of copies: the sum of ``ceil(mean / CHUNK)`` hash-seeded draws (one draw at usual rates)."""
    chunks = F.greatest(F.ceil(mean / CHUNK).cast("int"), F.lit(1))
    draw = lambda i: inverse_poisson(uniform(seed, i.cast("string"), key), mean / chunks)
    return F.aggregate(F.sequence(F.lit(1), chunks), F.lit(0), lambda a, i: a + draw(i))


def source_rates(docs: DataFrame, weights: DataFrame | None, total: float | None = None, other: float = 0.0) -> DataFrame:
    """``source, rate``: target rows over present rows.  ``weights``: source, weight (any scale); None: equal weights."""
    sizes = materialize(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    if weights is None:
        target = sizes.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        target = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(other, ["weight"])
    sums = target.agg(F.sum("n").alias("rows"), F.sum("weight").alias("all_weight")).first()
    rows, all_weight = float(total if total is not None else sums["rows"] or 0), float(sums["all_weight"] or 0.0)
    rate = F.col("weight") / F.lit(all_weight or 1.0) * F.lit(rows) / F.col("n")
    return target.select("source", rate.alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 17, total: float | None = None, other: float = 0.0) -> DataFrame:
    """``docs`` with each row as often as its Poisson count, plus ``copy`` (from 1), ``rate`` and ``shuffle_key``,
    globally shuffled.  ``total``: rows wanted on average (default: as many as ``docs`` has)."""
    docs = docs.drop("copy", "rate", "shuffle_key")
    rates = source_rates(docs, weights, total, other)
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    # rows are packed, so no column of theirs can clash
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("from"), key.alias("key"))
    joined = packed.join(rates, F.col("from").eqNullSafe(F.col("source"))).select("row", "key", "rate")
    counted = joined.withColumn("n", poisson_copies(seed, F.col("key"), F.col("rate"))).where("n > 0")
    copies = counted.select("row", "rate", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    shuffle_key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), "key", F.col("copy").cast("string")))
    keyed = copies.select("row", "copy", "rate", shuffle_key.alias("shuffle_key"))
    shuffled = keyed.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
    return shuffled.select("row.*", "copy", "rate", "shuffle_key")
