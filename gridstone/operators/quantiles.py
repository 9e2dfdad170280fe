"""Exact percentiles without a group's values in one task.

``F.percentile`` keeps a map of all values of a group in one task.  Here values are first counted per group (a combining
aggregate).  If these counts are few altogether, a weighted percentile over them finishes; beyond ``SMALL`` rows they are
range-partitioned by group and value, and ranks are found by sums: each partition's share of a group gives its offset, only
the partitions that hold a wanted rank are numbered, and the two neighbours of each position are interpolated.  Both ways
give the same numbers; a group may spread over any number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.session import cut_lineage

#: Counts of up to so many (group, value) pairs (some 16 MB) are finished by a weighted percentile.
SMALL = 1 << 18
#: So many partitions' offsets (a few MB) are broadcast.
BROADCAST_HITS = 1 << 15


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of key columns."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)], F.lit(True))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], small: int | None = None) -> DataFrame:
    """``keys`` and, for each name of ``probabilities``, that percentile of ``value`` (linear between neighbours, nulls left
    out).  Without keys: one row, or none if there is no value."""
    keys, names = list(keys), list(probabilities)
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    if counts.count() <= (SMALL if small is None else small):
        found = counts.groupBy(*keys).agg(F.percentile("_v", [probabilities[n] for n in names], F.col("_c")).alias("_q"), F.count(F.lit(1)).alias("_n"))
        return found.where("_n > 0").select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(counts.repartitionByRange(parts, *keys, "_v").withColumn("_part", F.spark_partition_id()))
    shares = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).withColumn("_total", F.sum("_s").over(group))
    place = {n: (F.col("_total") - 1) * F.lit(p) for n, p in probabilities.items()}
    ranks = [r for n in names for r in (F.floor(place[n]), F.ceil(place[n]))]
    wanted = reduce(lambda a, b: a | b, [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_s")) for r in ranks])
    hits = shares.where(wanted).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_before", "_total")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    near = ranged.join(hits, (F.col("_part") == F.col("_p")) & same_keys(keys, [f"_k_{k}" for k in keys]))
    end = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    numbered = near.withColumn("_end", end)
    at = lambda rank: F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), F.col("_v")))
    picked = numbered.groupBy(*keys).agg(F.first("_total").alias("_total"), *[at(f(place[n])).alias(f"_{side}_{n}") for n in names for side, f in (("lo", F.floor), ("hi", F.ceil))])

    def between(n: str) -> Column:
        share = place[n] - F.floor(place[n])
        return F.when(share == 0, F.col(f"_lo_{n}")).otherwise((1 - share) * F.col(f"_lo_{n}") + share * F.col(f"_hi_{n}"))

    return picked.select(*keys, *[between(n).alias(n) for n in names])


def with_quantiles(df: DataFrame, keys: Sequence[str], aggregates: list[Column], value: str, probabilities: dict[str, float]) -> DataFrame:
    """``df`` grouped by ``keys`` with ``aggregates`` and the percentiles beside them."""
    keys = list(keys)
    grouped = df.groupBy(*keys).agg(*aggregates)
    if not keys:
        row = quantiles(df, (), value, probabilities)
        return grouped.select("*", *[row.select(n).scalar().alias(n) for n in probabilities])
    found = quantiles(df, keys, value, probabilities)
    renamed = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *probabilities)
    return grouped.join(renamed, same_keys(keys, [f"_k_{k}" for k in keys]), "left").drop(*[f"_k_{k}" for k in keys])
