"""Helpers shared by the training-data operators: tables, written intermediates, range boundaries, byte hashes."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.session import shared_path

#: FIXED VALUES: a word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends at a table that outlives executors.

    Spark is told to drop the shuffle files of this one job once the table is written.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches to Python limited by bytes as well as rows: very long texts come a few at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def text_parts(batches, column: str, rows: int, size: int = 4 << 20):
    """Slices of Arrow batches of up to ``rows`` rows and, unless a single text is longer, ``size`` bytes of text."""
    for batch in batches:
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        at = 0
        while at < batch.num_rows:
            n = int(np.searchsorted(np.cumsum(length[at : at + rows]), size, side="right"))
            n = max(1, min(n, rows))
            yield batch.slice(at, n)
            at += n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def range_bounds(df: DataFrame, cols: list[str], parts: int, per_part: int = 32) -> list[tuple]:
    """``parts - 1`` or fewer ascending boundary tuples over ``cols``.

    The sample holds the rows whose hash falls under a rate, so it does not depend on task order: the same rows give
    the same boundaries.  About ``parts * per_part`` short keys reach the driver, whatever the number of rows.
    """
    total = df.count()
    every = max(1, total // (parts * per_part))
    got = df.where(F.pmod(F.xxhash64(F.lit(11), *cols), F.lit(every)) == 0).select(*cols).collect()
    keys = sorted(tuple(r) for r in got if None not in tuple(r))
    cuts = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    return sorted(set(cuts))


# ---------------------------------------------------------------------------
# vectorised hashes of byte ranges (64-bit polynomial prefix sums, finalised)
# ---------------------------------------------------------------------------

_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
_TABLE = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power_table(which: str, base: np.ndarray, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.ones(size, np.uint64)
        k = 1
        while k < size:
            out[k : 2 * k] = out[:k] * (out[k - 1 : k] * base)
            k *= 2
        _powers[which] = have = out
    return have


def _inverse() -> np.ndarray:
    x = _BASE.copy()
    for _ in range(6):
        x = x * (np.uint64(2) - _BASE * x)
    return x


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class RangeHash:
    """Hashes of any byte ranges of one buffer in constant time each: equal bytes give equal hashes wherever they lie."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.inv = _power_table("inv", _inverse(), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buf] * _power_table("pow", _BASE, n + 1)[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inv[start])

    def fixed(self, width: int) -> np.ndarray:
        """Hash of each ``width``-byte string, by its start."""
        n = len(self.sums) - 1
        return mix64((self.sums[width:] - self.sums[:-width]) * self.inv[: n - width + 1])
