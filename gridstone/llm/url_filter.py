"""URL filters by a sort-merge range join on reversed-host keys.

A url's host suffixes are turned round and joined to its path (``org.example./es/7``), so a rule for a host, its
subdomains and a path prefix is the interval of all keys that start with the rule's key.  Urls and rules are cut into
the same key ranges (boundaries from a sample; a frequent key is split by a salt), each rule going to every range its
interval touches.  Within a range both are sorted and swept once; a stack holds the nested rules whose interval is
still open, its top being the longest one.

Defined results: a null url, or one without ``://``, has empty host and path and gets ``default_no_host``; rows whose
page id is null are judged as others; very long urls are judged whole; repeated rows come back repeated; of two rules with the same host and path the
block wins; an empty rule table leaves every verdict to the defaults; extra columns of the input are not returned.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import ascii_lower, materialize, partitions, range_bounds

SCHEMA = "row_key string, rule string, action string, depth int"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_key(labels: Column, path: Column) -> Column:
    """Labels from the top-level domain down, each closed by a dot, then the path."""
    return F.concat(F.concat_ws(".", labels), F.lit("."), path)


def _sweep(batches):
    """Sorted rows (rules before urls of the same key): for each url key, the longest rule whose interval is open."""
    stack: list[tuple[str, str, str]] = []
    for batch in batches:
        out = []
        for key, row_key, rule, action in zip(batch["key"], batch["row_key"], batch["rule"], batch["action"], strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if row_key is None:
                if not stack or stack[-1][0] != key:  # block sorts before allow: the first of equal rules stays
                    stack.append((key, rule, action))
            elif stack:
                out.append((row_key, stack[-1][1], stack[-1][2], len(stack[-1][1])))
        yield pd.DataFrame(out, columns=["row_key", "rule", "action", "depth"]).astype({"depth": "int32"})


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", default_no_host: str = "block") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (page_id, url).

    ``rules``: host, path, action ('allow' or 'block').  A rule fits its host and all subdomains when the path starts
    with the rule's path; the longest fitting rule (host and path together) wins.
    """
    spark, parts = pages.sparkSession, partitions(pages.sparkSession)
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("row_key", F.sha2(F.concat_ws("\n", "host", "path"), 256))
    rules = rules.select(
        reversed_key(F.reverse(F.split(ascii_lower("host"), r"\.", -1)), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "action", F.size(F.split("host", r"\.", -1)).alias("labels"),
    )
    deepest = rules.agg(F.coalesce(F.max("labels"), F.lit(0))).first()[0]
    labels = F.reverse(F.split("host", r"\.", -1))
    distinct = urls.where(F.col("host") != "").select("row_key", "host", "path").distinct()
    keys = distinct.select(
        "row_key",
        F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(max(1, deepest)), F.size(labels))),
                              lambda n: reversed_key(F.slice(labels, F.lit(1), n), F.col("path")))).alias("key"),
    )
    bounds = range_bounds(keys, ["key", "row_key"], parts)

    @F.pandas_udf("int")
    def part_of(key: pd.Series, row_key: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) for x in zip(key, row_key, strict=True)], dtype="int32")

    low, high = part_of("key", F.lit("")), part_of(F.concat("key", F.lit(chr(0x10FFFF))), F.lit("~"))
    null = F.lit(None).cast("string")
    both = keys.select("key", "row_key", null.alias("rule"), null.alias("action"), part_of("key", "row_key").alias("part"))
    both = both.unionByName(
        rules.select("key", null.alias("row_key"), "rule", "action", low.alias("low"), high.alias("high"))
        .select("key", "row_key", "rule", "action", F.explode(F.sequence("low", "high")).alias("part")))
    swept = (
        both.repartitionById(max(parts, len(bounds) + 1), F.col("part"))
        .sortWithinPartitions("key", F.col("row_key").asc_nulls_first(), F.col("action").desc())
        .mapInPandas(_sweep, SCHEMA)
    )
    best = swept.groupBy("row_key").agg(F.max(F.struct("depth", "rule", "action")).alias("best"))
    best = materialize(best, "url-rules")  # read as a table, a frequent url on the other side of the join can be split
    fallback = F.when(F.col("host") == "", F.lit(default_no_host)).otherwise(F.lit(default))
    return urls.join(best, "row_key", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", fallback).alias("verdict"))
