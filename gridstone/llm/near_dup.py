"""MinHash near-duplicates with HyperMinHash registers.

A document's set holds its distinct five-word shingles (64-bit hashes).  One pass over the texts gives each set's digest
and its HyperMinHash sketch: every shingle falls into one of ``REGISTERS`` buckets, a bucket keeps the least 40-bit value
compressed to its count of leading zeros and ten mantissa bits; an empty bucket borrows from the others in a fixed random
order, so a register of two documents is equal with probability J.

1. Documents with equal sets are one class; only its smallest id goes on (groups of copies shrink to one row here).
2. ``BANDS`` keys of ``ROWS`` registers find candidates.  At J = 0.75 a pair shares no band with probability
   (1 - 0.75^5)^60 < 1e-7.  In each key's bucket all members are paired with one leader only: the member that meets most
   others.  Sketches then estimate J, corrected for collisions of registers by chance, with a margin of 5.5 standard
   deviations; what passes is confirmed on the full sets.  Sketches say little about small sets, so a set that can be
   linked with one of fewer than ``SMALL`` shingles also has a bucket for each shingle of its prefix: similar sets of n shingles
   must share one of their n - ceil(0.75 n) + 1 first shingles in any common order, and rare ones come first here.  Pairs with such
   a set skip the estimate and go straight to confirmation, so none of their links can be lost.
3. Links give components.  Members of buckets that still hold several components are paired with the bucket's
   ``LEADERS`` next leaders, and the components are joined up again.
4. What is still mixed is settled in full.  Small buckets pair their members across components.  In large ones a pair is
   listed only if an exact bound allows it: each bit that the other set's bitmap lacks stands for a shingle that the
   other set lacks, so |A and B| <= |A| - (bits of A) + (bits of both), and the same the other way round.  All of these pairs are estimated
   and confirmed like the first, and all links give the final components.

No step lists the pairs of a bucket's copies, nothing is capped, and nothing but counts reaches the driver.

Defined results: a null or wordless text has the empty set (0 shingles) and is linked with nothing; a text of one to four
words has its whole sequence as one shingle; a null id is linked with nothing, its component is null and it is kept; rows
that share an id are one document for linking, and each gets that document's component; of rows that share an id and are
to be kept, all are kept by ``near_duplicates`` and one by ``drop_duplicates``; an empty table gives an empty result;
extra columns are not returned by ``near_duplicates`` and are kept by ``drop_duplicates``; very long texts are read whole, a
few at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm.common import RangeHash, materialize, mix64, small_batches, text_parts

SHINGLE, SIMILARITY = 5, 75
ROWS, BANDS = 5, 60
REGISTERS = ROWS * BANDS
MANTISSA, VALUE_BITS = 10, 40
MARGIN = 5.5 * (0.75 * 0.25 / REGISTERS) ** 0.5
LEADERS = 8
#: Sets under this size are found by their shingles and never estimated; sets up to SMALL_PARTNER can be similar to one.
SMALL = 40
SMALL_PARTNER = (SMALL - 1) * 100 // SIMILARITY
#: Shingles in so many small sets or more come last in a prefix; fewer count as rare.
FREQUENT = 32
#: A bucket with more cross-component pairs than this lists only those that the bitmaps' bound allows.
DIRECT_PAIRS, BITMAP_LONGS = 200, 16
#: Up to so many ids (8 MB) are broadcast to pick texts; beyond, texts and ids are joined by a shuffle.
BROADCAST_IDS = 1 << 20
SKETCH = "doc_id long, n_shingles int, d1 long, d2 long, regs binary, small array<long>"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------------------
# shingles and sketches of a batch of texts
# ---------------------------------------------------------------------------

def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of the distinct shingles of every text, sorted by both."""
    data = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b" ".join(data) + b" ", np.uint8).copy()
    upper = (buf >= 65) & (buf <= 90)
    buf[upper] += 32
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    before = np.concatenate([[True], space[:-1]])
    starts = np.nonzero(~space & before)[0]
    ends = np.nonzero(space & ~before)[0]
    firsts = np.cumsum([0] + [len(d) + 1 for d in data])
    word = RangeHash(buf).ranges(starts, ends)
    doc = np.searchsorted(firsts, starts, side="right") - 1
    words = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    found_doc, found = [], []
    if len(word) >= SHINGLE:
        n = len(word) - SHINGLE + 1
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h = mix64(h * _GOLD + word[k : k + n])
        inside = doc[:n] == doc[SHINGLE - 1 :]
        found_doc.append(doc[:n][inside])
        found.append(h[inside])
    offset = np.concatenate([[0], np.cumsum(words)])
    for d in np.nonzero((words > 0) & (words < SHINGLE))[0]:
        h = np.full(1, words[d], np.uint64)
        for k in range(offset[d], offset[d + 1]):
            h = mix64(h * _GOLD + word[k : k + 1] + np.uint64(1))
        found_doc.append(np.array([d]))
        found.append(h)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    d, h = np.concatenate(found_doc), np.concatenate(found)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
    return d[new], h[new]


_orders: list[np.ndarray] = []


def _probe_order() -> np.ndarray:
    """For each register the other registers in a fixed random order, by attempt."""
    if not _orders:
        rng = np.random.default_rng(97)
        _orders.append(np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)], axis=1).astype(np.int32))
    return _orders[0]


def sketch(doc: np.ndarray, shingle: np.ndarray, count: int) -> np.ndarray:
    """HyperMinHash registers (count x REGISTERS, uint16) of the sets; rows of empty sets are zero."""
    least = np.full(count * REGISTERS, 1 << VALUE_BITS, np.int64)
    h = mix64(shingle ^ np.uint64(0x5851F42D4C957F2D))
    cell = doc * REGISTERS + ((h >> np.uint64(VALUE_BITS)) % np.uint64(REGISTERS)).astype(np.int64)
    np.minimum.at(least, cell, (h & np.uint64((1 << VALUE_BITS) - 1)).astype(np.int64))
    least = least.reshape(count, REGISTERS)
    filled = least < (1 << VALUE_BITS)
    mantissa, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
    regs = ((VALUE_BITS + 1 - exponent) << MANTISSA) + ((2 * mantissa - 1) * (1 << MANTISSA)).astype(np.int64)
    regs = regs.astype(np.uint16)
    row, column = np.nonzero(~filled & filled.any(axis=1)[:, None])
    order, attempt = _probe_order(), 0
    given = regs.copy()
    while len(row):
        source = order[attempt][column]
        ok = filled[row, source]
        given[row[ok], column[ok]] = regs[row[ok], source[ok]]
        row, column, attempt = row[~ok], column[~ok], attempt + 1
    given[~filled.any(axis=1)] = 0
    return given


def chance_equal(n: float, m: float) -> float:
    """Probability that registers of two disjoint sets of n and m shingles are equal: both minima fall in one cell."""
    a, b = max(1.0, n / REGISTERS), max(1.0, m / REGISTERS)
    zeros = np.arange(0, VALUE_BITS + 1)[:, None]
    step = 2.0 ** -(zeros + 1.0) / (1 << MANTISSA)
    low = 2.0 ** -(zeros + 1.0) + np.arange(1 << MANTISSA)[None, :] * step
    inside = lambda k: (1 - low) ** k - np.maximum(1 - low - step, 0) ** k
    return float((inside(a) * inside(b)).sum())


_chance: dict[tuple[int, int], float] = {}


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches: the share of equal registers, less what chance gives."""
    equal = (a == b).mean(axis=1)
    la, lb = np.round(np.log2(np.maximum(n, 1))).astype(int), np.round(np.log2(np.maximum(m, 1))).astype(int)
    keys = list(zip(la.tolist(), lb.tolist(), strict=True))
    for key in set(keys) - _chance.keys():
        _chance[key] = chance_equal(2.0 ** key[0], 2.0 ** key[1])
    chance = np.array([_chance[k] for k in keys])
    return (equal - chance) / (1 - chance)


# ---------------------------------------------------------------------------
# jobs
# ---------------------------------------------------------------------------

def sketches(docs: DataFrame) -> DataFrame:
    """SKETCH rows: id, set size, 128-bit digest of the set, registers, and the shingles themselves of a small set."""

    def run(batches):
        for part in text_parts(batches, "text", 256):
            doc, h = shingle_sets(part.column("text").to_pylist())
            regs = sketch(doc, h, part.num_rows)
            sums = []
            for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                cell = np.zeros(part.num_rows, np.uint64)
                np.add.at(cell, doc, mix64(h + np.uint64(salt)))
                sums.append(pa.array(cell.view(np.int64)))
            n = np.bincount(doc, minlength=part.num_rows) if len(doc) else np.zeros(part.num_rows, np.int64)
            few = (n > 0) & (n <= SMALL_PARTNER)
            offsets = np.concatenate(([0], np.cumsum(np.where(few, n, 0)))).astype(np.int32)
            small = pa.ListArray.from_arrays(pa.array(offsets), pa.array((h[few[doc]] if len(doc) else h).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int32)), *sums, pa.array([r.tobytes() for r in regs], pa.binary()), small],
                names=["doc_id", "n_shingles", "d1", "d2", "regs", "small"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame) -> DataFrame:
    """node, set: the sorted shingle hashes of each text as 64-bit integers in binary; n: their number; bits: a bitmap of
    the set, a bit by each hash; ones: the bits that are set."""

    def run(batches):
        for part in text_parts(batches, "text", 256):
            doc, h = shingle_sets(part.column("text").to_pylist())
            rows = np.arange(part.num_rows)
            starts, ends = np.searchsorted(doc, rows, side="left"), np.searchsorted(doc, rows, side="right")
            place = (mix64(h + np.uint64(0x1F83D9ABFB41BD6B)) % np.uint64(64 * BITMAP_LONGS)).astype(np.int64)
            bits = np.zeros(part.num_rows * BITMAP_LONGS, np.uint64)
            np.bitwise_or.at(bits, doc * BITMAP_LONGS + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BITMAP_LONGS)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                 pa.array((ends - starts).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(bits.view(np.int64))),
                 pa.array(np.bitwise_count(bits).reshape(part.num_rows, -1).sum(axis=1).astype(np.int32))], names=["node", "set", "n", "bits", "ones"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "node long, set binary, n int, bits array<long>, ones int")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (doc_id, distinct).  A bounded number of ids is broadcast, so texts
    stay where they are; more ids are joined by a shuffle."""
    ids = materialize(ids, "near-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")


def _keep_pairs(pairs: DataFrame, test) -> DataFrame:
    """a, b of the pairs for which ``test`` (batch to mask) holds."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield part.select(["a", "b"]).filter(pa.array(test(part)))

    return pairs.mapInArrow(run, "a long, b long")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity and, unless a set is small, whose estimate is not below it by more than the margin."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b"))
    sized = pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b"))

    def test(part):
        if not part.num_rows:
            return np.zeros(0, bool)
        r = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b")]
        n = [part.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")]
        return (np.minimum(*n) < SMALL) | (estimate(*r, *n) >= SIMILARITY / 100 - MARGIN)

    return _keep_pairs(sized, test).distinct()


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= 75 * union."""
    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = materialize(full_sets(_texts_of(docs, need)).select("node", "set"), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("s_b")), "b")

    def similar(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * shared >= SIMILARITY * (len(x) + len(y) - shared)

    def test(part):
        return np.fromiter((similar(a, b) for a, b in zip(part.column("s_a").to_pylist(), part.column("s_b").to_pylist(), strict=True)), bool, part.num_rows)

    return _keep_pairs(both, test).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) for every node of ``links`` (a, b).

    Large-star and small-star steps in turn: each points nodes to the smallest neighbour, until every node points to its
    component's smallest one.  A step is a grouped minimum and a join; a node with many neighbours is summed up before
    the shuffle, and the steps' frames are written tables.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        new = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        # Done when every component is a star: no node points to two others, or points and is pointed to.
        ends = new.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("inward")).union(new.select("v", F.lit(0), F.lit(1)))
        degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("inward").alias("inward"))
        if degrees.where("out > 1 or (out = 1 and inward = 1)").isEmpty():
            break
        edges = new
    return new.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(new.select("v", "v").distinct())


def _band_key(i: Column) -> Column:
    width = 2 * ROWS
    return F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width)))


def _prefix_keys(nodes: DataFrame) -> DataFrame:
    """node, key: a bucket for each prefix shingle of the sets that can be linked with a small one."""
    few = materialize(nodes.where(F.size("small") > 0).select("node", "small"), "near-small")
    counts = few.select(F.explode("small").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"))
    frequent = materialize(counts.where(F.col("sets") >= FREQUENT), "near-frequent")
    if frequent.count() <= BROADCAST_IDS:
        frequent = F.broadcast(frequent)
    ranked = few.select("node", F.size("small").alias("n"), F.explode("small").alias("shingle")).join(frequent, "shingle", "left")
    order = F.struct(F.coalesce("sets", F.lit(0)).alias("sets"), "shingle")
    lists = ranked.groupBy("node", "n").agg(F.sort_array(F.collect_list(order)).alias("order"))
    prefix = F.slice("order", 1, F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100).cast("int") + 1)
    return lists.select("node", F.explode(prefix).alias("first")).select("node", F.xxhash64(F.lit(-1), "first.shingle").alias("key"))


def _cross_pairs(members: DataFrame, condition: Column | None = None) -> DataFrame:
    """Pairs (a, b) of one bucket and different components; ``members``: key, node, comp and more."""
    left = members.select(*[F.col(c).alias(c if c == "key" else f"{c}_a") for c in members.columns])
    right = members.select(*[F.col(c).alias(c if c == "key" else f"{c}_b") for c in members.columns])
    met = left.join(right, (left["key"] == right["key"]) & (F.col("comp_a") < F.col("comp_b")) & (F.lit(True) if condition is None else condition))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """key, node, weight, comp, cross of the buckets that hold several components; cross: their pairs across them."""
    m = members.select("key", "node", "weight").join(comp, "node", "left")
    m = materialize(m.select("key", "node", "weight", F.coalesce("comp", "node").alias("comp")), "near-members")
    sizes = m.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    cross = sizes.groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("cross")).where("cross > 0")
    return materialize(m.join(cross, "key"), "near-mixed")


def _led(mixed: DataFrame) -> DataFrame:
    """Members paired with the leaders of their bucket that are in another component."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("weight").desc(), "node"))
    leaders = mixed.withColumn("rank", rank).where(F.col("rank") <= LEADERS).select("key", F.col("node").alias("leader"), F.col("comp").alias("other"))
    pairs = mixed.join(materialize(leaders, "near-leaders"), "key").where("comp <> other")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _remaining(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """All pairs across components that can be similar (step 4 above)."""
    direct = _cross_pairs(mixed.where(F.col("cross") <= DIRECT_PAIRS).select("key", "node", "comp"))
    large = materialize(mixed.where(F.col("cross") > DIRECT_PAIRS).select("key", "node", "comp"), "near-large")
    if large.isEmpty():
        return direct
    sets = full_sets(_texts_of(docs, large.select(F.col("node").alias("doc_id")).distinct())).select("node", "n", "bits", "ones")
    sized = materialize(large.join(sets, "node"), "near-bits")
    common = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseAND(F.get("bits_b", F.lit(i)))) for i in range(BITMAP_LONGS)), F.lit(0))
    sizes = 100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")
    # 100 * shared >= 75 * (n_a + n_b - shared), with shared at its bound
    able = (100 + SIMILARITY) * (common + F.least(F.col("n_a") - F.col("ones_a"), F.col("n_b") - F.col("ones_b"))) >= SIMILARITY * (F.col("n_a") + F.col("n_b"))
    return direct.union(_cross_pairs(sized, sizes & able)).distinct()


def _links(buckets: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: confirmed links that join up all nodes that are linked, from the members (key, node, met) of the buckets."""
    weight = buckets.groupBy("node").agg(F.sum("met").alias("weight"))
    weighed = materialize(buckets.join(weight, "node").select("key", "node", "weight"), "near-weighed")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("x")).select("key", (-F.col("x.minus")).alias("leader"))
    stars = weighed.join(leaders, "key").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    first = materialize(likely(stars, nodes), "near-likely")
    links = materialize(confirm(first, texts), "near-links")
    comp = materialize(components(links), "near-comp")
    mixed = _mixed(weighed, comp)
    led = likely(_led(mixed).join(first, ["a", "b"], "left_anti"), nodes)
    led = materialize(led, "near-likely")
    more = materialize(confirm(led, texts), "near-links")
    links = links.union(more)
    if not more.isEmpty():
        mixed = _mixed(mixed, components(links))
    rest = materialize(_remaining(mixed, texts).join(first.union(led), ["a", "b"], "left_anti"), "near-pairs")
    last = materialize(likely(rest, nodes), "near-likely")
    links = links.union(materialize(confirm(last, texts), "near-links"))
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    all_rows = materialize(sketches(texts), "near-sketches")
    filled = all_rows.where("n_shingles > 0 and doc_id is not null")
    digest = ["n_shingles", "d1", "d2"]
    classes = materialize(filled.groupBy(*digest).agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")), "near-classes")
    of_copies = filled.select("doc_id", *digest).join(classes.where("node <> last"), digest).where("doc_id <> node").select("doc_id", "node").distinct()
    chosen = classes.select("node", *digest)
    nodes = filled.withColumnRenamed("doc_id", "node").join(chosen, ["node", *digest], "left_semi")
    nodes = materialize(nodes.select("node", F.col("n_shingles").alias("n"), "regs", "small"), "near-nodes")
    keys = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), _band_key)).alias("key"))
    keys = keys.unionByName(_prefix_keys(nodes))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("met"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    buckets = materialize(keys.join(met.select("key", "met"), "key"), "near-buckets")
    copies = of_copies.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = copies if buckets.isEmpty() else copies.union(_links(buckets, nodes, texts))
    if links.isEmpty():
        comp = links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    else:
        comp = materialize(components(links), "near-comp")
    found = all_rows.select("doc_id", "n_shingles").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("comp", "doc_id")
    return found.select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each component stays, with its own columns; of rows that share its id, one.

    What goes is fewer than what stays: its ids are broadcast up to a bound, and beyond joined by a shuffle."""
    gone = materialize(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    stays = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "near-repeated")
    if repeated.isEmpty():
        return stays
    order = [F.to_json(c) if "map<" in t else F.col(c) for c, t in docs.dtypes]  # maps have no order of their own
    once = stays.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("row"))
    return stays.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("row.*"))
