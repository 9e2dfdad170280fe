"""Ranked lexical search over bit-sliced Bloom signatures, with exact scores of all documents not provably excluded.

Index: documents of like size share a block.  A block is a bit matrix with one row per signature position (slice) and one
column per document; the slices of a term, combined by AND, are the documents that may hold it.  A document's signature
holds each of its terms once per step of ``LEVELS`` that the term's frequency reaches, so slices also bound frequencies
from above.  Signatures only ever overestimate.

Search: slice bitmaps, weighted by the terms' weights and the documents' lengths, add up to an upper bound for every
(item, document).  The documents of the highest bounds are scored exactly; the tenth best of these scores is a threshold
that the tenth best of all documents cannot fall under, so only documents whose bound reaches it are read again and scored
exactly.  No bound, threshold or candidate list is cut short.

Score of a document for an item: the sum over the item's terms, repeats included, of
``floor(1000 ln((2N + 2) / (2 df + 1))) * (1000000000 tf div (1000 tf + 8 m))``, ``m = 25 + (75 n N) div L``, in 64-bit
integers (bounds are sums of integers under 2**53 in doubles, so they are exact too).  Terms are compared as bytes when
scored; frequencies over documents count terms by a 64-bit hash together with their length in bytes.

Items are the stated query set.  They are taken in blocks of up to ``ITEMS`` items and some ``ITEM_BYTES`` bytes of text, the
only texts that the driver sees; the index is built once, in the pass that counts the first block's terms.

Defined results: a null or empty text, or one without terms, is not counted and never ranked; an item without terms
has no rows; items that repeat an id are ranked each on their own; rows that repeat a ``doc_id`` are ranked each on their
own; among equal scores a null ``doc_id`` comes last; empty tables give an empty result; very long texts are taken whole (a
block holds fewer of them); further columns of either table are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm.common import RangeHash, materialize, mix64, small_batches, text_parts

#: A signature tells whether a term occurs at least so often.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128], np.int64)
HASHES, BITS_PER_KEY = 5, 16
#: Widest signature (512 KB): longer documents fill theirs up, are overestimated and so scored exactly more often.
MAX_WIDTH = 1 << 22
BLOCK_DOCS, BLOCK_BYTES = 512, 2 << 20
#: Terms whose slices are combined at a time.
TERM_CHUNK = 2048
ITEMS, ITEM_BYTES = 512, 4 << 20
#: So many (document, item) pairs (some 16 MB) are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 1 << 20
#: FIXED VALUES of the score.
TF_SCALE, TF_ONE, LENGTH_PART, FLAT_PART = 1000000000, 1000, 75, 25

_IN_TERM = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_TO_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: On UTF-8 bytes with A-Z lowered, the maximal runs of these bytes are the terms: every code point from 128 on belongs.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

INDEX = "width int, ids array<long>, lengths array<long>, slices binary, documents long, terms long, seen array<long>"
_INDEX_ARROW = pa.schema([
    ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("slices", pa.binary()),
    ("documents", pa.int64()), ("terms", pa.int64()), ("seen", pa.list_(pa.int64()))])


def terms_of(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode("utf-8").lower())


def term_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all terms of the texts, in order: the text's number, a 64-bit hash, the length in bytes."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    buf = _TO_LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets -= offsets[0]
    inside = _IN_TERM[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True  # texts do not run into each other
    begins = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return np.searchsorted(offsets[1:], begins, side="right"), RangeHash(buf).ranges(begins, ends), ends - begins


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all distinct terms of each text: the text's number, hash, length in bytes, frequency."""
    text, h, size = term_runs(texts)
    order = np.lexsort((h, text))
    text, h, size = text[order], h[order], size[order]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    return text[new], h[new], size[new], np.diff(np.append(new, len(h)))


def positions(h: np.ndarray, level: np.ndarray, width: int) -> np.ndarray:
    """Signature positions (one row of ``HASHES`` per key) of terms at levels."""
    a = mix64(h + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    b = mix64(a.copy()) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) & np.uint64(width - 1)).astype(np.int64)


class _Block:
    """Documents of one signature width that wait for a full block."""

    def __init__(self, width: int):
        self.width, self.ids, self.lengths, self.rows, self.cols = width, [], [], [], []

    def full(self) -> bool:
        n = len(self.ids)
        return n >= BLOCK_DOCS or (n % 8 == 0 and n * self.width // 8 >= BLOCK_BYTES)

    def add(self, doc_id, length: int, rows: np.ndarray) -> None:
        self.cols.append(np.full(rows.size, len(self.ids), np.int32))
        self.rows.append(rows.ravel())
        self.ids.append(doc_id)
        self.lengths.append(length)

    def batch(self) -> pa.RecordBatch:
        bits = np.zeros((self.width, len(self.ids)), bool)
        bits[np.concatenate(self.rows), np.concatenate(self.cols)] = True
        slices = np.packbits(bits, axis=1, bitorder="little").tobytes()
        return pa.RecordBatch.from_pylist([dict(width=self.width, ids=self.ids, lengths=self.lengths, slices=slices)], _INDEX_ARROW)


def _known(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of a list of terms, their lengths, and which term each is."""
    h = term_runs(pa.array([t.decode("utf-8") for t in vocabulary], pa.string()))[1]
    order = np.argsort(h, kind="stable")
    return h[order], np.array([len(vocabulary[i]) for i in order], np.int64), order


def read_documents(docs: DataFrame, vocabulary: list[bytes], with_index: bool) -> DataFrame:
    """One pass over all texts: rows of counts (documents, terms, documents that hold each known term) and, if asked for,
    index blocks."""

    def run(batches):
        hashes, sizes, which = _known(vocabulary)
        waiting: dict[int, _Block] = {}
        documents = total = 0
        seen = np.zeros(len(vocabulary), np.int64)
        for part in text_parts(batches, "text", 2048):
            text, h, size, tf = term_counts(part.column("text"))
            length = np.bincount(text, weights=tf, minlength=part.num_rows).astype(np.int64)
            documents, total = documents + int((length > 0).sum()), total + int(length.sum())
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                at = at[(hashes[at] == h) & (sizes[at] == size)]
                seen += np.bincount(which[at], minlength=len(seen))
            if not with_index:
                continue
            ids = part.column("doc_id").to_pylist()
            reached = np.searchsorted(LEVELS, tf, side="right")
            cut = np.searchsorted(text, np.arange(part.num_rows + 1))
            for i in np.flatnonzero(length):
                lo, hi = cut[i], cut[i + 1]
                times = reached[lo:hi]
                keys = int(times.sum())
                level = np.arange(keys) - np.repeat(np.cumsum(times) - times, times)
                width = min(MAX_WIDTH, 1 << max(8, (BITS_PER_KEY * keys - 1).bit_length()))
                block = waiting.setdefault(width, _Block(width))
                block.add(ids[i], int(length[i]), positions(np.repeat(h[lo:hi], times), level, width))
                if block.full():
                    yield waiting.pop(width).batch()
        for block in waiting.values():
            yield block.batch()
        yield pa.RecordBatch.from_pylist([dict(documents=documents, terms=total, seen=seen.tolist())], _INDEX_ARROW)

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, INDEX)


class _Scorer:
    """The items of one block against the corpus: terms, weights, length terms."""

    def __init__(self, items: list[tuple], vocabulary: list[bytes], documents: int, terms: int, seen: list[int]):
        self.documents, self.terms, self.vocabulary = documents, max(terms, 1), vocabulary
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) if df else 0 for df in seen]
        number = {t: i for i, t in enumerate(vocabulary)}
        self.ids = [item_id for item_id, _ in items]
        #: Per item: term and weight times repeats; terms that no document holds or that weigh nothing add nothing.
        self.items = [[(number[t], weight[number[t]] * c) for t, c in Counter(terms_of(text)).items() if weight[number[t]] > 0] for _, text in items]

    def part(self, length):
        return FLAT_PART + LENGTH_PART * length * self.documents // self.terms

    def exact(self, text: str, wanted: list[int]) -> list[int]:
        """The text's scores for the wanted items."""
        tokens = terms_of(text)
        count, m = Counter(tokens), self.part(len(tokens))
        out = []
        for i in wanted:
            score = 0
            for term, w in self.items[i]:
                tf = count.get(self.vocabulary[term], 0)
                if tf:
                    score += w * (TF_SCALE * tf // (TF_ONE * tf + 8 * m))
            out.append(score)
        return out

    def prepare(self) -> None:
        """Per chunk of terms: their hashes, and for each item with terms there the weights."""
        used = list(dict.fromkeys(t for item in self.items for t, _ in item))
        place = {t: i for i, t in enumerate(used)}
        hashes, _, which = _known(self.vocabulary)
        by_term = np.zeros(len(self.vocabulary), np.uint64)
        by_term[which] = hashes
        self.chunks = [(by_term[used[at : at + TERM_CHUNK]], {}) for at in range(0, len(used), TERM_CHUNK)]
        for i, item in enumerate(self.items):
            for t, w in item:
                rows, weights = self.chunks[place[t] // TERM_CHUNK][1].setdefault(i, ([], []))
                rows.append(place[t] % TERM_CHUNK)
                weights.append(w)
        self.chunks = [(h, [(i, np.array(r), np.array(w, np.float64)) for i, (r, w) in wanted.items()]) for h, wanted in self.chunks]

    def bounds(self, width: int, lengths: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bounds (items x documents) of one index block."""
        n = len(lengths)
        rows = np.frombuffer(slices, np.uint8).reshape(width, -1)
        most = np.minimum(np.append(LEVELS[1:] - 1, np.iinfo(np.int64).max)[:, None], lengths[None, :])
        value = np.zeros((len(LEVELS) + 1, n))
        value[1:] = TF_SCALE * most // (TF_ONE * most + 8 * self.part(lengths)[None, :])
        out, column = np.zeros((len(self.items), n)), np.arange(n)
        for h, wanted in self.chunks:
            level = np.zeros((len(h), n), np.uint8)
            alive, held = np.arange(len(h)), np.full((len(h), rows.shape[1]), 255, np.uint8)
            for step in range(len(LEVELS)):
                at = positions(h[alive], np.full(len(alive), step), width)
                held = held & np.bitwise_and.reduce(rows[at], axis=1)
                some = held.any(axis=1)
                alive, held = alive[some], held[some]
                if not len(alive):
                    break
                level[alive] += np.unpackbits(held, axis=1, count=n, bitorder="little")
            value_of = value[level, column]
            for i, r, w in wanted:
                out[i] += w @ value_of[r]
        return out


def _blocks(batches):
    for batch in batches:
        for row in batch.select(["width", "ids", "lengths", "slices"]).to_pylist():
            yield row["width"], row["ids"], np.array(row["lengths"], np.int64), row["slices"]


_PAIR = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("bound", pa.float64())])
_PAIR_DDL = "item int, doc_id long, bound double"


def _highest(index: DataFrame, scorer: _Scorer, k: int) -> DataFrame:
    """Every task's ``k`` highest bounds of each item."""

    def run(batches):
        scorer.prepare()
        best, owner = np.zeros((len(scorer.items), k)), np.full((len(scorer.items), k), None, object)
        for width, ids, lengths, slices in _blocks(batches):
            bound = scorer.bounds(width, lengths, slices)
            names = np.array(ids, object)
            for i in np.flatnonzero(bound.max(axis=1) > best.min(axis=1)):
                every = np.concatenate((best[i], bound[i]))
                top = np.argsort(-every, kind="stable")[:k]
                owner[i] = np.concatenate((owner[i], names))[top]
                best[i] = every[top]
        item, at = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(owner[item, at].tolist(), pa.int64()), pa.array(best[item, at])], schema=_PAIR)

    return index.mapInArrow(run, _PAIR_DDL)


def _reaching(index: DataFrame, scorer: _Scorer, least: dict[int, tuple]) -> DataFrame:
    """Every (item, document) whose bound reaches the item's threshold (equal bounds: only ids up to the tenth's)."""
    floor = np.array([least.get(i, (0, None))[0] for i in range(len(scorer.items))], np.float64)
    last = np.array([least[i][1] if i in least and least[i][1] is not None else np.iinfo(np.int64).max for i in range(len(scorer.items))], np.int64)

    def run(batches):
        scorer.prepare()
        for width, ids, lengths, slices in _blocks(batches):
            bound = scorer.bounds(width, lengths, slices)
            number = np.array([-(2**63) if x is None else x for x in ids], np.int64)
            item, at = np.nonzero((bound > 0) & ((bound > floor[:, None]) | ((bound == floor[:, None]) & (number[None, :] <= last[:, None]))))
            if len(item):
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([ids[a] for a in at], pa.int64()), pa.array(bound[item, at])], schema=_PAIR)

    return index.mapInArrow(run, _PAIR_DDL)


_SCORED = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _score(docs: DataFrame, pairs: DataFrame, scorer: _Scorer) -> DataFrame:
    """Exact scores of the pairs, for every row that bears the document's id."""
    few = pairs.count() <= BROADCAST_PAIRS
    wanted = pairs.groupBy(F.col("doc_id").alias("wanted_id")).agg(F.collect_set("item").alias("items"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("doc_id", "text", "items")

    def run(batches):
        for part in text_parts(batches, "text", 1024):
            item, doc_id, score = [], [], []
            for d, text, items in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("items").to_pylist()):
                item += items
                doc_id += [d] * len(items)
                score += scorer.exact(text or "", items)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([scorer.ids[i] for i in item], pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], schema=_SCORED)

    return small_batches(both).mapInArrow(run, "item int, item_id long, doc_id long, score long").where("score > 0")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best rows of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / ITEMS), math.ceil(size / ITEM_BYTES))
    index, out = None, []
    for b in range(blocks):
        queries = sorted(((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()), key=lambda q: (q[0] is None, q[0] or 0, q[1]))
        vocabulary = sorted({t for _, text in queries for t in terms_of(text)})
        if not vocabulary:
            continue
        read = materialize(read_documents(docs, vocabulary, index is None), "lexical-index")
        index = read.where("slices IS NOT NULL") if index is None else index
        counts = read.where("slices IS NULL")
        documents, terms = counts.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        seen = [0] * len(vocabulary)
        for r in counts.select(F.posexplode("seen").alias("term", "df")).groupBy("term").agg(F.sum("df").alias("df")).collect():
            seen[r.term] = r.df
        scorer = _Scorer(queries, vocabulary, documents, terms, seen)
        by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
        seeds = _highest(index, scorer, k).withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= k)
        seeds = materialize(seeds.select("item", "doc_id").distinct(), "lexical-seeds")
        least = {r["item"]: (r.score, r.doc_id) for r in _ranked(_score(docs, seeds, scorer), k).where(F.col("rank") == k).collect()}
        pairs = materialize(_reaching(index, scorer, least).select("item", "doc_id").distinct(), "lexical-pairs")
        best = _ranked(_score(docs, pairs, scorer), k)
        out.append(materialize(best.select("item_id", "rank", "doc_id", "score"), "lexical-ranks") if blocks > 1 else best.select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.range(0).select(F.col("id").alias("item_id"), F.lit(0).alias("rank"), F.col("id").alias("doc_id"), F.col("id").alias("score"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
