"""Spelling variant grouping: PartEnum signatures of letter multisets, an equi-join on them, and exact verification.

Words are counted in tasks before they are shuffled, so a word that fills a third of the corpus sends one row a task.

Two words that differ by one inserted, deleted or replaced letter have letter multisets that, as binary vectors (one
dimension per letter and occurrence: the second ``e`` is its own), lie at a Hamming distance of at most two: exactly
one dimension for an insertion, none (the same letter) or two for a replacement.  PartEnum cuts the dimensions into ``n1``
parts; by the pigeonhole principle at least one part differs in at most ``k2 = floor(k / n1)`` dimensions, so if that part is cut
again into ``n2`` pieces, the vectors agree on all pieces but some ``k2``.  A signature is the vector's projection on the
kept pieces, one for each part and choice of pieces.  Words of equal length are joined with ``k = 2``, words whose lengths differ by
one with ``k = 1``; the length is a part of the signature.

Anagrams share every signature, so a signature's bucket is not paired off as it is.  The letter that differs stands in the
first, middle or last third of the (shorter) word, and words one letter apart agree on the letters of the two others; these
are joined on together with the signature, once for each third.  Each pair that meets is verified letter by letter; pairs
are counted once however often they meet.  No bucket is cut or capped.

A word has at most ``length * 89 + (length + 1) * 90`` near words whatever the corpus, so no word gathers unbounded rows.

Defined results: a null or empty text has no runs; a null ``doc_id`` counts as the empty string in the hashed text; rows that
repeat an id or a text are counted as often as they come; ties between near words go to the smaller one in code-point order;
very long texts and runs are taken whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import materialize, partitions, small_batches, text_parts

#: FIXED VALUES: shortest word, least count, one run in so many loses a letter, a form is so many times as frequent.
MIN_LETTERS, MIN_COUNT, DROP_ONE_IN, FORM_TIMES = 6, 5, 199, 5
#: Parts and pieces of a part for words of equal length (distance 2) and for lengths that differ by one (distance 1).
SAME_LENGTH, NEXT_LENGTH = (3, 1), (2, 1)
#: A task sends its counts on when it holds so many words.
TASK_WORDS = 1 << 18

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LETTERS)


def _words(doc_id, text: str) -> Counter:
    """Counts of the text's words, one letter dropped from the runs that the hash picks."""
    runs = Counter(_RUN.findall(text.encode("utf-8").lower().decode("utf-8")))  # bytes.lower knows A-Z only
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode("utf-8"), start)
        if h % DROP_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < MIN_LETTERS:
                continue
        out[run] += n
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words with at least ``MIN_COUNT`` occurrences."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for part in text_parts(batches, "text", 1024):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                if text:
                    counts.update(_words(doc_id, text))
                if len(counts) >= TASK_WORDS:
                    yield flush()
        yield flush()

    counted = small_batches(docs.select("doc_id", "text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _choices(parts: int, pieces: int, distance: int) -> list[tuple[int, ...]]:
    """The kept pieces of each signature: of one part, all but the pieces that may differ."""
    may_differ = distance // parts
    return [tuple(part * pieces + piece for piece in kept) for part in range(parts) for kept in itertools.combinations(range(pieces), pieces - may_differ)]


def signatures(word: Column, shape: tuple[int, int], distance: int) -> Column:
    """Array of the word's PartEnum signatures, one 64-bit hash for each part and choice of pieces."""
    parts, pieces = shape
    letters = F.array_sort(F.split(word, ""))
    # the i-th copy of a letter is its own dimension; a dimension lies in the same piece for every word
    dimensions = F.transform(letters, lambda c, i: F.struct(c.alias("c"), (i - F.array_position(letters, c)).alias("copy")))
    placed = F.transform(dimensions, lambda d: F.struct(F.pmod(F.xxhash64(d["c"], d["copy"]), F.lit(parts * pieces)).alias("piece"), F.concat(d["c"], d["copy"].cast("string")).alias("d")))

    def projection(kept: tuple[int, ...]) -> Column:
        return F.array_join(F.transform(F.filter(placed, lambda d: d["piece"].isin(*kept)), lambda d: d["d"]), "")

    return F.array(*[F.xxhash64(F.lit(i), projection(kept)) for i, kept in enumerate(_choices(parts, pieces, distance))])


def _keyed(words: DataFrame, shape: tuple[int, int], distance: int, base: Column) -> DataFrame:
    """A row for each signature and third; ``base`` is the length of the pair's shorter word."""
    rows = words.select("word", "n", base.cast("int").alias("base"), F.explode(signatures(F.col("word"), shape, distance)).alias("signature"))
    head, tail = "left(word, {})", "right(word, base - {})"
    one, two = "cast(floor(base / 3) as int)", "cast(floor(2 * base / 3) as int)"
    agreed = F.array(F.expr(tail.format(one)), F.concat(F.expr(head.format(one)), F.lit(" "), F.expr(tail.format(two))), F.expr(head.format(two)))
    rows = rows.select("word", "n", "base", "signature", F.posexplode(agreed).alias("third", "letters"))
    return rows.select("word", "n", F.xxhash64("base", "signature", "third", "letters").alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: all pairs of words (word, n) one letter apart, each once in either order."""
    length = F.char_length("word")
    same = _keyed(words, SAME_LENGTH, 2, length)
    short, long = _keyed(words, NEXT_LENGTH, 1, length), _keyed(words, NEXT_LENGTH, 1, length - 1)
    found = []
    for left, right, ordered in ((same, same, True), (short, long, False)):
        left = left.select("key", "word", "n")
        right = right.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
        met = left.join(right, "key").where((F.col("word") < F.col("other") if ordered else F.lit(True)) & (F.levenshtein("word", "other", 1) == 1))
        found.append(met.select("word", "n", "other", "other_n"))
    once = found[0].unionByName(found[1]).groupBy("word", "other").agg(F.first("n").alias("n"), F.first("other_n").alias("other_n"))
    pairs = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return once.select(pairs.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form of each word that has one, by doubling pointers (counts grow, so chains end)."""
    hops = materialize(forms.select("word", F.col("form").alias("root")), "spelling-hops")
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(hops.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-hops")
        hops = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return hops


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``docs`` (doc_id, text)."""
    words = materialize(count_words(docs), "spelling-words")
    # the largest n first, then the smaller word: the least of (-n, word)
    # each word becomes many keys, so the few files of the counted words are dealt out first
    near = near_pairs(words.repartition(partitions(docs.sparkSession), "word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus_n"), "other")).alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.minus_n")).alias("best_n"), F.col("best.other").alias("best"))
    follows = F.col("best_n") >= FORM_TIMES * F.col("n")
    judged = materialize(joined.select("word", "n", "n_near", F.when(follows, F.col("best")).alias("form"), F.when(follows, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
