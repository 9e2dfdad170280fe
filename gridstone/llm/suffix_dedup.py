"""Exact substring removal by a depth-limited radix sort of suffixes.

Two suffixes matter to each other only if they agree for ``WIDTH`` bytes, so they are ordered by most-significant-digit
passes that stop at that depth; groups that are still equal there are exactly the repeated windows.  Suffixes that lie
close together travel as one row until a pass tells them apart:

1. First digit: the 32-byte string with the least hash inside the suffix's first ``WIDTH`` bytes.  It depends on those
   bytes alone, so equal windows have it at the same place, and a run of neighbouring suffixes shares one: a row holds
   the digit, the run and a hash of all bytes the run's windows cover.  Rows are sorted by (digit, covered bytes, place).
   A digit that occurs once holds no repeat and ends here.  Of rows with the same covered bytes, all but the earliest are
   removed whole; the earliest goes on only if the digit has other covered bytes too.
2. Last digit: the remaining rows get their covered bytes, and within a digit all windows at the same distance from it are
   ordered by their ``WIDTH`` bytes.  All but the earliest of an equal group are removed.  A digit with more than
   ``GROUP_ROWS`` rows is not ordered in one task: its rows are dealt out by a salt and their windows become rows of
   their own, which are grouped across the cluster.
3. The removed windows of a document are merged into spans and cut out of its text.

Earlier means a smaller document id, or the same document and an earlier start.  Copies inside one block of texts are
settled before the first shuffle, so a frequent passage sends few rows.  Tables between passes are written, and texts move
twice: to the rows of pass 2 and to the spans.

Bytes are compared by 64-bit hashes (two of them in pass 1, digit and window in pass 2).

Defined results: a null text is empty; a null id comes before all others; rows that share an id are one document each,
ordered by a hash of their texts; rows that are equal in id and text get the same result; texts shorter than ``WIDTH``
lose nothing; an empty table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import RangeHash, materialize, partitions, small_batches, text_parts

WIDTH, DIGIT = 100, 32
#: Bytes hashed at a time; longer texts are taken in pieces that overlap by a window.
BLOCK = 1 << 20
GROUP_ROWS, SALTS = 4096, 256
NULL_ID = -(2**63)
ROW = "h long, k long, id long, tie long, at long, run int, lead int"
PASS_ONE = "kind int, h long, id long, tie long, at long, until long, lead int"
SPAN = "id long, tie long, at long, until long"
WINDOWS = "h long, w long, id long, tie long, at long, until long"
_PLACE_BITS, _TEXT_BITS = 22, 40


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value (the leftmost of equals) in each window of ``width`` values."""
    n = len(values)
    packed = (values >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    rest = width - size
    if rest:
        packed = np.minimum(packed[: len(packed) - rest], packed[rest:])
    return (packed & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def runs_of_block(buf: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one first digit, in a buffer of texts that end at ``limits``.

    Returns text number, first window start, number of windows, digit start less first start, digit hash, hash of the
    covered bytes.
    """
    if len(buf) < WIDTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = RangeHash(buf)
    digit = hashes.fixed(DIGIT)
    place = _least_in_window(digit, WIDTH - DIGIT + 1)
    whole = np.ones(len(place) + 1, bool)
    for limit in limits[:-1]:  # windows that would cross into the next text
        whole[max(0, limit - WIDTH + 1) : limit] = False
    start = np.nonzero(whole[: len(place)])[0]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    anchor = place[start]
    text = np.searchsorted(limits, start, side="right")
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(start)]]) - 1
    p, q, a = start[first], start[last], anchor[first]
    # The covered bytes and where the digit stands in them.
    lead = a - p
    cover = hashes.ranges(p, q + WIDTH) ^ (lead.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return text[first], p, q - p + 1, lead, digit[a], cover


def _blocks(batches, text: str):
    """(bytes, ends, id, tie, offset) of about BLOCK bytes of text: whole texts, or one piece of a long one."""
    ids, ties, offsets, parts, size = [], [], [], [], 0
    for batch in batches:
        for i, tie, t in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", text)), strict=True):
            data = (t or "").encode()
            for at in range(0, max(1, len(data)), BLOCK):
                piece = data[at : at + BLOCK + WIDTH - 1]
                if at and len(piece) < WIDTH:
                    continue
                if parts and size + len(piece) > BLOCK + WIDTH:
                    yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts]), np.array(ids), np.array(ties), np.array(offsets)
                    ids, ties, offsets, parts, size = [], [], [], [], 0
                ids.append(i)
                ties.append(tie)
                offsets.append(at)
                parts.append(piece)
                size += len(piece)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts]), np.array(ids), np.array(ties), np.array(offsets)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as sorted maximal runs."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([new[1:], [True]])]


def first_digits(docs: DataFrame) -> DataFrame:
    """ROW per run of windows.  Runs settled inside a block come as spans: lead -1, k the span's end."""

    def run(batches):
        for buf, limits, ids, ties, offsets in _blocks(batches, "text"):
            text, p, n, lead, h, k = runs_of_block(buf, limits)
            starts = np.concatenate([[0], limits[:-1]])
            local = p - starts[text] + offsets[text]
            order = np.lexsort((local, ties[text], ids[text], k, h))
            text, local, n, lead, h, k = (x[order] for x in (text, local, n, lead, h, k))
            later = np.zeros(len(h), bool)
            later[1:] = (h[1:] == h[:-1]) & (k[1:] == k[:-1])
            out = [h[~later], k[~later], ids[text[~later]], ties[text[~later]], local[~later], n[~later], lead[~later]]
            far = text[later] << _TEXT_BITS  # spans of different texts are kept apart by their distance
            begin, end = merge(far + local[later], far + local[later] + n[later] - 1 + WIDTH)
            t, one = begin >> _TEXT_BITS, np.ones(len(begin), np.int64)
            begin, end = begin - (t << _TEXT_BITS), end - (t << _TEXT_BITS)
            spans = (begin.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), end.astype(np.uint64), ids[t], ties[t], begin, one, -one)
            out = [np.concatenate(x) for x in zip(out, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [_signed(out[0]), _signed(out[1]), pa.array(out[2].astype(np.int64)), pa.array(out[3].astype(np.int64)), pa.array(out[4].astype(np.int64)),
                 pa.array(out[5].astype(np.int32)), pa.array(out[6].astype(np.int32))], names=["h", "k", "id", "tie", "at", "run", "lead"])

    return small_batches(docs).mapInArrow(run, ROW)


def settle_digits(rows: DataFrame) -> DataFrame:
    """Pass 1: spans to remove (kind 0) and the runs that go on (kind 1; ``until`` is the number of windows).

    Rows come sorted by digit, cover and place and are read as a stream: what is carried from one batch to the next is
    one row, however many rows a digit has.
    """

    def run(batches):
        names = ["h", "k", "id", "tie", "at", "run", "lead"]
        before, held, held_goes = None, None, False  # last row seen; last first-of-its-cover and whether it goes on
        for batch in batches:
            h, k, i, tie, at, n, lead = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            if not len(h):
                continue
            done = lead < 0
            spans = [i[done], tie[done], at[done], k[done]]
            h, k, i, tie, at, n, lead = (x[~done] for x in (h, k, i, tie, at, n, lead))
            go = [np.zeros(0, np.int64)] * 6
            if len(h):
                same = np.zeros(len(h), bool)
                same[1:] = (h[1:] == h[:-1]) & (k[1:] == k[:-1])
                same[0] = before is not None and before == (h[0], k[0])
                before = (h[-1], k[-1])
                spans = [np.concatenate(x) for x in zip(spans, (i[same], tie[same], at[same], at[same] + n[same] - 1 + WIDTH), strict=True)]
                f = [x[~same].astype(np.int64) for x in (h, i, tie, at, n, lead)]
                if held is not None:
                    f = [np.concatenate([[a], b]) for a, b in zip(held, f, strict=True)]
                if len(f[0]):
                    others = np.zeros(len(f[0]), bool)
                    equal = f[0][1:] == f[0][:-1]
                    others[1:] |= equal
                    others[:-1] |= equal
                    others[0] |= held_goes
                    go = [x[:-1][others[:-1]] for x in f]
                    held, held_goes = [x[-1] for x in f], bool(others[-1])
            yield _pass_one(spans, go)
        if held is not None and held_goes:
            yield _pass_one([np.zeros(0, np.int64)] * 4, [np.array([x]) for x in held])

    return rows.mapInArrow(run, PASS_ONE)


def _pass_one(spans, go) -> pa.RecordBatch:
    i, tie, at, until = spans
    h, gi, gtie, gat, gn, glead = go
    columns = [np.concatenate([np.zeros(len(i)), np.ones(len(h))]).astype(np.int32), np.concatenate([np.zeros(len(i), np.int64), h]), np.concatenate([i, gi]), np.concatenate([tie, gtie]), np.concatenate([at, gat]), np.concatenate([until, gn]), np.concatenate([np.zeros(len(i)), glead]).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) if x.dtype == np.int32 else pa.array(x.astype(np.int64)) for x in columns], names=[c.split()[0] for c in PASS_ONE.split(", ")])


def covered_bytes(going: DataFrame, docs: DataFrame) -> DataFrame:
    """h, id, tie, at, lead, salt, cover (the bytes of a run's windows) of the runs that go on; salt is -1 unless the
    digit is frequent."""
    counts = going.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS)
    salt = F.when(F.col("n").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int"))
    salted = going.join(counts, "h", "left").withColumn("salt", salt)
    lists = salted.groupBy("id", "tie").agg(F.collect_list(F.struct("h", "at", F.col("until").cast("int").alias("run"), "lead", "salt")).alias("runs"))
    joined = docs.join(lists, ["id", "tie"])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data = (batch.column("text")[row].as_py() or "").encode()
                runs = batch.column("runs")[row].values
                h, at, n, lead, salt = (runs.field(c) for c in ("h", "at", "run", "lead", "salt"))
                cover = [data[a : a + m - 1 + WIDTH] for a, m in zip(at.to_pylist(), n.to_pylist(), strict=True)]
                same = [pa.array([batch.column(c)[row].as_py()] * len(h), pa.int64()) for c in ("id", "tie")]
                yield pa.RecordBatch.from_arrays([h, *same, at, lead, salt, pa.array(cover, pa.binary())], names=["h", "id", "tie", "at", "lead", "salt", "cover"])

    return joined.mapInArrow(run, "h long, id long, tie long, at long, lead int, salt int, cover binary")


def _windows(h, i, tie, at, lead, cover):
    """All windows of the rows: digit, key of (bytes, distance to the digit), id, tie, start."""
    sizes = np.fromiter(map(len, cover), np.int64, len(cover))
    ends = np.cumsum(sizes)
    begin = ends - sizes
    count = sizes - WIDTH + 1
    row = np.repeat(np.arange(len(sizes)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    where = begin[row] + step
    hashes = RangeHash(np.frombuffer(b"".join(cover), np.uint8))
    key = hashes.ranges(where, where + WIDTH) ^ ((lead[row] - step).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h[row], key.view(np.int64), i[row], tie[row], at[row] + step


def last_digits(rows: DataFrame) -> DataFrame:
    """Pass 2 over rows sorted by digit: spans to remove (w 0, ``until`` set), and the windows of frequent digits
    (``until`` 0).  A task holds the rows of one batch and of one digit that is not frequent."""

    def resolve(group):
        h, key, i, tie, p = _windows(*group)
        order = np.lexsort((p, tie, i, key, h))
        h, key, i, tie, p = (x[order] for x in (h, key, i, tie, p))
        later = np.zeros(len(h), bool)
        later[1:] = (h[1:] == h[:-1]) & (key[1:] == key[:-1])
        i, tie, p = i[later], tie[later], p[later]
        order = np.lexsort((p, tie, i))
        i, tie, p = i[order], tie[order], p[order]
        new = np.concatenate([[True], (i[1:] != i[:-1]) | (tie[1:] != tie[:-1]) | (p[1:] > p[:-1] + WIDTH)]) if len(p) else np.zeros(0, bool)
        end = np.concatenate([new[1:], [True]]) if len(p) else new
        zero = np.zeros(int(new.sum()), np.int64)
        return [zero, zero, i[new], tie[new], p[new], p[end] + WIDTH]

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=[c.split()[0] for c in WINDOWS.split(", ")])

    def arrays(rows):
        return [np.array(x, np.int64) if n < 5 else x for n, x in enumerate(rows)]

    def run(batches):
        held: list[list] = [[] for _ in range(6)]
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                frequent = part.column("salt").to_numpy(zero_copy_only=False) >= 0
                if frequent.any():
                    own = part.filter(pa.array(frequent))
                    h, key, i, tie, p = _windows(*arrays([own.column(c).to_pylist() for c in ("h", "id", "tie", "at", "lead", "cover")]))
                    yield batch_of([h, key, i, tie, p, np.zeros(len(h), np.int64)])
                part = part.filter(pa.array(~frequent))
                for n, c in enumerate(("h", "id", "tie", "at", "lead", "cover")):
                    held[n].extend(part.column(c).to_pylist())
                if held[0] and held[0][0] != held[0][-1]:  # all digits but the last are whole
                    cut = held[0].index(held[0][-1])
                    yield batch_of(resolve(arrays([x[:cut] for x in held])))
                    held = [x[cut:] for x in held]
        if held[0]:
            yield batch_of(resolve(arrays(held)))

    return rows.mapInArrow(run, WINDOWS)


def _frequent(windows: DataFrame) -> DataFrame:
    """Spans of the windows of frequent digits that an earlier equal window precedes."""
    order = F.struct("id", "tie", "at")
    least = windows.groupBy("h", "w").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(materialize(least, "suffix-least"), ["h", "w"]).where(order > F.col("least"))
    return later.select("id", "tie", "at", (F.col("at") + WIDTH).alias("until"))


def keyed(docs: DataFrame) -> DataFrame:
    """id, tie, text: ids without nulls; the tie is 0 unless ids repeat, which is looked up in the ids alone."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text")
    repeated = not ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return ids.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))) if repeated else F.lit(0).cast("long")).select("id", "tie", "text"), repeated


def removed_spans(rows: DataFrame) -> DataFrame:
    """SPAN rows of ``rows`` (id, tie, text): bytes covered by a window that also starts earlier; spans may overlap."""
    n = partitions(rows.sparkSession)
    sorted_rows = first_digits(rows).repartition(n, "h").sortWithinPartitions("h", "k", "id", "tie", "at")
    one = materialize(settle_digits(sorted_rows), "suffix-digits")
    going = one.where("kind = 1")
    covers = covered_bytes(going, rows).repartition(n, "h", "salt").sortWithinPartitions("h", "salt", "id", "tie", "at")
    two = materialize(last_digits(covers), "suffix-windows")
    frequent = _frequent(two.where("until = 0").select("h", "w", "id", "tie", "at"))
    spans = [x.select("id", "tie", "at", "until") for x in (one.where("kind = 0"), two.where("until > 0"), frequent)]
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans (start, end), kept`` per row of ``docs`` (doc_id, text); ``kept`` are the bytes that stay."""
    rows, repeated = keyed(docs)
    spans = removed_spans(rows.dropDuplicates(["id", "tie"]) if repeated else rows)
    lists = spans.groupBy("id", "tie").agg(F.collect_list(F.struct(F.col("at").alias("start"), F.col("until").alias("end"))).alias("spans"))
    joined = rows.join(lists, ["id", "tie"], "left").select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "text", "spans")

    def run(batches):
        for part in text_parts(batches, "text", 256):
            sizes, starts, ends, offsets, kept = [], [], [], [0], []
            found = part.column("spans")
            for row, text in enumerate(part.column("text").to_pylist()):
                data = (text or "").encode()
                sizes.append(len(data))
                cut = found[row].values
                if cut is None:
                    kept.append(data)
                else:
                    s, e = merge(*(cut.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end")))
                    starts.append(s)
                    ends.append(e)
                    edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                offsets.append(offsets[-1] + (0 if cut is None else len(starts[-1])))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (starts, ends)]
            struct = pa.StructArray.from_arrays(flat, names=["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """Counts and the digest of the kept bytes, from the spans and bytes of ``remove_repeats``."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
