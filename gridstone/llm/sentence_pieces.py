"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary (a public ``.model`` file) is read on the driver, laid out as a double-array trie and broadcast: its size
is that of the vocabulary and is checked.  Tasks cut a text into units that no piece can cross (a run of spaces with the
word behind it; characters that are in no piece), so the best path of a text is the best paths of its units one after
another.  Each distinct unit of a batch is solved once: short units together in numpy, a step of the trie for all of them
at a time, long ones alone.

Rules: a space becomes the marker U+2581 and one marker is put before a text that is not empty; the path with the
highest sum of scores wins, ties going to the longer last piece; a character that no piece covers costs the lowest score
less ``UNKNOWN_PENALTY`` and is written as its UTF-8 byte pieces.  A marker character that the text itself holds is
written in bytes too, so decoding gives back every text exactly.

Defined results: a null or empty text has no tokens; null ids and repeated rows stay rows of their own; very long texts
and words are encoded whole; extra columns are carried along, and those named ``ids`` or ``n_tokens`` are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gridstone.llm.common import small_batches, text_parts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: A vocabulary above this size is refused rather than broadcast.
MAX_MODEL_BYTES = 64 << 20
#: Units up to so many bytes are solved together; the cache of solved units is emptied when it has so many; the new units
#: of so many texts are solved at a time.
SHORT_UNIT, CACHE_UNITS, PART_ROWS = 48, 400_000, 1024
#: FIXED VALUES: kinds of pieces in a model file.
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of every piece of a SentencePiece model file, by id."""
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            score = struct.unpack("<f", got[2])[0] if 2 in got else 0.0
            pieces.append((got.get(1, b"").decode(), score, got.get(3, NORMAL)))
    return pieces


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of state s by byte b is t = base[s] + b + 1 if check[t] == s; value[t] is the id
    of the key that ends at t, or -1.  State 0 is the root."""
    tree: dict = {}
    for key, number in keys:
        node = tree
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = number
    base, check, value = [0], [-2], [-1]

    def grow(n: int) -> None:
        if n > len(base):
            more = max(n, 2 * len(base)) - len(base)
            base.extend([0] * more)
            check.extend([-1] * more)
            value.extend([-1] * more)

    grow(1024)
    first_free, todo = 1, [(0, tree)]
    while todo:
        state, node = todo.pop()
        value[state] = node.get(-1, -1)
        codes = sorted(b + 1 for b in node if b >= 0)
        if not codes:
            continue
        while first_free < len(check) and check[first_free] != -1:
            first_free += 1
        at, tries = first_free, 0
        while True:
            start = at - codes[0]
            grow(at + 258)
            if start >= 0 and check[at] == -1 and all(check[start + c] == -1 for c in codes):
                break
            at, tries = at + 1, tries + 1
        if tries > 64:  # the front is nearly full: look further on from now
            first_free = max(first_free, at - 512)
        base[state] = start
        for c in codes:
            check[start + c] = state
        todo.extend((start + c, node[c - 1]) for c in codes)
    size = max(i for i, c in enumerate(check) if c != -1) + 258
    grow(size)
    return np.array(base[:size], np.int32), np.array(check[:size], np.int32), np.array(value[:size], np.int32)


@dataclass
class Vocabulary:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    surface: list[bytes]
    units: str
    unknown_score: float
    longest: int

    @classmethod
    def from_pieces(cls, pieces: list[tuple[str, float, int]]) -> Vocabulary:
        matchable = [(p, i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED) and p]
        byte_ids = np.full(256, -1, np.int32)
        surface = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte_ids[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif kind in (NORMAL, USER, UNUSED):
                surface.append(piece.replace(MARK, " ").encode())
            else:
                surface.append(b"")
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p, _ in matchable):
            raise ValueError("a piece crosses a word boundary")
        # Inside the trie the marker is the byte of a space: texts are matched as they are.
        base, check, value = double_array([(p.replace(MARK, " ").encode(), i) for p, i in matchable])
        breaks = [c for c in "\n\t\r" if not any(c in p for p, _ in matchable)]
        stop = "".join(map(re.escape, breaks))
        units = rf"[{stop}]| +[^ {stop}]*|[^ {stop}]+" if stop else r" +[^ ]*|[^ ]+"
        scores = np.array([s for _, s, _ in pieces], np.float64)
        lowest = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0)
        longest = max((len(p.replace(MARK, " ").encode()) for p, _ in matchable), default=1)
        return cls(base, check, value, scores, byte_ids, surface, units, lowest - UNKNOWN_PENALTY, longest)

    # -- one long unit ------------------------------------------------------

    def solve_one(self, unit: bytes) -> np.ndarray:
        """Best path of one unit, a position at a time."""
        n = len(unit)
        best, start, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.base, self.check, self.value, self.scores
        for i in range(n):
            if best[i] == -np.inf:
                continue
            state, j = 0, i
            while j < n:
                t = base[state] + unit[j] + 1
                if check[t] != state:
                    break
                state, j = t, j + 1
                if value[t] >= 0:
                    score = best[i] + scores[value[t]]
                    if score > best[j]:
                        best[j], start[j], piece[j] = score, i, value[t]
            j = i + _char_bytes(unit[i])
            if best[i] + self.unknown_score > best[j]:
                best[j], start[j], piece[j] = best[i] + self.unknown_score, i, -1
        out, j = [], n
        while j > 0:
            i = start[j]
            out.extend([piece[j]] if piece[j] >= 0 else [int(x) for x in self.byte_ids[np.frombuffer(unit[i:j], np.uint8)][::-1]])
            j = i
        return np.array(out[::-1], np.int32)

    # -- many short units ---------------------------------------------------

    def solve(self, units: list[bytes]) -> list[bytes]:
        """Best paths (ids as int32 bytes) of many units."""
        out: list[bytes] = [b""] * len(units)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        short = order[: np.searchsorted(lengths[order], SHORT_UNIT, side="right")]
        for k in order[len(short) :]:
            out[k] = self.solve_one(units[k]).tobytes()
        for low, high in ((0, 8), (8, 12), (12, 20), (20, SHORT_UNIT)):
            own = short[(lengths[short] > low) & (lengths[short] <= high)]
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192]
                for k, ids in zip(part, self._solve_block([units[k] for k in part], lengths[part]), strict=True):
                    out[k] = ids
        return out

    def _solve_block(self, units: list[bytes], lengths: np.ndarray) -> list[bytes]:
        count, width = len(units), int(lengths.max())
        chars = np.zeros((width, count), np.int32)
        flat = np.frombuffer(b"".join(units), np.uint8)
        row = np.repeat(np.arange(count), lengths)
        ends = np.cumsum(lengths)
        column = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
        chars[column, row] = flat
        best = np.full((width + 5, count), -np.inf)
        best[0] = 0.0
        start = np.zeros((width + 5, count), np.int16)
        piece = np.full((width + 5, count), -1, np.int32)
        for i in range(width):
            live = np.nonzero((best[i] > -np.inf) & (lengths > i))[0]
            if not len(live):
                continue
            lead = chars[i, live]
            size = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            state, who, j = np.zeros(len(live), np.int32), live, i
            while len(who) and j < width:
                inside = lengths[who] > j
                who, state = who[inside], state[inside]
                t = self.base[state] + chars[j, who] + 1
                ok = self.check[t] == state
                who, state = who[ok], t[ok]
                j += 1
                found = self.value[state]
                hit = found >= 0
                if hit.any():
                    w, f = who[hit], found[hit]
                    score = best[i, w] + self.scores[f]
                    better = score > best[j, w]
                    w, f = w[better], f[better]
                    best[j, w], start[j, w], piece[j, w] = score[better], i, f
            score = best[i, live] + self.unknown_score
            better = score > best[i + size, live]
            w, to = live[better], (i + size)[better]
            best[to, w], start[to, w], piece[to, w] = score[better], i, -1
        # Walk all paths back together; a step is one piece, or all bytes of an unknown character.
        at, who = lengths.copy(), np.arange(count)
        tokens = np.full((count, width), -1, np.int32)
        used = np.full(count, width, np.int64)
        while len(who):
            j = at[who]
            i, p = start[j, who].astype(np.int64), piece[j, who]
            known = p >= 0
            used[who[known]] -= 1
            tokens[who[known], used[who[known]]] = p[known]
            for w, a, b in zip(who[~known], i[~known], j[~known], strict=True):
                used[w] -= b - a
                tokens[w, used[w] : used[w] + b - a] = self.byte_ids[chars[a:b, w]]
            at[who] = i
            who = who[i > 0]
        return [tokens[k, used[k] :].tobytes() for k in range(count)]

    # -- texts --------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of a sequence of ids: markers become spaces, byte pieces bytes; the marker put first goes."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == b" " else text


def _char_bytes(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Encoder:
    """Encodes batches of texts in a task, keeping solved units while memory allows."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.cache, self.find = vocabulary, {}, re.compile(vocabulary.units).findall

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each).  The new units of all these texts are solved together."""
        units = [self.find(" " + t) if t else [] for t in texts]
        missing = set().union(*units) - self.cache.keys()
        if missing:
            self._learn(missing)
        got = [b"".join(map(self.cache.__getitem__, u)) for u in units]
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        return np.frombuffer(b"".join(got), np.int32), np.array([len(g) // 4 for g in got], np.int64)

    def _learn(self, units: set[str]) -> None:
        """A marker character of the text itself is cut out of its unit and written as bytes."""
        plain = [u for u in units if MARK not in u]
        for u, ids in zip(plain, self.v.solve([u.encode() for u in plain]), strict=True):
            self.cache[u] = ids
        mark = self.v.byte_ids[np.frombuffer(MARK.encode(), np.uint8)].tobytes()
        for u in units:
            if MARK in u:
                parts = u.split(MARK)
                self.cache[u] = mark.join(self.v.solve([p.encode() for p in parts]))


def load(spark: SparkSession, path: str = MODEL):
    """Broadcast vocabulary; the driver alone reads the file."""
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"the model file is larger than {MAX_MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(Vocabulary.from_pieces(read_model(data)))


def encode(docs: DataFrame, path: str = MODEL, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``n_tokens`` of each whole text."""
    docs = docs.drop("ids", "n_tokens")
    shared = load(docs.sparkSession, path)

    def run(batches):
        encoder = Encoder(shared.value)
        for part in text_parts(batches, text, PART_ROWS):
            ids, counts = encoder.encode(part.column(text).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(counts.astype(np.int32))],
                names=[*part.schema.names, "ids", "n_tokens"])

    made = [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", IntegerType())]
    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, *made]))


def decode(tokens: DataFrame, path: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with ``out``, the text of each sequence of ids (null for null)."""
    tokens = tokens.drop(out)
    shared = load(tokens.sparkSession, path)

    def run(batches):
        v = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x is None else v.decode(np.array(x, np.int32)).decode("utf-8", "replace") for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField(out, StringType())]))


def tokenize(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, n_byte_tokens, ids, round_trip`` per row of ``docs`` (doc_id, text): its tokens, and whether
    decoding them gave the text back."""
    shared = load(docs.sparkSession, path)

    def run(batches):
        encoder = Encoder(shared.value)
        is_byte = np.zeros(len(shared.value.scores), bool)
        is_byte[shared.value.byte_ids] = True
        for part in text_parts(batches, "text", PART_ROWS):
            texts = part.column("text").to_pylist()
            ids, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            bytes_seen = np.concatenate([[0], np.cumsum(is_byte[ids])])
            same = [shared.value.decode(ids[e - n : e]) == (t or "").encode() for t, e, n in zip(texts, ends, counts, strict=True)]
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts.astype(np.int32)), pa.array((bytes_seen[ends] - bytes_seen[ends - counts]).astype(np.int32)),
                 pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(same)],
                names=["doc_id", "n_tokens", "n_byte_tokens", "ids", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_tokens int, n_byte_tokens int, ids array<int>, round_trip boolean")
