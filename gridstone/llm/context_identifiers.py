"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they do not know.

One pass over the texts finds the base spans (emails, addresses, card and phone numbers) and the slots: base spans and
other identifier-like tokens (``SLOT_DIGITS`` digits or more, or an ``@`` between letters) with the lexical patterns they stand
in: the two words before, a field word before (``phone:``), the words before and behind.

Patterns and instances (distinct slot values) form a graph, scored in rounds of Spark aggregations.  Seeds, the base
spans, score one.  A pattern's confidence for a kind is the score sum of its instances over one more than their number,
so every unknown filler counts against it; with ``MIN_SUPPORT`` and ``MIN_CONFIDENCE`` it is trusted.  An unknown instance scores the
noisy-or of its trusted patterns' confidences; from ``ACCEPT`` on it is accepted and supports further patterns in the next round.
After ``ROUNDS`` rounds accepted instances are reported where they stand in a trusted pattern of their kind, as kinds
``context_email`` and so on.  Sums are of whole millionths, so they do not depend on row order.

Patterns that fewer than ``MIN_SUPPORT`` instances fill cannot be trusted in any round and leave the graph first.  Edges are
distinct, so a filler or line that fills a third of the corpus is one edge; scores are broadcast behind a check of their
number and joined by shuffles beyond it.

Base spans are found in time linear in the text, whatever it holds: runs are consumed once.

Defined results: a null text is the empty text; null ids are rows of their own; rows that repeat an id and a text come
back as often as they came with the same spans; ties between kinds go to the first listed; very long texts are taken
whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import WORD, materialize, small_batches, text_parts

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = KINDS + tuple("context_" + k for k in KINDS)
SLOT_DIGITS, SLOT_CHARS = 5, 64
MIN_SUPPORT, MIN_CONFIDENCE, ACCEPT, ROUNDS = 3, 0.6, 0.75, 3
#: Scores and spans of up to so many rows (some 30 MB) are broadcast.
BROADCAST_ROWS = 1 << 17
#: Code points before and behind a slot in which its context words are looked for.
BEFORE, BEHIND = 80, 40
ONE = 1000000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGIT_RUN = re.compile("[0-9]++")
_MARK = re.compile("[0-9@]")
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_@.+/-")
_TOKEN_REST = re.compile(r"[A-Za-z0-9_@.+/-]*+")
_AT_WORD = re.compile("[A-Za-z0-9]@[A-Za-z0-9]")
_NUMBER = re.compile("[0-9]+")
_WORD = re.compile(WORD)


def _emails(text: str):
    """Leftmost matches: a match's local part is the run that ends at its ``@``, so one step for each ``@`` is enough."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _addresses(text: str):
    """Numbers joined by dots, four at a time."""
    for chain in _DOTTED.finditer(text):
        numbers = [m.span() for m in _DIGIT_RUN.finditer(text, chain.start(), chain.end())]
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            if all(int(text[s:e].lstrip("0")[:4] or "0") <= 255 for s, e in four):
                yield four[0][0], four[3][1]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, s, e) for s, e in _addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def _other_slots(text: str, taken: list[tuple[int, int]]):
    """Identifier-like tokens that touch no base span."""
    taken, near, done, reach = sorted(taken), 0, 0, 0
    for mark in _MARK.finditer(text):
        if mark.start() < done:
            continue
        start, end = mark.start(), _TOKEN_REST.match(text, mark.start()).end()
        while start > done and text[start - 1] in _TOKEN_CHARS:
            start -= 1
        done = end
        value = text[start:end].rstrip(".-/+")
        token = value.lstrip(".-/")
        start, end = start + len(value) - len(token), start + len(value)
        like = len(_DIGIT.findall(token)) >= SLOT_DIGITS or _AT_WORD.search(token)
        while near < len(taken) and taken[near][0] < end:
            reach = max(reach, taken[near][1])
            near += 1
        if like and len(token) <= SLOT_CHARS and reach <= start:
            yield start, end


def _shape(word: str) -> str:
    return _NUMBER.sub("0", word.encode("utf-8").lower().decode("utf-8"))


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns that a slot stands in."""
    before = [_shape(w) for w in _WORD.findall(text, max(0, start - BEFORE), start)[-2:]]
    behind = [_shape(w) for w in _WORD.findall(text, end, end + BEHIND)[:1]]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and before[-1][-1] in ":=#":
        out.append(f"{before[-1]} _")
    if before and behind:
        out.append(f"{before[-1]} _ {behind[0]}")
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SLOT = pa.list_(pa.struct([("instance", pa.string()), ("seed", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string()))]))
_FOUND = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("base", _SPAN), ("slots", _SLOT)])
_SPAN_DDL = "array<struct<kind:int,start:int,end:int>>"
_FOUND_DDL = f"doc_id long, digest string, base {_SPAN_DDL}, slots array<struct<instance:string,seed:int,start:int,end:int,patterns:array<string>>>"


def find_slots(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` (of the text), base spans and slots of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for part in text_parts(batches, "text", 1024):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                text = text or ""
                base, slots = base_spans(text), []
                if base or _DIGIT.search(text) or "@" in text:
                    places = base + [(-1, s, e) for s, e in _other_slots(text, [(s, e) for _, s, e in base])]
                    slots = [dict(instance=_value(text[s:e]), seed=k, start=s, end=e, patterns=patterns_of(text, s, e)) for k, s, e in places]
                rows.append(dict(doc_id=doc_id, digest=hashlib.md5(text.encode("utf-8")).hexdigest() if slots else "",
                                 base=[dict(kind=k, start=s, end=e) for k, s, e in base], slots=slots))
            yield pa.RecordBatch.from_pylist(rows, _FOUND)

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, _FOUND_DDL)


def _value(text: str) -> str:
    return text.encode("utf-8").lower().decode("utf-8")


def _few(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcasting if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _graph(found: DataFrame) -> DataFrame:
    """Distinct edges ``pattern, instance, seed`` of all patterns with ``MIN_SUPPORT`` instances or more."""
    edges = found.select(F.explode("slots").alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.instance", "s.seed")
    edges = materialize(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "context-edges")
    filled = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("fillers")).where(F.col("fillers") >= MIN_SUPPORT)
    return materialize(edges.join(_few(materialize(filled, "context-fillers")), "pattern"), "context-graph")


def _trusted(graph: DataFrame, accepted: DataFrame) -> DataFrame:
    """``pattern, kind, confidence`` (millionths) of the patterns that the instances' scores support."""
    scored = graph.join(_few(accepted), "instance", "left").select(
        "pattern", "fillers", F.when(F.col("seed") >= 0, F.col("seed")).otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("seed") >= 0, F.lit(ONE)).otherwise(F.col("score")).alias("score"))
    by_kind = scored.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.sum("score").alias("support"), F.first("fillers").alias("fillers"))
    sure = by_kind.select("pattern", "kind", "support", F.expr("support div (fillers + 1)").alias("confidence")).where(
        (F.col("support") >= MIN_SUPPORT * ONE) & (F.col("confidence") >= int(MIN_CONFIDENCE * ONE)))
    # a confidence over one half leaves room for one kind
    return sure.select("pattern", "kind", "confidence")


def _accepted(graph: DataFrame, trusted: DataFrame) -> DataFrame:
    """``instance, kind, score`` (millionths) of the unknown instances that trusted patterns vouch for."""
    doubt = F.round(-F.log(1 - F.col("confidence") / ONE) * ONE).cast("long")
    votes = graph.where("seed < 0").join(_few(trusted), "pattern").groupBy("instance", "kind").agg(F.sum(doubt).alias("doubt"))
    best = votes.where(F.col("doubt") >= round(-math.log(1 - ACCEPT) * ONE)).groupBy("instance").agg(F.max(F.struct("doubt", (-F.col("kind")).alias("minus_kind"))).alias("b"))
    return best.select("instance", (-F.col("b.minus_kind")).alias("kind"), F.round((1 - F.exp(-F.col("b.doubt") / ONE)) * ONE).cast("long").alias("score"))


def bootstrap(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns and accepted instances after ``ROUNDS`` rounds (fewer if there is nothing to accept: then no round would change a score)."""
    accepted = graph.select("instance", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("score")).limit(0)
    for _ in range(ROUNDS):
        trusted = materialize(_trusted(graph, accepted), "context-patterns")
        accepted = materialize(_accepted(graph, trusted), "context-instances")
        if accepted.isEmpty():
            break
    return trusted, accepted


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, found``: base spans and spans found by context, as arrays of (kind, start, end) by kind and start."""
    slots = materialize(find_slots(docs), "context-slots")
    trusted, accepted = bootstrap(_graph(slots))
    each = slots.select("doc_id", "digest", F.explode("slots").alias("s")).where("s.seed < 0")
    each = each.select("doc_id", "digest", "s.instance", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    hits = each.join(_few(accepted.select("instance", "kind")), "instance").join(_few(trusted.select("pattern", "kind")), ["pattern", "kind"])
    span = F.struct((F.col("kind") + len(KINDS)).cast("int").alias("kind"), "start", "end")
    per_text = materialize(hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).agg(F.array_sort(F.collect_set(span)).alias("found")), "context-hits")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))
    return slots.join(_few(per_text), same, "left").select("doc_id", "base", F.coalesce("found", F.array().cast(_SPAN_DDL)).alias("found"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The result of ``find`` in one row of counts and strings per document."""
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_context"))
