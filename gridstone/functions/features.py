"""Query feature expressions (F1, F2, F6, F7): native column expressions; whole tables of texts are counted by one Arrow
function (``byte_counts``), a single query by ``surface_counts``.

Character classes are written out explicitly so Spark (Java regex) and the
DuckDB oracle (RE2) agree: digits are ASCII ``0-9`` and whitespace is the set
Python's ``str.split()`` splits on.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.config import MATH_SYMBOLS, PROBE_CODE_MARKERS, PUNCTUATION, SURFACE_CODE_MARKERS

# Whitespace characters of Python's str.split(), as literal characters.
WS_CHARS = "".join(
    chr(c) for c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                     0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
WS = "[" + WS_CHARS + "]"
NON_WS = "[^" + WS_CHARS + "]"
#: The same characters as ``WS`` for Java: those up to U+00FF are one table look-up, and those above are looked at only in the
#: range that holds them, so a character that is no white space costs two tests in place of one for each member.
FAST_WS = "[" + "".join(c for c in WS_CHARS if c <= "\u00ff") + "[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
DIGITS = "0123456789"


def count_chars(col: Column, chars: str) -> Column:
    """Number of characters of ``col`` that belong to ``chars``: all others are cut out in whole runs."""
    cls = "".join("\\" + c for c in chars if c in "\\]^-[&") + "".join(c for c in chars if c not in "\\]^-[&")
    return F.length(F.regexp_replace(col, "[^" + cls + "]+", ""))


def words(col: Column) -> Column:
    """Maximal runs of characters other than white space."""
    return F.array_remove(F.split(col, FAST_WS + "+", -1), "")


def marker_count(low: Column, markers: tuple[str, ...]) -> Column:
    """Number of ``markers`` in the lower-cased text ``low``: bytes are compared, no character's place is counted."""
    total = F.lit(0)
    for m in markers:
        total = total + F.contains(low, F.lit(m)).cast("int")
    return total


def surface_counts(query_col: str = "query", words_col: str | None = None, low_col: str | None = None) -> dict[str, Column]:
    """Counts over the whole text.  ``words_col`` and ``low_col`` name staged columns with its words and its lower-cased
    form, which are then made once."""
    q = F.coalesce(F.col(query_col).cast("string"), F.lit(""))
    w = F.col(words_col) if words_col else words(q)
    low = F.col(low_col) if low_col else F.lower(q)
    return {
        "char_count": F.length(q),
        "word_count": F.size(w),
        "digit_count": count_chars(q, DIGITS),
        "math_symbol_count": count_chars(q, MATH_SYMBOLS),
        "punctuation_count": count_chars(q, PUNCTUATION),
        "code_marker_count": marker_count(low, SURFACE_CODE_MARKERS),
        "probe_code_markers": marker_count(low, PROBE_CODE_MARKERS),
        "non_ws_chars": F.length(F.array_join(w, "")),
    }


SURFACE_COLUMNS = [
    "char_count", "word_count", "digit_count", "digit_density", "math_symbol_count",
    "punctuation_count", "code_marker_count", "avg_word_length",
]
PROBE_COLUMNS = ["cheap_probe_difficulty", "cheap_probe_confidence", "cheap_probe_consistency"]


def surface_feature_columns(query_col: str = "query") -> list[Column]:
    c = surface_counts(query_col)
    return [
        c["char_count"].cast("double").alias("char_count"),
        c["word_count"].cast("double").alias("word_count"),
        c["digit_count"].cast("double").alias("digit_count"),
        (c["digit_count"] / F.greatest(c["char_count"], F.lit(1))).alias("digit_density"),
        c["math_symbol_count"].cast("double").alias("math_symbol_count"),
        c["punctuation_count"].cast("double").alias("punctuation_count"),
        c["code_marker_count"].cast("double").alias("code_marker_count"),
        (c["non_ws_chars"] / F.greatest(c["word_count"], F.lit(1))).alias("avg_word_length"),
    ]


def probe_feature_columns(query_col: str = "query") -> list[Column]:
    c = surface_counts(query_col)
    wc, dc, cm, mm = c["word_count"], c["digit_count"], c["probe_code_markers"], c["math_symbol_count"]
    diff = F.least(F.lit(1.0), wc / 80.0 + dc / 20.0 + cm / 2.0 + mm / 10.0)
    return [
        diff.alias("cheap_probe_difficulty"),
        F.greatest(F.lit(0.05), 1.0 - diff * 0.75).alias("cheap_probe_confidence"),
        F.greatest(F.lit(0.0), 1.0 - F.abs(dc - mm) / F.greatest(wc, F.lit(1))).alias("cheap_probe_consistency"),
    ]


def with_surface_features(df: DataFrame, query_col: str = "query") -> DataFrame:
    """F1."""
    return df.select(*[c for c in df.columns if c not in SURFACE_COLUMNS], *surface_feature_columns(query_col))


def with_probe_features(df: DataFrame, query_col: str = "query") -> DataFrame:
    """F2."""
    return df.select(*[c for c in df.columns if c not in PROBE_COLUMNS], *probe_feature_columns(query_col))


def heuristic_difficulty(query_col: str = "query", task_col: str = "task_type", counts: dict[str, Column] | None = None) -> Column:
    """hard if code task, >=2 code markers or >120 words; medium if math, >=8 digits,
    >=4 math symbols or >55 words; else easy."""
    c = counts or surface_counts(query_col)
    t = F.col(task_col)
    return (
        F.when((t == "humaneval") | (c["code_marker_count"] >= 2) | (c["word_count"] > 120), "hard")
        .when((t == "math") | (c["digit_count"] >= 8) | (c["math_symbol_count"] >= 4) | (c["word_count"] > 55), "medium")
        .otherwise("easy")
    )


def difficulty_band(score: Column) -> Column:
    """<.35 easy, <.7 medium, else hard."""
    return F.when(score < 0.35, "easy").when(score < 0.7, "medium").otherwise("hard")


COUNT_COLUMNS = ["char_count", "word_count", "digit_count", "math_symbol_count", "punctuation_count", "code_marker_count",
                 "probe_code_markers", "non_ws_chars"]


def features_from_counts() -> list[Column]:
    """Surface + probe features from staged ``_n_*`` count columns (each text scanned once per count)."""
    c = {k: F.col("_n_" + k) for k in COUNT_COLUMNS}
    wc, dc, cm, mm = c["word_count"], c["digit_count"], c["probe_code_markers"], c["math_symbol_count"]
    diff = F.least(F.lit(1.0), wc / 80.0 + dc / 20.0 + cm / 2.0 + mm / 10.0)
    return [
        c["char_count"].cast("double").alias("char_count"), wc.cast("double").alias("word_count"),
        dc.cast("double").alias("digit_count"), (dc / F.greatest(c["char_count"], F.lit(1))).alias("digit_density"),
        mm.cast("double").alias("math_symbol_count"), c["punctuation_count"].cast("double").alias("punctuation_count"),
        c["code_marker_count"].cast("double").alias("code_marker_count"),
        (c["non_ws_chars"] / F.greatest(wc, F.lit(1))).alias("avg_word_length"),
        diff.alias("cheap_probe_difficulty"),
        F.greatest(F.lit(0.05), 1.0 - diff * 0.75).alias("cheap_probe_confidence"),
        F.greatest(F.lit(0.0), 1.0 - F.abs(dc - mm) / F.greatest(wc, F.lit(1))).alias("cheap_probe_consistency"),
    ]


def feature_frame(df: DataFrame, query_col: str = "query") -> DataFrame:
    """surface + probe features; other input columns kept unless they collide.
    Counts are staged once per row, then every feature is arithmetic on them."""
    names = set(SURFACE_COLUMNS) | set(PROBE_COLUMNS)
    keep = [c for c in df.columns if c not in names]
    return with_counts(df, keep, query_col).select(*keep, *features_from_counts())


def byte_counts(query_col: str = "query") -> Column:
    """The counts of ``surface_counts`` but for the characters, made in one pass over the UTF-8 bytes of each text: a struct
    of ``COUNT_COLUMNS`` with ``white_count`` in place of ``char_count`` and ``non_ws_chars``.

    Every byte is replaced by the sign of its class, which is then counted; wide white space is cut to one blank first.
    Markers are found in ASCII lower case: of the characters that become ASCII letters, the Kelvin sign's k is in no marker
    and the dotted capital I leaves a dot behind its i, which no marker holds."""
    classes = {**dict.fromkeys(MATH_SYMBOLS, "+"), **dict.fromkeys(PUNCTUATION, "."), **dict.fromkeys(DIGITS, "0"), **dict.fromkeys(WS_CHARS, " ")}
    sign = bytes(ord(classes.get(chr(b), "x")) if b < 0x80 else ord("x") for b in range(256))
    wide = re.compile(b"|".join(re.escape(c.encode()) for c in WS_CHARS if c > "\x7f"))
    surface, probe = ([m.encode() for m in markers] for markers in (SURFACE_CODE_MARKERS, PROBE_CODE_MARKERS))
    names = ["white_count", "word_count", "digit_count", "math_symbol_count", "punctuation_count", "code_marker_count", "probe_code_markers"]

    def counted(text: bytes | None) -> tuple[int, ...]:
        if not text:
            return (0,) * len(names)
        low = text.lower()
        markers = sum(m in low for m in surface), sum(m in low for m in probe)
        if not text.isascii():
            text = wide.sub(b" ", text)
        signs = text.translate(sign)
        blank = np.frombuffer(signs, np.uint8) == 32
        starts = int(np.count_nonzero(blank[:-1] > blank[1:])) + (not blank[0])
        return int(np.count_nonzero(blank)), starts, signs.count(b"0"), signs.count(b"+"), signs.count(b"."), *markers

    @F.arrow_udf(", ".join(f"{n} int" for n in names))
    def counts(texts: pa.Array) -> pa.Array:
        rows = [counted(t.as_buffer().to_pybytes() if t.is_valid else None) for t in texts.cast(pa.large_binary())]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(len(names))], names=names)

    return counts(F.col(query_col).cast("string"))


def with_counts(df: DataFrame, keep: list[str], query_col: str = "query") -> DataFrame:
    """The ``keep`` columns of ``df`` and the counts of its query as ``_n_*`` columns, each made once."""
    q = F.coalesce(F.col(query_col).cast("string"), F.lit(""))
    base = df.select(*keep, F.length(q).alias("_n_char_count"), byte_counts(query_col).alias("_f_counts"))
    made = {"char_count": F.col("_n_char_count"), "non_ws_chars": F.col("_n_char_count") - F.col("_f_counts.white_count")}
    return base.select(*keep, *[made.get(k, F.col(f"_f_counts.{k}")).alias("_n_" + k) for k in COUNT_COLUMNS])


def with_embedding_features(df: DataFrame, vectors: DataFrame, key: str, dim: int = 16, vector_col: str = "embedding") -> DataFrame:
    """the first ``dim`` components of each row's vector from a table of vectors (key, vector), zeros where the vector
    is shorter or missing."""
    v = vectors.select(key, F.slice(F.col(vector_col), 1, dim).alias("_v"))
    j = df.join(v, key, "left")
    at = lambda i: F.coalesce(F.get("_v", F.lit(i)).cast("double"), F.lit(0.0))
    return j.select(*df.columns, *[at(i).alias(f"semantic_embedding_{i:02d}") for i in range(dim)])
