"""DuckDB SQL fragments mirroring the column expressions, for the oracle only.

Expressions, patterns, character sets and values are written here and in
``sql_values`` on their own; nothing comes from the engine's configuration.
"""

from __future__ import annotations

import re

from gridstone.plans.sql_values import (
    ALPHA, BETA, DIFFICULTY_TASK_BONUS, DIFFICULTY_TASK_BONUS_DEFAULT, GAMMA, MATH_SYMBOLS, PROBE_CODE_MARKERS, PUNCTUATION, SURFACE_CODE_MARKERS)

# White space of Python's str.split(), by code point (written here on its own, not taken from the engine).
WS_CHARS = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198,
                             8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]))
WS = "[" + WS_CHARS + "]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def exact_sum(x: str) -> str:
    """Sum of the doubles ``x`` in whole numbers, put together once: the same bits in any order of rows."""
    fine = f"(({x}) - trunc({x})) * 1152921504606846976::DOUBLE"
    whole = lambda part: f"CAST(sum(CAST({part} AS HUGEINT)) AS DOUBLE)"
    return (f"({whole(f'round(({fine} - trunc({fine})) * 1152921504606846976::DOUBLE)')} / 1329227995784915872903807060280344576::DOUBLE"
            f" + {whole(f'trunc({fine})')} / 1152921504606846976::DOUBLE + {whole(f'trunc({x})')})")


_SUMS = re.compile(r"\bexact_(sum|avg)\(([^()]+)\)")


def expand_sums(sql: str) -> str:
    """``exact_sum(x)`` and ``exact_avg(x)`` written out."""
    return _SUMS.sub(lambda m: exact_sum(f"CAST({m[2]} AS DOUBLE)") if m[1] == "sum" else f"({exact_sum(f'CAST({m[2]} AS DOUBLE)')} / count({m[2]}))", sql)


def round_doubles(sql: str, doubles: list[str]) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"round({c} * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"


# ---- features ---------------------------------------------------------------

def q(col: str) -> str:
    return f"coalesce(CAST({col} AS VARCHAR), '')"


def count_chars(col: str, chars: str) -> str:
    return f"(length({q(col)}) - length(translate({q(col)}, {lit(chars)}, '')))"


def word_count(col: str) -> str:
    return f"len(regexp_extract_all({q(col)}, {lit('([^' + WS_CHARS + ']+)')}, 1))"


def ws_count(col: str) -> str:
    return f"(length({q(col)}) - length(regexp_replace({q(col)}, {lit(WS)}, '', 'g')))"


def marker_count(col: str, markers: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN instr(lower({q(col)}), {lit(m)}) > 0 THEN 1 ELSE 0 END" for m in markers) + ")"


def surface_select(col: str = "query") -> str:
    cc, wc = f"length({q(col)})", word_count(col)
    dc = count_chars(col, "0123456789")
    return ", ".join([
        f"CAST({cc} AS DOUBLE) AS char_count",
        f"CAST({wc} AS DOUBLE) AS word_count",
        f"CAST({dc} AS DOUBLE) AS digit_count",
        f"{dc} / CAST(greatest({cc}, 1) AS DOUBLE) AS digit_density",
        f"CAST({count_chars(col, MATH_SYMBOLS)} AS DOUBLE) AS math_symbol_count",
        f"CAST({count_chars(col, PUNCTUATION)} AS DOUBLE) AS punctuation_count",
        f"CAST({marker_count(col, SURFACE_CODE_MARKERS)} AS DOUBLE) AS code_marker_count",
        f"({cc} - {ws_count(col)}) / CAST(greatest({wc}, 1) AS DOUBLE) AS avg_word_length",
    ])


def probe_select(col: str = "query") -> str:
    wc, dc = word_count(col), count_chars(col, "0123456789")
    cm, mm = marker_count(col, PROBE_CODE_MARKERS), count_chars(col, MATH_SYMBOLS)
    diff = f"least(1.0, {wc} / 80.0 + {dc} / 20.0 + {cm} / 2.0 + {mm} / 10.0)"
    return ", ".join([
        f"CAST({diff} AS DOUBLE) AS cheap_probe_difficulty",
        f"CAST(greatest(0.05, 1.0 - {diff} * 0.75) AS DOUBLE) AS cheap_probe_confidence",
        f"CAST(greatest(0.0, 1.0 - abs({dc} - {mm}) / CAST(greatest({wc}, 1) AS DOUBLE)) AS DOUBLE) AS cheap_probe_consistency",
    ])


def probe_difficulty(col: str = "query") -> str:
    wc, dc = word_count(col), count_chars(col, "0123456789")
    cm, mm = marker_count(col, PROBE_CODE_MARKERS), count_chars(col, MATH_SYMBOLS)
    return f"CAST(least(1.0, {wc} / 80.0 + {dc} / 20.0 + {cm} / 2.0 + {mm} / 10.0) AS DOUBLE)"


def heuristic_difficulty(col: str = "query", task: str = "task_type") -> str:
    wc, dc = word_count(col), count_chars(col, "0123456789")
    cm, mm = marker_count(col, SURFACE_CODE_MARKERS), count_chars(col, MATH_SYMBOLS)
    return (f"CASE WHEN {task} = 'humaneval' OR {cm} >= 2 OR {wc} > 120 THEN 'hard' "
            f"WHEN {task} = 'math' OR {dc} >= 8 OR {mm} >= 4 OR {wc} > 55 THEN 'medium' ELSE 'easy' END")


def difficulty_score(col: str = "query", task: str = "task_type") -> str:
    wc, dc = word_count(col), count_chars(col, "0123456789")
    mm, cm = count_chars(col, MATH_SYMBOLS), marker_count(col, SURFACE_CODE_MARKERS)
    bonus = "CASE " + " ".join(f"WHEN {task} = {lit(k)} THEN {v}" for k, v in DIFFICULTY_TASK_BONUS.items()) + \
        f" ELSE {DIFFICULTY_TASK_BONUS_DEFAULT} END"
    return f"CAST(({wc} * 1.0 + {dc} * 2.0 + {mm} * 3.0 + {cm} * 30.0) + ({bonus}) AS DOUBLE)"


def row_utility(correct: str = "is_correct", cost: str = "cost_usd", lat: str = "latency_s") -> str:
    return (f"(CAST({ALPHA} AS DOUBLE) * coalesce(CAST({correct} AS DOUBLE), 0.0) - CAST({BETA} AS DOUBLE) * "
            f"coalesce(CAST({cost} AS DOUBLE), 0.0) - CAST({GAMMA} AS DOUBLE) * coalesce(CAST({lat} AS DOUBLE), 0.0))")


def summary_utility(latency: str = "avg") -> str:
    lat = "coalesce(p95_latency, avg_latency, 0.0)" if latency == "p95" else "coalesce(avg_latency, 0.0)"
    return (f"(CAST({ALPHA} AS DOUBLE) * coalesce(accuracy, 0.0) - CAST({BETA} AS DOUBLE) * coalesce(avg_cost, 0.0) "
            f"- CAST({GAMMA} AS DOUBLE) * {lat})")


METRICS = ("avg(CAST(is_correct AS DOUBLE)) AS accuracy, exact_avg(cost_usd) AS avg_cost, exact_sum(cost_usd) AS total_cost, "
           "exact_avg(latency_s) AS avg_latency, quantile_cont(latency_s, 0.95) AS p95_latency, count(*) AS n")
METRIC_DOUBLES = ["accuracy", "avg_cost", "total_cost", "avg_latency", "p95_latency"]


# ---- text -------------------------------------------------------------------

def pystrip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"
