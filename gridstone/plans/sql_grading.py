"""DuckDB SQL for grading and failure classification (oracle only), as layered subqueries.

Each step is one ``SELECT *, expr AS col FROM (previous)`` layer, mirroring
the staged Spark columns so that no expression is repeated exponentially.
"""

from __future__ import annotations

from gridstone.plans.sqlfrag import WS, WS_CHARS, lit, pystrip

# Patterns of the oracle alone.  The fixture's answers nest braces two deep and hold at most four digits; what lies
# beyond (depth, length, 40-digit rationals) is covered by literal expectations in tests/test_grading.py.
INNER = r"(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*"
BOXED = rf"\\boxed{WS}*\{{({INNER})\}}"
NUMBER = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"
HASHES = rf"####{WS}*([^\n]+)"
SAME_LINE = rf"(?i)(?:final{WS}+answer|answer){WS}*\*{{0,2}}{WS}*[:：]{WS}*\*{{0,2}}{WS}*([^\n]+)"
NEXT_LINE = rf"(?i)(?:final{WS}+answer|answer){WS}*\*{{0,2}}{WS}*[:：]{WS}*\*{{0,2}}{WS}*\n+{WS}*([^\n]+)"
FENCE = rf"(?is)```(?:python)?{WS}*(.*?)```"
DEFINITION = rf"(?s)(def{WS}+[a-zA-Z_][a-zA-Z0-9_]*{WS}*\(.*)"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
EQUATION = rf"(?is)(?:^|[{WS_CHARS},.;:])(?:[a-z]|answer|value){WS}*={WS}*(.+)$"
FRACTION = rf"(\\[dt]?frac{WS}*\{{[^{{}}]+\}}{WS}*\{{[^{{}}]+\}})"
WHOLE_FRACTION = r"^([-+]?)\\frac\{([-+]?[0-9]+)\}\{([-+]?[0-9]+)\}$"
WHOLE_DECIMAL = r"^[-+]?[0-9]+(?:\.[0-9]+)?$"
LATEX = [("\\left", ""), ("\\right", ""), ("\\{", "{"), ("\\}", "}"), ("\\,", ""), ("\\!", ""), ("\\dfrac", "\\frac"), ("\\tfrac", "\\frac")]


class Layers:
    def __init__(self, base: str):
        self.sql = base

    def add(self, col: str, expr: str) -> "Layers":
        self.sql = f"SELECT *, {expr} AS {col} FROM ({self.sql})"
        return self

    def replace(self, col: str, expr: str) -> "Layers":
        self.sql = f"SELECT * REPLACE ({expr} AS {col}) FROM ({self.sql})"
        return self

    def drop(self, *cols: str) -> "Layers":
        self.sql = f"SELECT * EXCLUDE ({', '.join(cols)}) FROM ({self.sql})"
        return self


def blank_to_null(x: str) -> str:
    return f"nullif({x}, '')"


def last_match(x: str, pattern: str) -> str:
    return f"list_extract(regexp_extract_all({x}, {lit(pattern)}, 1), -1)"


def strip_chars(x: str, chars: str) -> str:
    cls = "[" + "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars) + "]"
    return f"regexp_replace({x}, {lit('^' + cls + '+|' + cls + '+$')}, '', 'g')"


def strip_markdown(x: str) -> str:
    v = f"regexp_replace({pystrip(x)}, {lit('^[-*' + WS_CHARS + ']+')}, '', 'g')"
    return pystrip(f"replace(replace({v}, '**', ''), '__', '')")


def marker_answer(t: str, pattern: str) -> str:
    return blank_to_null(strip_markdown(f"regexp_extract({t}, {lit(pattern)}, 1)"))


def normalize_number(x: str) -> str:
    raw = f"replace(regexp_extract({x}, {lit(NUMBER)}, 0), ',', '')"
    trimmed = f"regexp_replace(regexp_replace({raw}, '0+$', ''), '\\.$', '')"
    norm = f"CASE WHEN instr({raw}, '.') > 0 THEN (CASE WHEN {trimmed} = '' THEN '0' ELSE {trimmed} END) ELSE {raw} END"
    return f"CASE WHEN {raw} <> '' THEN {norm} END"


def normalize_text(x: str) -> str:
    return pystrip(f"regexp_replace(lower({x}), {lit(WS + '+')}, ' ', 'g')")


def strip_brace_round(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, {lit('^\\{' + INNER + '\\}$')}) "
            f"THEN regexp_replace({x}, '^\\{{|\\}}$', '', 'g') ELSE {x} END")


def last_boxed(L: Layers, src: str, dst: str) -> Layers:
    L.add(dst + "_1", last_match(src, BOXED))
    L.add(dst + "_2", f"coalesce({last_match(dst + '_1', BOXED)}, {dst}_1)")
    L.add(dst + "_3", f"coalesce({last_match(dst + '_2', BOXED)}, {dst}_2)")
    L.add(dst, blank_to_null(pystrip(dst + "_3")))
    return L.drop(dst + "_1", dst + "_2", dst + "_3")


def marked_answer(L: Layers, text_col: str, dst: str = "_marked") -> Layers:
    L.add("_t", f"coalesce(CAST({text_col} AS VARCHAR), '')")
    last_boxed(L, "_t", "_boxed")
    L.add(dst, f"coalesce(_boxed, {marker_answer('_t', HASHES)}, {marker_answer('_t', SAME_LINE)}, "
               f"{marker_answer('_t', NEXT_LINE)})")
    return L.drop("_boxed")


def text_answers(L: Layers, text_col: str = "output_text") -> Layers:
    marked_answer(L, text_col)
    L.add("_lastnum", last_match("_t", "(" + NUMBER + ")"))
    L.add("_numeric", f"coalesce(CASE WHEN _marked IS NOT NULL THEN {normalize_number('_marked')} END, {normalize_number('_lastnum')})")
    L.add("_stripped", blank_to_null(pystrip("_t")))
    L.add("_final", "coalesce(_marked, _stripped)")
    L.add("_fenced", last_match("_t", FENCE))
    L.add("_code", f"CASE WHEN _fenced IS NOT NULL THEN {blank_to_null(pystrip('_fenced'))} "
                   f"ELSE {blank_to_null(pystrip(f'regexp_extract(_t, {lit(DEFINITION)}, 1)'))} END")
    L.drop("_fenced")
    lines = f"list_filter(regexp_split_to_array(_t, {lit(LINE_END)}), lambda ln: length({pystrip('ln')}) > 0)"
    eq = (f"list_filter(list_transform({lines}, lambda ln: regexp_extract({strip_chars(pystrip('ln'), '$')}, "
          f"{lit(EQUATION)}, 1)), lambda x: x <> '')")
    L.add("_eq", f"list_extract({eq}, -1)")
    L.add("_math_raw", f"coalesce(_marked, CASE WHEN _eq IS NOT NULL THEN {strip_chars(pystrip('_eq'), '$.,;:')} END, "
                       f"{last_match('_t', FRACTION)}, _lastnum, _stripped)")
    return L.drop("_eq")


def normalized_math(L: Layers, src: str, dst: str) -> Layers:
    last_boxed(L, src, dst + "_bx")
    v = blank_to_null(pystrip(f"coalesce({dst}_bx, {src})"))
    v = f"replace({v}, '$', '')"
    for a, b in LATEX:
        v = f"replace({v}, {lit(a)}, {lit(b)})"
    L.add(dst, f"regexp_replace({v}, {lit(WS + '+')}, '', 'g')").drop(dst + "_bx")
    for _ in range(3):
        L.replace(dst, strip_brace_round(dst))
    L.replace(dst, f"CASE WHEN instr({dst}, '=') > 0 THEN list_extract(string_split({dst}, '='), -1) ELSE {dst} END")
    for _ in range(3):
        L.replace(dst, strip_brace_round(dst))
    return L.replace(dst, blank_to_null(f"lower(regexp_replace({dst}, {lit('\\\\?%$')}, '', 'g'))"))


def rational(L: Layers, src: str) -> Layers:
    d = src + "_q"
    L.add(d + "_t", pystrip(f"replace({src}, ',', '')"))
    t = d + "_t"
    ff = lit(WHOLE_FRACTION)
    fn, fd = f"regexp_extract({t}, {ff}, 2)", f"regexp_extract({t}, {ff}, 3)"
    sign = f"(CASE WHEN regexp_extract({t}, {ff}, 1) = '-' THEN -1 ELSE 1 END)"
    ip, fp = f"regexp_extract({t}, '^([-+]?[0-9]+)', 1)", f"regexp_extract({t}, '\\.([0-9]+)$', 1)"
    is_frac = (f"(regexp_matches({t}, {ff}) AND length({fn}) <= {19} AND length({fd}) <= {19} "
               f"AND TRY_CAST({fd} AS DECIMAL(38,0)) <> 0)")
    is_dec = f"(regexp_matches({t}, {lit(WHOLE_DECIMAL)}) AND length({ip}) + length({fp}) <= {18})"
    L.add(d + "_n", f"CASE WHEN {is_frac} THEN TRY_CAST({fn} AS DECIMAL(38,0)) * {sign} "
                    f"WHEN {is_dec} THEN TRY_CAST(concat({ip}, {fp}) AS DECIMAL(38,0)) END")
    L.add(d + "_d", f"CASE WHEN {is_frac} THEN TRY_CAST({fd} AS DECIMAL(38,0)) "
                    f"WHEN {is_dec} THEN CAST(pow(10, length({fp})) AS DECIMAL(38,0)) END")
    return L.drop(t)


def math_equal(a: str, b: str) -> str:
    cross = f"(CAST({a}_q_n AS HUGEINT) * CAST({b}_q_d AS HUGEINT) = CAST({b}_q_n AS HUGEINT) * CAST({a}_q_d AS HUGEINT))"
    return f"(({a} = {b}) OR coalesce({cross}, false))"


def grades(L: Layers, outcome: str = "CAST(NULL AS VARCHAR)") -> Layers:
    text_answers(L)
    L.add("_exp_s", "CAST(expected_answer AS VARCHAR)")
    L.add("_exp_num", normalize_number("_exp_s"))
    L.add("_exp_text", f"CASE WHEN _exp_s IS NOT NULL THEN {normalize_text('_exp_s')} END")
    normalized_math(L, "_math_raw", "_m_ext")
    normalized_math(L, "_exp_s", "_m_exp")
    rational(L, "_m_ext")
    rational(L, "_m_exp")
    num_ok = "(_numeric IS NOT NULL AND _exp_num IS NOT NULL AND _numeric = _exp_num)"
    math_ok = f"(_m_ext IS NOT NULL AND _m_exp IS NOT NULL AND {math_equal('_m_ext', '_m_exp')})"
    code_ok = f"(_code IS NOT NULL AND coalesce({outcome} = 'pass', false))"
    exact_ok = f"(_final IS NOT NULL AND _exp_text IS NOT NULL AND length(_exp_text) > 0 AND {normalize_text('_final')} = _exp_text)"
    L.add("_g_ok", f"coalesce(CASE task_type WHEN 'gsm8k' THEN {num_ok} WHEN 'math' THEN {math_ok} "
                   f"WHEN 'humaneval' THEN {code_ok} ELSE {exact_ok} END, false)")
    code_err = (f"CASE WHEN _code IS NULL THEN 'parse_error' WHEN {outcome} IS NULL THEN 'execution_error' "
                f"WHEN {outcome} = 'pass' THEN NULL WHEN {outcome} = 'AssertionError' THEN 'wrong_answer' ELSE 'execution_error' END")
    L.add("_g_score", "CASE WHEN _g_ok THEN 1.0 ELSE 0.0 END")
    L.add("_g_extracted", "CASE task_type WHEN 'gsm8k' THEN _numeric WHEN 'math' THEN _m_ext WHEN 'humaneval' THEN _code ELSE _final END")
    L.add("_g_expected", "CASE task_type WHEN 'gsm8k' THEN _exp_num WHEN 'math' THEN _m_exp WHEN 'humaneval' THEN _exp_s ELSE _exp_text END")
    L.add("_g_error", f"""CASE task_type
        WHEN 'gsm8k' THEN (CASE WHEN _numeric IS NULL THEN 'parse_error' WHEN NOT _g_ok THEN 'wrong_answer' END)
        WHEN 'math' THEN (CASE WHEN _m_ext IS NULL THEN 'parse_error' WHEN NOT _g_ok THEN 'wrong_answer' END)
        WHEN 'humaneval' THEN {code_err}
        ELSE (CASE WHEN _final IS NULL THEN 'empty_output' WHEN NOT _g_ok THEN 'wrong_answer' END) END""")
    return L


def failure_class(L: Layers, text_col: str = "output_text", expected_col: str = "expected_answer",
                  extracted_col: str = "extracted_answer") -> Layers:
    L.add("_ft", f"coalesce(CAST({text_col} AS VARCHAR), '')")
    L.add("_fexp", f"CAST({expected_col} AS VARCHAR)").add("_fext", f"CAST({extracted_col} AS VARCHAR)")
    normalized_math(L, "_fexp", "_fm_exp")
    normalized_math(L, "_fext", "_fm_ext")
    normalized_math(L, "_ft", "_fm_out")
    L.add("_fn_exp", normalize_number("_fexp")).add("_fn_ext", normalize_number("_fext"))
    numbers = f"list_transform(regexp_extract_all(_ft, {lit('(' + NUMBER + ')')}, 1), lambda x: {normalize_number('x')})"
    numeric = (f"CASE WHEN _fn_ext IS NULL THEN 'no_numeric_answer' WHEN _fn_exp IS NULL THEN 'missing_expected_answer' "
               f"WHEN _fn_ext = _fn_exp THEN 'not_failure' WHEN coalesce(list_contains({numbers}, _fn_exp), false) "
               f"THEN 'answer_format_extraction_error' ELSE 'wrong_answer' END")
    math = ("CASE WHEN _fm_exp IS NULL THEN 'missing_expected_answer' WHEN _fm_ext IS NULL THEN 'no_final_answer' "
            "WHEN _fm_ext = _fm_exp THEN 'stale_or_normalization_mismatch' "
            "WHEN instr(coalesce(_fm_out, ''), _fm_exp) > 0 THEN 'answer_format_extraction_error' ELSE 'wrong_answer' END")
    ext_s = "coalesce(_fext, '')"
    code = (f"CASE WHEN length({pystrip(ext_s)}) = 0 THEN 'parse_error' "
            f"WHEN instr(lower(_ft), 'traceback') > 0 OR instr(lower(_ft), 'syntaxerror') > 0 THEN 'execution_error' "
            f"WHEN instr({ext_s}, 'def ') = 0 THEN 'malformed_answer' ELSE 'wrong_answer' END")
    return L.add("failure_class", f"CASE task_type WHEN 'math' THEN {math} WHEN 'humaneval' THEN {code} ELSE {numeric} END")
