"""Answer extraction and normalization as native column expressions.

No per-row Python: every step is a regex / string expression that stays in
whole-stage codegen.  Multi-step extractions are applied as *staged* columns
(``add_*`` helpers) so that each expensive regex over a whole text runs once:
Catalyst does not collapse projections that would repeat a non-cheap
expression.

Regexes avoid ``\\d``/``\\s`` (Unicode in Python, ASCII in Java and RE2) in
favour of explicit classes.  Braces are balanced by folds over the list of a
text's braces, and rationals are compared digit by digit: neither nesting depth
nor length has a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.functions.features import WS, WS_CHARS

NUMBER = "[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?"
HASH_MARK = "####" + WS + "*([^\n]+)"
ANSWER_INLINE = "(?i)(?:final" + WS + "+answer|answer)" + WS + "*\\*{0,2}" + WS + "*[:：]" + WS + "*\\*{0,2}" + WS + "*([^\n]+)"
ANSWER_NEXT_LINE = (
    "(?i)(?:final" + WS + "+answer|answer)" + WS + "*\\*{0,2}" + WS + "*[:：]" + WS + "*\\*{0,2}" + WS + "*\n+" + WS + "*([^\n]+)"
)
FENCED = "(?is)```(?:python)?" + WS + "*(.*?)```"
DEF_START = "(?s)(def" + WS + "+[a-zA-Z_][a-zA-Z0-9_]*" + WS + "*\\(.*)"
BACKSLASH = "\\"
BOX_START = "\\\\boxed" + WS + "*\\z"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
EQUATION = "(?is)(?:^|[" + WS_CHARS + ",.;:])(?:[a-z]|answer|value)" + WS + "*=" + WS + "*(.+)$"
FRAC = "(\\\\[dt]?frac" + WS + "*\\{[^{}]+\\}" + WS + "*\\{[^{}]+\\})"
FRAC_FULL = "^([-+]?)\\\\frac\\{([-+]?[0-9]+)\\}\\{([-+]?[0-9]+)\\}$"
DEC_FULL = "^[-+]?[0-9]+(?:\\.[0-9]+)?$"
LIMB = 9  # decimal digits multiplied at a time
LATEX_REPLACEMENTS = (("\\left", ""), ("\\right", ""), ("\\{", "{"), ("\\}", "}"), ("\\,", ""), ("\\!", ""),
                      ("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"))


# ---------------------------------------------------------------------------
# single-step expressions
# ---------------------------------------------------------------------------

def pystrip(c: Column) -> Column:
    """Python ``str.strip()``: trim the whole whitespace set at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def last_match(c: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), 1), F.lit(-1))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def strip_markdown(c: Column) -> Column:
    v = F.regexp_replace(pystrip(c), "^[-*" + WS_CHARS + "]+", "")
    return pystrip(F.regexp_replace(F.regexp_replace(v, "\\*\\*", ""), "__", ""))


def marker_answer(t: Column, pattern: str) -> Column:
    return blank_to_null(strip_markdown(F.regexp_extract(t, pattern, 1)))


def normalize_number(c: Column) -> Column:
    """First number of ``c`` without commas; trailing decimal zeros (and dot) dropped."""
    raw = F.regexp_replace(F.regexp_extract(c, NUMBER, 0), ",", "")
    trimmed = F.regexp_replace(F.regexp_replace(raw, "0+$", ""), "\\.$", "")
    norm = F.when(F.instr(raw, ".") > 0, F.when(trimmed == "", F.lit("0")).otherwise(trimmed)).otherwise(raw)
    return F.when(raw != "", norm)


def normalize_text(c: Column) -> Column:
    """G4 normalization: lower-case, whitespace runs collapsed, stripped."""
    return pystrip(F.regexp_replace(F.lower(c), WS + "+", " "))


# ---------------------------------------------------------------------------
# staged transforms
# ---------------------------------------------------------------------------

def sql_string(s: str) -> str:
    """``s`` as a string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def add_last_boxed(df: DataFrame, src: str, dst: str) -> DataFrame:
    """``add_last_boxes`` of one column."""
    return add_last_boxes(df, {dst: src})


def add_last_boxes(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """For each new column, the content of the last ``\\boxed{..}`` of its source that closes, stripped; null when there is
    none or it is blank.

    The text is cut at its braces.  A fold from the right finds the last box start with a closing brace left over for
    it, a fold from there the brace that closes it; both keep a fixed state, so length and depth have no bound.  The folds
    are SQL text, and each step is made for all columns at once: a plan of few steps takes the driver less time."""
    def opened(src: str) -> str:
        pieces = f"split(`{src}`, '[{{}}]', -1)"
        return f"""CASE WHEN instr(`{src}`, {sql_string(BACKSLASH + "boxed")}) > 0 THEN transform(
            filter(arrays_zip(regexp_extract_all(`{src}`, '([{{}}])', 1), {pieces}, slice({pieces}, 2, {1 << 30})), x -> x.`0` IS NOT NULL),
            x -> named_struct('opens', x.`0` = '{{', 'box', x.`1` RLIKE {sql_string(BOX_START)}, 'text', concat(x.`0`, x.`2`))) END"""

    def found(it: str) -> str:
        return f"""CASE WHEN size({it}) > 0 THEN aggregate(sequence(size({it}) - 1, 0, -1), named_struct('free', 0, 'hit', -1), (a, i) -> CASE
            WHEN a.hit >= 0 THEN a WHEN NOT get({it}, i).opens THEN named_struct('free', a.free + 1, 'hit', a.hit) WHEN a.free = 0 THEN a
            WHEN get({it}, i).box THEN named_struct('free', a.free, 'hit', i) ELSE named_struct('free', a.free - 1, 'hit', a.hit) END).hit END"""

    def closed(it: str, hit: str) -> str:
        return f"""CASE WHEN {hit} >= 0 THEN aggregate(sequence({hit} + 1, size({it}) - 1), named_struct('depth', 1, 'close', -1), (a, i) -> CASE
            WHEN a.close >= 0 THEN a ELSE named_struct('depth', a.depth + IF(get({it}, i).opens, 1, -1),
              'close', IF(a.depth + IF(get({it}, i).opens, 1, -1) = 0, i, -1)) END).close END"""

    def inside(dst: str) -> Column:
        text = F.expr(f"array_join(transform(slice({dst}_items, {dst}_hit + 1, {dst}_close - {dst}_hit), x -> x.text), '')")
        return F.when(F.col(f"{dst}_hit") >= 0, blank_to_null(pystrip(F.substr(text, F.lit(2)))))

    df = df.withColumns({f"{d}_items": F.expr(opened(src)) for d, src in sources.items()})
    df = df.withColumns({f"{d}_hit": F.expr(found(f"{d}_items")) for d in sources})
    df = df.withColumns({f"{d}_close": F.expr(closed(f"{d}_items", f"{d}_hit")) for d in sources})
    return df.withColumns({d: inside(d) for d in sources}).drop(*[f"{d}_{x}" for d in sources for x in ("items", "hit", "close")])


def add_stripped_braces(df: DataFrame, *cols: str) -> DataFrame:
    """Of each column, all braces that wrap the whole of it removed: as many as the lowest depth between the leading and the
    trailing braces, if the text is balanced."""
    def listed(c: str) -> str:
        return f"CASE WHEN startswith(`{c}`, '{{') AND endswith(`{c}`, '}}') THEN regexp_extract_all(`{c}`, '([{{}}])', 1) END"

    def layers(c: str) -> str:
        lead, trail = f"(length(`{c}`) - length(ltrim('{{', `{c}`)))", f"(length(`{c}`) - length(rtrim('}}', `{c}`)))"
        step = "a.depth + IF(b = '{', 1, -1)"
        end = f"""aggregate({c}_braces, named_struct('i', 0, 'depth', 0, 'low', {(1 << 31) - 1}), (a, b) -> named_struct('i', a.i + 1, 'depth', {step},
            'low', IF(a.i >= {lead} - 1 AND a.i < size({c}_braces) - {trail}, least(a.low, {step}), a.low)))"""
        return f"CASE WHEN {c}_braces IS NOT NULL THEN transform(array({end}), e -> IF(e.depth = 0, greatest(e.low, 0), 0))[0] END"

    df = df.withColumns({f"{c}_braces": F.expr(listed(c)) for c in cols})
    df = df.withColumns({f"{c}_braces": F.expr(layers(c)) for c in cols})
    cut = {c: F.expr(f"CASE WHEN {c}_braces > 0 THEN substr(`{c}`, {c}_braces + 1, length(`{c}`) - 2 * {c}_braces) ELSE `{c}` END") for c in cols}
    return df.withColumns(cut).drop(*[f"{c}_braces" for c in cols])


def add_marked_answer(df: DataFrame, text_col: str, dst: str = "_marked") -> DataFrame:
    """G1: last boxed; else first ``#### x``, ``answer: x``, ``answer:\\n x`` (markdown stripped)."""
    df = df.withColumn("_t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = add_last_boxed(df, "_t", "_boxed")
    t = F.col("_t")
    return df.withColumn(dst, F.coalesce(F.col("_boxed"), marker_answer(t, HASH_MARK), marker_answer(t, ANSWER_INLINE),
                                         marker_answer(t, ANSWER_NEXT_LINE))).drop("_boxed")


def add_text_answers(df: DataFrame, text_col: str = "output_text", task_col: str | None = None) -> DataFrame:
    """All answer candidates of a text, each regex over the text run once:
    ``_t, _marked, _lastnum, _numeric, _stripped, _final, _code, _math_raw``.

    With ``task_col``, each candidate is computed only on the rows of the task
    that uses it (conditional evaluation skips the regexes elsewhere)."""
    df = add_marked_answer(df, text_col, "_marked")
    t, mk = F.col("_t"), F.col("_marked")

    def only(tasks, expr):
        if task_col is None:
            return expr
        return F.when(F.col(task_col).isin(*tasks), expr) if tasks[0] != "*other*" else F.when(
            ~F.col(task_col).isin("gsm8k", "math", "humaneval"), expr)
    df = df.withColumn("_lastnum", only(("gsm8k", "math"), last_match(t, "(" + NUMBER + ")")))
    df = df.withColumn("_numeric", F.coalesce(F.when(mk.isNotNull(), normalize_number(mk)), normalize_number(F.col("_lastnum"))))
    df = df.withColumn("_stripped", blank_to_null(pystrip(t)))
    df = df.withColumn("_final", F.coalesce(mk, F.col("_stripped")))
    # G5 code block: last fenced block, else from the first ``def name(``
    df = df.withColumn("_fenced", only(("humaneval",), last_match(t, FENCED)))
    df = df.withColumn("_code", only(("humaneval",), F.when(F.col("_fenced").isNotNull(), blank_to_null(pystrip(F.col("_fenced"))))
                       .otherwise(blank_to_null(pystrip(F.regexp_extract(t, DEF_START, 1)))))).drop("_fenced")
    # G3 math output answer
    lines = F.filter(F.split(t, LINE_BREAK), lambda ln: F.length(pystrip(ln)) > 0)
    eq = F.filter(F.transform(lines, lambda ln: F.regexp_extract(strip_chars(pystrip(ln), "$"), EQUATION, 1)), lambda x: x != "")
    df = df.withColumn("_eq", only(("math",), F.try_element_at(eq, F.lit(-1))))
    df = df.withColumn("_math_raw", only(("math",), F.coalesce(
        mk, F.when(F.col("_eq").isNotNull(), strip_chars(pystrip(F.col("_eq")), "$.,;:")), last_match(t, FRAC),
        F.col("_lastnum"), F.col("_stripped")))).drop("_eq")
    return df


def add_normalized_math(df: DataFrame, src: str, dst: str, *more: tuple[str, str]) -> DataFrame:
    """G3 normalization of an answer string (null when blank), staged; ``more``: further (source, new column) pairs, made in
    the same steps."""
    pairs = {d: s for s, d in ((src, dst), *more)}
    df = add_last_boxes(df, {d + "_bx": s for d, s in pairs.items()})

    def plain(d: str, s: str) -> Column:
        v = F.replace(blank_to_null(pystrip(F.coalesce(F.col(d + "_bx"), F.col(s)))), F.lit("$"), F.lit(""))
        for a, b in LATEX_REPLACEMENTS:
            v = F.replace(v, F.lit(a), F.lit(b))
        return F.regexp_replace(v, WS + "+", "")

    df = df.withColumns({d: plain(d, s) for d, s in pairs.items()}).drop(*[d + "_bx" for d in pairs])
    df = add_stripped_braces(df, *pairs)
    behind = lambda c: F.when(F.instr(c, "=") > 0, F.try_element_at(F.split(c, "=", -1), F.lit(-1))).otherwise(c)
    df = add_stripped_braces(df.withColumns({d: behind(F.col(d)) for d in pairs}), *pairs)
    return df.withColumns({d: blank_to_null(F.lower(F.regexp_replace(F.col(d), "\\\\?%$", ""))) for d in pairs})


def add_rational(df: DataFrame, src: str) -> DataFrame:
    """``src_q``: sign, numerator and denominator (digit strings of any length) of a simple number or
    ``\\frac{a}{b}``; null otherwise."""
    t = pystrip(F.regexp_replace(F.col(src), ",", ""))
    sign = lambda x: F.when(F.startswith(x, F.lit("-")), -1).otherwise(1)
    digits = lambda x: F.regexp_replace(F.regexp_replace(x, "^[-+]", ""), "^0+(?=[0-9])", "")
    fs, fn, fd = (F.regexp_extract(t, FRAC_FULL, i) for i in (1, 2, 3))
    frac = F.struct((sign(fs) * sign(fn) * sign(fd)).alias("s"), digits(fn).alias("n"), digits(fd).alias("d"))
    ip, fp = F.regexp_extract(t, "^([-+]?[0-9]+)", 1), F.regexp_extract(t, "\\.([0-9]+)$", 1)
    dec = F.struct(sign(ip).alias("s"), digits(F.concat(ip, fp)).alias("n"), F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(fp))).alias("d"))
    return df.withColumn(src + "_q", F.when(t.rlike(FRAC_FULL), F.when(digits(fd) != "0", frac)).when(t.rlike(DEC_FULL), dec))


def product(a: Column, b: Column) -> Column:
    """Product of two digit strings of any length, as digits: limbs of nine digits are multiplied and carried."""
    number, base = "decimal(38,0)", F.lit(10**LIMB).cast("decimal(38,0)")

    def limbs(x):
        n = F.ceil(F.length(x) / LIMB).cast("int")
        padded = F.lpad(x, n * LIMB, F.lit("0"))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(padded, (n - i) * LIMB + 1, F.lit(LIMB)).cast(number))

    la, lb = limbs(a), limbs(b)
    zero = F.lit(0).cast(number)
    column = lambda k: F.aggregate(F.sequence(F.greatest(F.lit(0), k - F.size(lb) + 1), F.least(k, F.size(la) - 1)), zero,
                                   lambda s, i: (s + (F.get(la, i) * F.get(lb, k - i)).cast(number)).cast(number))
    columns = F.transform(F.sequence(F.lit(0), F.size(la) + F.size(lb) - 2), column)

    def carry(s, x):
        total = (s["carry"] + x).cast(number)
        low = (total % base).cast(number)
        return F.struct(((total - low) / base).cast(number).alias("carry"), F.concat(F.lpad(low.cast("string"), LIMB, "0"), s["digits"]).alias("digits"))

    done = F.aggregate(columns, F.struct(zero.alias("carry"), F.lit("").alias("digits")), carry)
    return F.ltrim(F.concat(done["carry"].cast("string"), done["digits"]), F.lit("0"))


def math_equal(left: str, right: str) -> Column:
    """Equal strings, or equal exact rationals by cross-multiplication (after add_rational on both)."""
    a, b = F.col(left + "_q"), F.col(right + "_q")
    zero = (a["n"] == "0") & (b["n"] == "0")
    short = F.length(a["n"]) + F.length(b["d"]) <= 36
    short = short & (F.length(b["n"]) + F.length(a["d"]) <= 36)
    whole = lambda x: x.try_cast("decimal(36,0)")
    cross = F.when(short, F.try_multiply(whole(a["n"]), whole(b["d"])) == F.try_multiply(whole(b["n"]), whole(a["d"]))).otherwise(
        product(a["n"], b["d"]) == product(b["n"], a["d"]))
    return (F.col(left) == F.col(right)) | F.coalesce(zero | ((a["s"] == b["s"]) & cross), F.lit(False))
