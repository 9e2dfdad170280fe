"""Quality rules: a threshold table compiled into one Spark projection (no user functions, no shuffle).

``measure`` adds every statistic of the whole text, ``THRESHOLDS`` is the rule table, ``compile_rules`` turns it into
one boolean column.  Rules are ratios of those statistics, so the verdict of a document depends on that row alone.

Defined results: a null text is judged as the empty text (no words, base rule fails, not kept); a null id stays null;
repeated rows are judged each for itself; extra columns pass through unless they bear the name of a result column, in
which case the result replaces them; an empty table gives an empty result; a very long text is measured whole and judged by
the same ratios, none goes by its length; a statistic equal to a threshold passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import WHITE, WORD

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: FIXED VALUES: frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and a in that is for it with as on are this by at from or an was "
    "der die das und in zu den mit von ist im sich für auf ein eine nicht "
    "de la le les et des en un une du que qui dans est pour par sur il elle au avec "
    "el los las y que en un una por con para es se del no su al lo"
).split()

#: (name, statistic, smallest, largest value that passes, size statistic, least size at which the rule applies).  A
#: share of few lines or words says little, so those rules start at a size.
THRESHOLDS = (
    ("length", "n_words", 10, float("inf"), "n_words", 0),
    ("word_length", "mean_word_chars", 2.0, 15.0, "n_words", 10),
    ("symbols", "symbol_ratio", 0.0, 0.3, "n_words", 10),
    ("stop_words", "stop_ratio", 0.02, 1.0, "n_words", 50),
    ("duplicate_lines", "dup_line_ratio", 0.0, 0.3, "n_lines", 8),
    ("ellipsis_lines", "ellipsis_ratio", 0.0, 0.3, "n_lines", 8),
    ("bullet_lines", "bullet_ratio", 0.0, 0.9, "n_lines", 8),
)
MAX_REPEAT_PERCENT, MIN_WORDS = 20, 10
GRAM = 5


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(GRAM)]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the statistics of each whole text.

    ``n_repeat_words`` is exact: hashes of the five-word windows only pick the rows that can hold a repeat; in those,
    the windows themselves are sorted next to each other and compared as strings.
    """
    own = [c for c in docs.columns]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    df = docs.withColumns({"_words": F.array_remove(F.split(t, WHITE + "+", -1), ""), "_lines": lines})
    words, n = F.col("_words"), F.size("_words")
    starts = F.sequence(F.lit(0), n - GRAM)
    df = df.withColumn("_hashes", F.when(n > GRAM, F.transform(starts, lambda i: F.xxhash64(*_window(words, i)))))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    gram = lambda i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("g"), i.alias("i"))
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform(starts, gram))))
    s, last = F.col("_sorted"), F.size("_sorted") - 1
    same = lambda a, b: F.coalesce(F.get(s, a)["g"] == F.get(s, b)["g"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), last), lambda j: same(j, j - 1) | same(j, j + 1))
    at = F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(0).alias("n"), F.lit(-GRAM).alias("p")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(GRAM), p - a["p"])).alias("n"), p.alias("p")),
    )["n"]
    stop = F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.concat_ws("", words)).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.when(s.isNotNull(), covered), F.lit(0)).cast("long"),
        "n_stop_words": F.size(stop).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "_ellipsis": F.size(F.filter("_lines", lambda x: F.rtrim(x, F.lit(BLANKS)).endswith("...") | F.rtrim(x, F.lit(BLANKS)).endswith("…"))),
        "_bullets": F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
    })
    per_word, per_line = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    made = {
        "mean_word_chars": F.col("word_chars") / per_word,
        "symbol_ratio": F.col("n_symbols") / per_word,
        "stop_ratio": F.col("n_stop_words") / per_word,
        "dup_line_ratio": F.col("n_dup_lines") / per_line,
        "ellipsis_ratio": F.col("_ellipsis") / per_line,
        "bullet_ratio": F.col("_bullets") / per_line,
    }
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines"]
    # A filter on a statistic must read it, not compute it again inside the filter: Spark moves no filter below a column
    # that depends on the partition.
    here = F.spark_partition_id() >= 0
    df = df.select(*[c for c in own if c not in stats], "_ellipsis", "_bullets", *[F.when(here, F.col(c)).alias(c) for c in stats])
    return df.select(*[c for c in own if c not in stats and c not in made], *stats, *[v.alias(k) for k, v in made.items()])


def compile_rules(rules=THRESHOLDS) -> Column:
    """The rule table as one boolean column over the measured statistics: true if every rule passes."""
    verdict = F.lit(True)
    for _, stat, low, high, size, least in rules:
        verdict = verdict & ((F.col(size) < least) | F.col(stat).between(low, high))
    return verdict


def apply_rules(docs: DataFrame, rules=THRESHOLDS, text: str = "text") -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``."""
    df = measure(docs.drop("base_failed", "kept"), text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def keep_good(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that pass, with their own columns."""
    judged = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("text"))
    return apply_rules(judged).where("kept").select("_row.*")
