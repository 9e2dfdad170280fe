"""Secret scans with multipart credential linking (DataFrame functions only).

Strong spans (assigned values of 12+ characters, access identifiers, long hex strings, urls that hold a login) stand by
themselves.  Weak parts (identifier fields, bare 40-character keys, also behind ``=`` or a quote, short assigned values and
key fields, endpoint fields and plain urls) are common in clean text, so each is reported only if a complementary part lies
within ``SCOPE`` characters in the same text: an identifier or an endpoint next to a secret, a secret next to an identifier
or an endpoint.  A weak secret's value must not be a plain word or number: it holds a letter and a digit, or a capital behind a
small letter.  A url is a part only if a secret's field follows in the same word.  So ``Your password: required field.  Help is
at https://example.org/help`` holds no part.  The parts of all texts are joined as intervals: each
is put in the cells of ``SCOPE`` characters it can reach, cells are matched by equality, distances are then compared.  A
cell holds no more parts than fit in its characters, whatever the length of the text.

Positions come from the pieces between matches: Spark gives the matches and the split text in the same order, so the
running sum of piece and match lengths is each match's start.

Defined results: a null text is the empty text; null ids are kept as rows of their own; rows that repeat an id and a text
come back as often as they came, each with the same spans; an empty table gives an empty result; extra columns are not
returned by ``scan`` and are kept by ``redact``, also when they bear the name of a span column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm.common import materialize

SCOPE = 256
#: Spans of up to so many texts (some 40 MB) are broadcast.
BROADCAST_ROWS = 1 << 18
_SECRET_FOLLOWS = r"(?=[^\s\"'<>]*[?&;#][A-Za-z0-9_.-]*(?i:password|passwd|secret|token|key|pass|pwd)=)"
#: A value that is no plain word or number.
MIXED = r"[0-9][^A-Za-z]*[A-Za-z]|[A-Za-z][^0-9]*[0-9]|[a-z][A-Z]"
#: FIXED VALUES: kinds in order; pattern, group whose length counts, fewest characters of it, role, strong or weak.
KINDS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, "secret", True),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, "identifier", True),
    ("hex", r"[0-9a-f]{16,}", 0, 16, "secret", True),  # runs under 16 fail anyway
    ("login", r"(?i:user_?name|login|client_?id|account_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@+/_.=-]+)", 1, 3, "identifier", False),
    ("bare_key", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40, "secret", False),
    ("short_secret", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, "secret", False),
    ("endpoint", r"(?i:endpoint|hostname|server_?url)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9:/_.-]+)", 1, 4, "endpoint", False),
    # kinds of their own, so that no match of the kinds above is cut short or moved
    ("account", r"(?i:user(?:_?id)?|uid|e_?mail|account(?:_?name)?|access_?key(?:_?id)?|key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@+/_.=-]+)", 1, 3, "identifier", False),
    ("key_field", r"(?i:secret_?(?:access_?)?key|private_?key|account_?key|auth_?key|pass_?phrase|pass|pwd)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6, "secret", False),
    ("host", r"(?i:host|server|ur[il])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9:/_.-]+)", 1, 3, "endpoint", False),
    # scheme and authority only: a secret in the query part stands apart from them
    ("url", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://([A-Za-z0-9_.-]+)(?![A-Za-z0-9_.-]*(?::[^@\s/?#\"'<>]*)?@)(?::[0-9]+)?" + _SECRET_FOLLOWS, 1, 3, "endpoint", False),
    ("url_login", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^@\s/:?#\"'<>]*:([^@\s/?#\"'<>]+)@[A-Za-z0-9_.-]+", 1, 1, "secret", True),
)
BASE = ("assign", "access", "hex")
#: A secret completes an identifier or an endpoint and is completed by either.
PAIRS = (("secret", "identifier"), ("secret", "endpoint"), ("identifier", "secret"), ("endpoint", "secret"))


def _possible(text: Column, name: str) -> Column:
    """A cheap test that every text with a part of the kind meets."""
    if name == "access":
        return F.contains(text, F.lit("AKIA"))
    if name.startswith("url"):
        return F.contains(text, F.lit("://"))
    return F.lit(True) if name in ("hex", "bare_key") else F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))


def _matches(text: Column, pattern: str, group: int, name: str) -> Column:
    """Per match of ``pattern`` the characters before it (from the last match's end), its length, its group's length and
    whether the group is no plain word."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    lens = F.transform(found, lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("n"), F.length(m["value"]).alias("v"), m["value"].rlike(MIXED).alias("mixed")))
    return F.when(_possible(text, name) & text.rlike(pattern), F.filter(lens, lambda m: m["n"].isNotNull()))


def _parts(docs: DataFrame) -> DataFrame:
    """One narrow row per document: its key and, per pattern, the lengths of matches and of the pieces between them."""
    text = F.coalesce("text", F.lit(""))
    patterns = {p: (f"_m{i}", g) for i, (p, g) in enumerate({k[1]: k[2] for k in KINDS}.items())}
    first = {k[1]: k[0] for k in reversed(KINDS)}
    made = {name: _matches(text, p, g, first[p]) for p, (name, g) in patterns.items()}
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text))
    return docs.select("doc_id", key.alias("key"), *[c.alias(n) for n, c in made.items()]), patterns


def _spans(parts: DataFrame, patterns: dict) -> DataFrame:
    """key, kind (number), start, end of every strong or weak part."""
    columns = [n for n, _ in patterns.values()]
    rows = parts.where(" or ".join(f"{c} is not null" for c in columns)).dropDuplicates(["key"])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.col(c).alias("ms")) for i, c in enumerate(columns)]))
    flat = rows.select("key", each.alias("x")).select("key", "x.p", F.posexplode("x.ms").alias("i", "m"))
    w = Window.partitionBy("key", "p").orderBy("i")
    ends = flat.select("key", "p", "m", F.sum(F.col("m.gap") + F.col("m.n")).over(w).alias("end"))
    at = {p: i for i, p in enumerate(patterns)}
    kind = F.lit(None).cast("int")
    for i, (name, pattern, _, least, role, strong) in reversed(list(enumerate(KINDS))):
        fits = (F.col("p") == at[pattern]) & (F.col("m.v") >= least)
        kind = F.when(fits if strong or role != "secret" else fits & F.col("m.mixed"), F.lit(i)).otherwise(kind)
    return ends.select("key", kind.alias("kind"), (F.col("end") - F.col("m.n")).cast("long").alias("start"), F.col("end").cast("long")).where("kind is not null")


def _linked(spans: DataFrame) -> DataFrame:
    """Strong spans, and the weak ones that a complementary part within SCOPE characters confirms."""
    role = F.element_at(F.array(*[F.lit(k[4]) for k in KINDS]), F.col("kind") + 1)
    strong = F.element_at(F.array(*[F.lit(k[5]) for k in KINDS]), F.col("kind") + 1)
    s = spans.select("*", role.alias("role"), strong.alias("strong"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE)))
    weak = s.where("not strong").select("key", "kind", "start", "end", "role", cells(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE).alias("cell"))
    other = s.select("key", cells(F.col("start"), F.col("end")).alias("cell"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"))
    fits = F.lit(False)
    for a, b in PAIRS:
        fits = fits | ((F.col("role") == a) & (F.col("o_role") == b))
    near = (F.col("o_start") - F.col("end") <= SCOPE) & (F.col("start") - F.col("o_end") <= SCOPE)
    apart = (F.col("o_start") >= F.col("end")) | (F.col("o_end") <= F.col("start"))
    confirmed = weak.join(other, ["key", "cell"]).where(fits & near & apart).select("key", "kind", "start", "end").distinct()
    return s.where("strong").select("key", "kind", "start", "end").unionByName(confirmed)


def _described(all_spans: Column, chosen: tuple) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), s["kind"] + 1)
    kept = F.filter(all_spans, lambda s: name(s).isin(*chosen))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one narrow row per document with its key, per key the sorted array of reported spans)."""
    narrow, patterns = _parts(docs)
    parts = materialize(narrow, "secret-parts")
    spans = materialize(_spans(parts, patterns), "secret-spans")
    linked = _linked(spans).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return parts.select("doc_id", "key"), linked


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of the base kinds, the digest of their spans, and all spans as ``kind:start:end``."""
    ids, linked = find(docs)
    found = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    df = ids.join(linked, "key", "left").select("doc_id", found.alias("f"))
    count = lambda i: F.size(F.filter("f", lambda s: s["kind"] == i)).cast("long")
    return df.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_described(F.col("f"), BASE), 256).alias("base_sha256"),
        _described(F.col("f"), tuple(k[0] for k in KINDS)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """Pipeline stage: ``docs`` with every reported span replaced by ``mark`` (overlapping spans by one); ``n_chars``,
    if present, follows the new text.  Up to a bound the spans are broadcast and texts stay where they are; more spans
    are joined by a shuffle."""
    _, linked = find(docs)
    linked = materialize(linked, "secret-linked")
    size = linked.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    if size["rows"] <= BROADCAST_ROWS and size["spans"] <= 4 * BROADCAST_ROWS:
        linked = F.broadcast(linked)
    text = F.coalesce("text", F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("key"))
    joined = packed.join(linked, "key", "left")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("pieces"))
    body = F.col("_row.text")

    def step(a, s):
        lead = F.when(s["start"] >= a["at"], F.array(F.substr(body, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["pieces"], F.coalesce(lead, F.array().cast("array<string>"))).alias("pieces"))

    end = F.aggregate("spans", state, step)
    cut = joined.withColumn("_end", F.when(F.col("spans").isNotNull(), end))
    new = F.when(F.col("_end").isNotNull(), F.concat(F.concat_ws("", "_end.pieces"), F.substr(body, (F.col("_end.at") + 1).cast("int")))).otherwise(body)
    fields = {c: F.col("_row")[c] for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("_end").isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return cut.select(*[c.alias(n) for n, c in fields.items()])
