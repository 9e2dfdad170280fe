"""Chat formatting of reply trees (DataFrame functions only).

Messages form trees (message, parent).  Iterative self-joins double each message's jump pointer, so a tree of depth d
takes log2(d) rounds: they give every leaf its depth and score, the best leaves of a tree are its chosen branches, and
the same pointers then enumerate the messages of each chosen root-to-leaf path, which become one conversation.

Template: ``<|role|>`` role ``<|text|>`` text ``<|end|>`` per turn.  Inside roles and texts a backslash is doubled and
a backslash is put after the first character of each control string, so no text can hold a marker, and one pass of
``unescape`` gives the text back.

Defined results: a null text or role is the empty text or role; a null conversation id is a conversation of its own; rows
that repeat a turn number follow each other by role, then text; a parent that does not exist makes its child a root; a
message in a cycle has no root and is in no path; branches of equal score go by depth, then by their leaf; very long texts are
formatted whole; an empty table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm.common import materialize

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: FIXED VALUES: control strings that must not survive inside a text (own markers and those of common templates).
CONTROL = r"(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])"


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(c, CONTROL, r"$1$3\\$2$4")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def turn_string(role: Column, text: Column) -> Column:
    return F.concat(F.lit(ROLE), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def chain(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row answers the one before it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    w = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(F.col("conv_id").alias("tree"), "turn", role.alias("role"), text.alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(w).cast("long"))
    return numbered.select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _lookup(rows: DataFrame, by: str, found: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to the ``found`` (_t, _n, ...) of the same tree whose node is ``rows``' column ``by``."""
    return rows.join(found, F.col("tree").eqNullSafe(F.col("_t")) & (F.col(by) == F.col("_n")), how)


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree, one formatted conversation per path.

    ``messages``: tree, node, parent, role, text, score.  A path's score is the mean of its messages' scores; ties go to
    the longer path, then the smaller leaf.  Returns tree, leaf, branch (from 1), n_turns, formatted and ``mask``: the
    (start, length) spans, in code points of ``formatted``, under the loss mask (the assistant's escaped texts).
    """
    nodes = materialize(messages, "chat-nodes")
    tree, node = F.col("tree").alias("_t"), F.col("node").alias("_n")
    known = _lookup(nodes.select("tree", "node", "parent", "score"), "parent", nodes.select(tree, node), "left")
    state = materialize(known.select("tree", "node", F.col("_n").alias("jump"), F.lit(1).cast("long").alias("depth"),
                                     F.coalesce("score", F.lit(0.0)).alias("score")), "chat-jump")
    inner = state.where("jump is not null").select(tree, F.col("jump").alias("_n")).distinct()
    jumps = [state]
    size = nodes.count()
    while True:
        shortest = state.where("jump is not null").agg(F.min("depth")).first()[0]
        if shortest is None or shortest > size:  # all are rooted, but for messages in a cycle
            break
        further = state.select(tree, node, F.col("jump").alias("_j"), F.col("depth").alias("_d"), F.col("score").alias("_s"))
        moved = _lookup(state.where("jump is not null"), "jump", further).select(
            "tree", "node", F.col("_j").alias("jump"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("score") + F.col("_s")).alias("score"))
        state = materialize(state.where("jump is null").unionByName(moved), "chat-jump")
        jumps.append(state)
    rooted = state.where("jump is null")
    leaves = _lookup(rooted, "node", inner, "left_anti")
    w = Window.partitionBy("tree").orderBy((F.col("score") / F.col("depth")).desc(), F.col("depth").desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(w)).where(F.col("branch") <= branches)
    paths = chosen.select("tree", F.col("node").alias("leaf"), "branch", "node", F.lit(0).cast("long").alias("back"))
    for k, jump in enumerate(jumps[:-1]):
        further = _lookup(paths, "node", jump.where("jump is not null").select(tree, node, F.col("jump").alias("_j")))
        paths = paths.unionByName(further.select("tree", "leaf", "branch", F.col("_j").alias("node"), (F.col("back") + 2**k).alias("back")))
        paths = materialize(paths, "chat-paths")
    turns = _lookup(paths, "node", nodes.select(tree, node, "role", "text")).select(
        "tree", "leaf", "branch", "back", "role",
        turn_string(F.col("role"), F.col("text")).alias("turn"), F.length(escape(F.col("text"))).alias("chars"))
    done = turns.groupBy("tree", "leaf", "branch").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "turn", "chars"))).alias("turns"))
    return done.select(
        "tree", "leaf", "branch", F.size("turns").alias("n_turns"), F.concat_ws("", F.col("turns.turn")).alias("formatted"),
        _mask(F.col("turns")).alias("mask"))


def _mask(turns: Column) -> Column:
    """Spans of the assistant's texts.  The running length walks the turns; only the assistant's spans are kept."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a, t):
        end = a["at"] + F.length(t["turn"])
        span = F.struct((end - len(END) - t["chars"]).alias("start"), t["chars"].alias("length"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def read_back(formatted: Column) -> Column:
    """Turns (role, text) parsed from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")
    body = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(ROLE) + 1)), r"<\|text\|>", -1))
    return F.transform(body, lambda b: F.struct(unescape(F.get(b, 0)).alias("role"), unescape(F.get(b, 1)).alias("text")))


def digest(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them: turns and the text under the loss mask."""
    turns = read_back(F.col("formatted"))
    loss = F.concat_ws("", F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["length"]))))
    df = chats.select(F.col("tree").alias("conv_id"), turns.alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"))
