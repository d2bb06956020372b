"""Chat formatting of reply trees, with DataFrame operations only.

Messages of a tree know their parent. Self-joins double the known distance to an
ancestor (1, 2, 4, ...), so a path of d messages takes log2(d) rounds; they sum depth
and score on the way. Leaves are ranked within their tree by the score of their path,
and the chosen ones are enumerated down the same tables of ancestors: every set of
powers of two leads to one ancestor, so each message of a path is produced once.

Template, for each message: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings
inside roles and texts get a backslash after their first character, and those that
have backslashes there get one more, which unescaping takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize
from .text import as_column

#: The template's marks, and what else must not stand in a text.
START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Fixed value: the tails of the control strings above, after their first character.
_TAILS = r"(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
_ESCAPE = (r"([<\[])(\\*)" + _TAILS, r"$1\\$2$3")
_UNESCAPE = (r"([<\[])\\(\\*)" + _TAILS, r"$1$2$3")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *_ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *_UNESCAPE)


def escape_role(role: Column) -> Column:
    """Roles also lose their line ends, as the first one ends the role."""
    return escape(F.replace(F.replace(role, F.lit("~"), F.lit("~t")), F.lit("\n"), F.lit("~n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("~n"), F.lit("\n")), F.lit("~t"), F.lit("~"))


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of 2^k-th ancestors, and (tree, node, depth, total score) of every node.

    nodes: tree, node, parent, score. A parent that is null or not in the tree makes a
    root. A round joins only messages whose root isn't reached yet, so short branches
    cost nothing while long ones go on. A cycle of parents raises ValueError.
    """
    here = nodes.select("tree", F.col("node").alias("parent"), F.lit(1).alias("there"))
    state = nodes.join(here, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there") == 1, F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    levels = [materialize(state, "ancestors")]
    rounds = levels[0].count().bit_length()
    done = levels[0].filter("up is null")
    while levels[-1].filter("up is not null").limit(1).count():
        if len(levels) > rounds:
            raise ValueError("a message is its own ancestor")
        going = levels[-1].filter("up is not null")
        high = done.unionByName(going).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("gain"))
        step = going.join(high, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("gain")).alias("total"))
        levels.append(materialize(step, "ancestors"))
        done = done.unionByName(levels[-1].filter("up is null"))
    return levels, done.select("tree", "node", "depth", "total")


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, score, node, back): messages of each tree's best branches.

    A branch's score is the sum of its messages'; ties go to the longer branch, then
    to the lesser leaf. ``back`` counts the messages between a message and the leaf.
    """
    nodes = materialize(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    levels, known = ancestors(nodes)
    inner = nodes.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()
    leaves = known.join(inner, ["tree", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node"))
    path = leaves.withColumn("rank", rank).filter(F.col("rank") <= branches).select("tree", "node", F.col("node").alias("leaf"), F.col("total").alias("branch_score"), F.lit(0).cast("long").alias("back"))
    for k in range(len(levels) - 2, -1, -1):
        jump = levels[k].filter("up is not null").select("tree", "node", "up")
        here = F.struct("node", "back")
        there = F.struct(F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        path = path.join(jump, ["tree", "node"], "left").select("tree", "leaf", "branch_score", F.inline(F.array_compact(F.array(here, F.when(F.col("up").isNotNull(), there)))))
    return path.select("tree", "leaf", F.col("branch_score").alias("score"), "node", "back")


def format_trees(messages: DataFrame, branches: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each chosen branch: tree, leaf, score, n_turns, formatted, loss_mask.

    messages: tree (string), node (unique in its tree), parent, score, role, text. Null
    roles, texts and scores count as empty or 0. ``loss_mask`` has for each turn its
    place in ``formatted`` and the span (start, end, in code points) of the text that
    is learned, empty for other roles than ``learn``. An empty table gives no rows.
    """
    messages = materialize(messages.select("tree", "node", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "conversations")
    chosen = paths(messages, branches).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    turns = chosen.select("tree", "leaf", "score", "back", head.alias("head"), body.alias("body"), F.col("role").isin(*learn).alias("learn"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = W.partitionBy("tree", "leaf").orderBy(F.desc("back"))
    at = (F.sum(F.length("piece")).over(order) - F.length("piece")).cast("long")
    start = F.col("at") + F.length("head")
    span = F.struct("at", start.alias("start"), F.when(F.col("learn"), start + F.length("body")).otherwise(start).alias("end"))
    turns = turns.withColumn("at", at).select("tree", "leaf", "score", F.struct("at", "piece", span.alias("span")).alias("turn"))
    joined = turns.groupBy("tree", "leaf").agg(F.max("score").alias("score"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return joined.select("tree", "leaf", "score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.transform("turns", lambda t: t["span"]).alias("loss_mask"))


def chains(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", score: Column | None = None) -> DataFrame:
    """Messages for ``format_trees`` from conversations in which each turn answers the last.

    Turns are in the order of turn, then role, then text, nulls first; repeated rows
    stay. Rows with a null conversation are one conversation.
    """
    key = F.coalesce(F.concat(F.lit("="), as_column(conv_id).cast("string")), F.lit(""))
    src = rows.select(key.alias("tree"), as_column(turn).alias("turn"), as_column(role).alias("role"), as_column(text).alias("text"), (F.lit(1.0) if score is None else score).alias("score"))
    src = src.withColumn("node", F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return src.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "score", "role", "text")


def read_back(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, turns (role, text) and learned texts, from the template's text."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.col("n_turns").cast("int"), F.lit(1)))
    work = formatted.withColumn("pieces", pieces)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - 2 - len(END))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    # a piece lacks the mark that it was split at
    learned = F.zip_with("pieces", "loss_mask", lambda p, m: F.when(m["end"] > m["start"], unescape(F.substring(p, (m["start"] - m["at"] - len(START) + 1).cast("int"), (m["end"] - m["start"]).cast("int")))))
    return work.select(*keep, F.transform("pieces", turn).alias("turns"), F.array_compact(learned).alias("learned"))


def digests(formatted: DataFrame) -> DataFrame:
    """tree, and counts and digests of what is read back from the formatted text."""
    back = read_back(formatted, ["tree", "n_turns", F.length("formatted").cast("long").alias("formatted_chars")])
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return back.select("tree", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
