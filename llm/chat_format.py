"""Chat formatting of reply trees, in DataFrame operations only.

Messages point at the message they reply to.  Root-to-leaf paths are enumerated by iterative
self-joins that double their reach: after k rounds each message knows its ancestor 2**k replies up,
and a leaf's path is spread over its positions by the binary digits of the distance, so a path of d
messages takes about log2(d) joins and the rows never exceed the paths' own length.  Paths are ranked
by the score of their messages, and each chosen path becomes one formatted conversation.

Template, for each turn: ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts a backslash is
doubled and a control string gets a backslash behind its first character, so no control string of this
template or of common others occurs in them; removing one backslash before each character undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, col

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Openings of control strings of common chat templates.
CONTROL = r"(<)(\||s>|/s>|<SYS|</SYS|start_of_turn|end_of_turn|bos>|eos>)|(\[)(INST|/INST|SYSTEM|AVAILABLE|TOOL)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): for each leaf of each tree, every message on its way to the root.

    ``messages`` has tree, node (unique and not null within all trees) and parent (null at a root).
    A parent that does not exist makes its message a root.  Replies must not form a cycle: messages
    on one have no leaf and no path.  ``up`` is the distance to the leaf.
    """
    nodes = checkpoint(messages.select("tree", "node", "parent"))
    ids = nodes.select(F.col("node").alias("p"))
    jump = checkpoint(nodes.join(ids, F.col("parent") == F.col("p")).select("node", F.col("p").alias("above")))
    leaves = nodes.join(jump.select(F.col("above").alias("p")), F.col("node") == F.col("p"), "left_anti")
    jumps = []
    limit = nodes.count()
    while not jump.isEmpty() and (1 << len(jumps)) <= limit:
        jumps.append(jump)
        further = jump.select(F.col("node").alias("p"), F.col("above").alias("next"))
        jump = checkpoint(jump.join(further, F.col("above") == F.col("p")).select("node", F.col("next").alias("above")))
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        step = jumps[k].select(F.col("node").alias("p"), "above")
        more = paths.join(step, F.col("node") == F.col("p")).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = checkpoint(paths.unionByName(more))
    return paths


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, path_rank, score, formatted, loss): the ``best`` paths of each tree, or all if None.

    ``messages``: tree, node, parent (see ``reply_paths``), role, text, score.  Null roles and texts
    count as empty, null scores as 0.  A path's score is the sum of its messages'; ties go to the
    longer path, then to the smaller leaf.  ``loss`` has (turn_start, start, end) for each turn, code
    points in ``formatted``: the escaped texts of the role assistant are under the loss, and of other
    turns start and end are null.  An empty table gives an empty result; other columns are not read.
    """
    paths = reply_paths(messages)
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    said = messages.select(F.col("node").alias("n"), role.alias("role"), text.alias("text"), (F.col("role") == "assistant").alias("taught"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    size = F.lit(len(TURN + TEXT + END)) + F.length("role") + F.length("text")
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    placed = paths.join(said, F.col("node") == F.col("n")).withColumn("turn_start", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
    start = F.when(F.col("taught"), F.col("turn_start") + len(TURN + TEXT) + F.length("role"))
    turn = F.struct("turn_start", "role", "text", start.alias("start"), (start + F.length("text")).alias("end"))
    whole = placed.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("turns"), F.sort_array(F.collect_list(turn)).alias("path"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("turns"), "leaf")
    whole = whole.withColumn("path_rank", F.row_number().over(order))
    if best is not None:
        whole = whole.where(F.col("path_rank") <= best)
    made = F.array_join(F.transform("path", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))), "")
    loss = F.transform("path", lambda t: F.struct(t["turn_start"].alias("turn_start"), t["start"].alias("start"), t["end"].alias("end")))
    return whole.select("tree", "path_rank", "score", made.alias("formatted"), loss.alias("loss"))


def turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    body = F.filter(F.split(formatted, r"<\|end\|>"), lambda s: F.length(s) > 0)
    cut = F.transform(body, lambda s: F.split(F.substring(s, len(TURN) + 1, 1 << 30), r"<\|text\|>", 2))
    return F.transform(cut, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss, cut out of ``formatted`` by its spans, unescaped, in order.

    Each span is cut from its own turn, so the work stays in proportion to the text.
    """
    cut = F.zip_with(F.split(formatted, r"<\|end\|>"), loss, lambda p, s: F.when(s["start"].isNotNull(), unescape(F.substring(p, (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
    return F.array_join(cut, "")


def linear(conversations: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Messages of conversations without branches: each turn replies to the one before it.

    Rows are ordered by turn (null first), then role and text; repeated rows stay separate turns.
    A null conversation id is a conversation of its own.
    """
    named = conversations.select(col(tree_col).cast("long").alias("tree"), col(turn_col).alias("turn"), col("role").cast("string").alias("role"), col("text").cast("string").alias("text"))
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    place = named.withColumn("i", F.row_number().over(order).cast("long"))
    node = F.struct(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0)).alias("tree"), F.col("i").alias("i"))
    parent = F.when(F.col("i") > 1, F.struct(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0)).alias("tree"), (F.col("i") - 1).alias("i")))
    return place.select("tree", node.alias("node"), parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
