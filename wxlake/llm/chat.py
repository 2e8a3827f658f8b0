"""Conversations from reply trees.

Nodes carry their parent; a path from the root to a leaf is one possible conversation. Paths are enumerated
by iterative self-joins that double their reach: after i rounds each node knows its ancestor 2**i above and
the summed score of the nodes between, so a tree of depth d takes log2(d) joins and no recursion over rows.
Leaves are ranked in their tree by the summed score of their path (ties: the smaller leaf), the best
`branches` are chosen, and only their paths are unfolded, again by doubling, and formatted.

The template writes `<|im_start|>role\\n` text `<|im_end|>\\n` for each turn. Inside roles and texts `\\` becomes `\\\\`
and `<|` becomes `<\\|` (in roles also a line end `\\l`), so a control string in a text can neither open nor close a turn, and reading the
output back restores every text. The loss mask is a list of spans (code points) over the formatted text that
covers exactly the assistants' escaped texts.

Defined cases: a null text or role is empty; a node whose parent is missing is a root; a node in a cycle belongs to no
path; repeated rows are turns of their own; a null conversation id forms a conversation of its own; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

START, END, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    # An escaped backslash is set aside first; NUL and its mark cannot be confused with it, as NUL is set aside too.
    t = F.replace(F.replace(text, F.lit("\x00"), F.lit("\x00z")), F.lit("\\\\"), F.lit("\x00b"))
    t = F.replace(F.replace(t, F.lit("<\\|"), F.lit("<|")), F.lit("\\l"), F.lit("\n"))
    return F.replace(F.replace(t, F.lit("\x00b"), F.lit("\\")), F.lit("\x00z"), F.lit("\x00"))


def chain(turns: DataFrame) -> DataFrame:
    """Nodes of conversations that are given as rows by turn: each row replies to the one before it.

    A conversation's rows meet in one task; it is what a model reads at once, so it is bounded.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", F.row_number().over(w).cast("long").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, branch (1: best), path_score, depth (0: root) and node of the chosen paths.

    nodes: conv_id, node (long, unique in its conversation), parent, score.
    """
    given = nodes.select("conv_id", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = given.select(F.col("conv_id").alias("c"), F.col("node").alias("x")).distinct()
    rooted = given.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("x")), "left").select("conv_id", "node", F.col("x").alias("up"), "score")
    leaves = given.join(given.select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).where("p is not null").distinct(), (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("node") == F.col("p")), "left_anti").select("conv_id", F.col("node").alias("leaf"))
    # jump: the ancestor 2**i above, how many nodes and what score lie from the node to below that ancestor.
    jump = common.settle(rooted.select("conv_id", "node", "up", F.lit(1).cast("long").alias("n"), "score"))
    steps = [jump]
    limit = given.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    while (1 << len(steps)) < 2 * limit and not jump.where("up is not null").isEmpty():
        far = jump.select(F.col("conv_id").alias("c"), F.col("node").alias("x"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("score").alias("score2"))
        both = jump.join(far, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("x")), "left")
        jump = common.settle(both.select("conv_id", "node", F.col("up2").alias("up"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score")))
        steps.append(jump)
    whole = jump.where("up is null").select(F.col("conv_id").alias("c"), F.col("node").alias("x"), "n", F.col("score").alias("path_score"))
    best = Window.partitionBy("conv_id").orderBy(F.col("path_score").desc(), "leaf")
    chosen = leaves.join(whole, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("leaf") == F.col("x"))).select("conv_id", "leaf", "n", "path_score")
    chosen = common.settle(chosen.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches))
    front = chosen.select("conv_id", "branch", "path_score", F.col("leaf").alias("node"), (F.col("n") - 1).alias("depth"))
    for i, step in reversed(list(enumerate(steps))):
        up = step.where("up is not null").select(F.col("conv_id").alias("c"), F.col("node").alias("x"), "up")
        more = front.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("x"))).select("conv_id", "branch", "path_score", F.col("up").alias("node"), (F.col("depth") - (1 << i)).alias("depth"))
        front = common.settle(front.unionByName(more))
    return front


def formatted(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, branch, path_score, formatted text and loss_spans (start, end) of each chosen path.

    nodes: conv_id, node, parent, role, text, score.
    """
    path = paths(nodes, branches)
    texts = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("x"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("x")))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    turns = turns.select("conv_id", "branch", "path_score", "depth", F.concat(head, escaped(F.col("text")), F.lit(END + "\n")).alias("part"), F.char_length(head).alias("lead"), F.char_length(escaped(F.col("text"))).alias("body"), (F.col("role") == LEARNT).alias("learnt"))
    size = F.char_length("part")
    w = Window.partitionBy("conv_id", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(size).over(w), F.lit(0)))
    listed = placed.groupBy("conv_id", "branch", "path_score").agg(F.array_sort(F.collect_list(F.struct("depth", "part", F.when(F.col("learnt"), F.struct((F.col("at") + F.col("lead")).alias("start"), (F.col("at") + F.col("lead") + F.col("body")).alias("end"))).alias("span")))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["span"].isNotNull()), lambda x: x["span"])
    return listed.select("conv_id", "branch", "path_score", F.array_join(F.transform("t", lambda x: x["part"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(output: DataFrame) -> DataFrame:
    """The turns (array of role, text) and the unescaped text under the loss mask, from formatted() alone."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    turns = F.transform(parts, lambda p: F.struct(unescaped(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return output.select("*", turns.alias("turns"), F.array_join(masked, "").alias("learnt"))
