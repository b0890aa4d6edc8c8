"""Chat formatting of reply trees, in DataFrame operations only.

Nodes point to their parents. Iterative self-joins double the distance of every node's
pointer until all of them have passed the root, summing scores and depths on the way
(log2 of the depth rounds). Leaves are ranked by the mean score of their path; the paths
of the best ones are read back through the stored pointers, and each becomes one
conversation with a mask over the texts that training may learn from.

Template, one unit per turn: `<s>[INST] role [/INST]text</s>`. Inside roles and texts
every backslash is doubled and a backslash is set behind the first character of each
control string, so the four control strings occur as marks only and unescaping (drop a
backslash, keep what follows) gives the original back.

Defined results: null roles and texts are empty; a parent that is null or missing makes a
root; nodes on a cycle of parents belong to no path; a null tree is a tree of its own;
ties between leaves go to the smaller leaf; `turns_as_chain` numbers repeated rows one by
one, and of other repeated (tree, node) rows the smallest (parent, role, text) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswise.sources.storage import cut_lineage

OPEN, SPLIT, CLOSE = "<s>[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_as_chain(rows: DataFrame) -> DataFrame:
    """Nodes of conversations given by turn: each row replies to the one before it.
    Equal turns are ordered by role and text."""
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select(F.col("conv_id").alias("tree"), turn.alias("node"), F.when(turn > 1, turn - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, branch_rank, branch_score, node, position, role, text) of the best
    root-to-leaf paths of each tree, by mean score. `nodes` is stored first."""
    one = F.row_number().over(Window.partitionBy("tree", "node").orderBy("parent", "role", "text"))
    nodes = nodes.select("tree", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), one.alias("copy"))
    nodes = cut_lineage(nodes.where("copy = 1 and node is not null").drop("copy"))
    slim = nodes.select("tree", "node", "parent", "score")
    ids = slim.select(F.col("tree").alias("tree2"), F.col("node").alias("known"))
    linked = slim.join(ids, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("parent") == F.col("known")), "left")
    state = cut_lineage(linked.select("tree", "node", F.col("known").alias("up"), "score", F.lit(1).cast("long").alias("depth")))
    jumps = []
    sizes = slim.groupBy("tree").agg(F.count("*").alias("size")).select(F.col("tree").alias("tree3"), "size")
    while state.where("up is not null").limit(1).count():
        # Nodes that have passed the root rest; only the others are joined again.
        active = state.where("up is not null")
        jumps.append(active.select("tree", F.col("node").alias("at"), "up"))
        above = state.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        met = active.join(above, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("up") == F.col("node2")), "left")
        doubled = met.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        # On a cycle pointers never end: depths beyond the tree's own size give it away.
        doubled = doubled.join(sizes, F.col("tree").eqNullSafe(F.col("tree3"))).where("depth <= size").drop("tree3", "size")
        state = cut_lineage(state.where("up is null").unionByName(doubled))
    parents = slim.where("parent is not null").select(F.col("tree").alias("tree2"), F.col("parent").alias("node2")).distinct()
    leaves = state.where("up is null").join(parents, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("node") == F.col("node2")), "left_anti")
    mean = F.col("score") / F.col("depth")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(mean.desc(), "node"))
    chosen = leaves.select("tree", F.col("node").alias("leaf"), mean.alias("branch_score"), "depth", rank.alias("branch_rank")).where(F.col("branch_rank") <= per_tree)
    walk = cut_lineage(chosen.withColumn("at", F.col("leaf")).withColumn("back", F.lit(0).cast("long")))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("tree").alias("tree2"), F.col("at").alias("at2"), "up")
        up = walk.join(jump, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("at") == F.col("at2")))
        # Stored: each round reads the walk twice, which would double the plan every time.
        walk = cut_lineage(walk.unionByName(up.drop("tree2", "at2", "at").withColumn("back", F.col("back") + 2**k).withColumnRenamed("up", "at")))
    texts = nodes.select(F.col("tree").alias("tree2"), "node", "role", "text")
    full = walk.join(texts, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("at") == F.col("node")))
    return full.select("tree", "leaf", "branch_rank", "branch_score", "node", (F.col("depth") - 1 - F.col("back")).alias("position"), "role", "text")


def format_paths(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per path: tree, leaf, branch_rank, branch_score, n_turns, formatted and the
    loss mask, spans (start, length) in code points over the texts of the role `learn`."""
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    unit = paths.withColumn("head", F.concat(F.lit(OPEN), role, F.lit(SPLIT))).withColumn("body", text)
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    before = Window.partitionBy("tree", "leaf").orderBy("position")
    start = F.sum(size).over(before) - len(CLOSE) - F.char_length("body")
    unit = unit.withColumn("start", start).withColumn("learned", F.coalesce(F.col("role") == learn, F.lit(False)))
    turn = F.struct("position", F.concat("head", "body", F.lit(CLOSE)).alias("unit"), "learned", "start", F.char_length("body").alias("length"))
    whole = unit.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.select(
        "tree", "leaf", "branch_rank", "branch_score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["unit"]), "").alias("formatted"), spans.alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    units = F.filter(F.split(formatted, CLOSE), lambda u: u.startswith(OPEN))
    part = lambda u, n: unescape(F.regexp_extract(u, r"(?s)^<s>\[INST\] (.*?) \[/INST\](.*)$", n))
    return F.transform(units, lambda u: F.struct(part(u, 1).alias("role"), part(u, 2).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """Unescaped text under the mask, span after span."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")
