"""Parent-child rows to full hierarchies by tree contraction.

Each round splices out an independent set of nodes with one child (unary
chains get shorter by a constant factor) and rakes all leaves.  Every removal
is recorded with the node that it hangs from and the ids between the two.
Reversing the rounds gives each removed node its root, depth and path from
nodes that are already resolved.  A cycle never runs out of children: it is
spliced down to one node that is its own parent, whose record names the
members of the cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.session import Written, write_cut

#: Recorded rounds that are reversed in one run.
ROUNDS_AT_ONCE = 3


def _round(edges: DataFrame, number: int) -> DataFrame:
    """One contraction: the rows of ``edges`` with ``gone`` set for those that it removes.

    edges: id, parent (null for a root), between (ids from below parent down to above id).
    A node with one child is spliced out if its number of this round is
    smaller than that of its parent and of its child.  Only ids are joined
    with ids, never children with their parent, so a node with very many
    children weighs no more than any other.
    """
    children = edges.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("only"))
    counted = edges.join(children, edges.id == children.k, "left").select("id", "parent", "between", F.coalesce("n", F.lit(0)).alias("n"), "only")
    rank = lambda c: F.xxhash64(F.col(c), F.lit(number))
    spliced = (F.col("n") == 1) & F.col("parent").isNotNull() & (F.col("parent") != F.col("id")) & (rank("id") < rank("parent")) & (rank("id") < rank("only"))
    counted = counted.withColumn("spliced", F.coalesce(spliced, F.lit(False)))
    over = counted.where("spliced").select(F.col("only").alias("k"), F.col("id").alias("k_id"), F.col("parent").alias("k_parent"), F.col("between").alias("k_between"))
    moved = counted.join(over, counted.id == over.k, "left")
    jumped = F.col("k").isNotNull()
    return moved.select(
        "id",
        F.when(jumped, F.col("k_parent")).otherwise(F.col("parent")).alias("parent"),
        F.when(jumped, F.concat("k_between", F.array("k_id"), "between")).otherwise(F.col("between")).alias("between"),
        (F.col("spliced") | (F.col("n") == 0)).alias("gone"),
    )


def hierarchy(df: DataFrame, node: str, parent: str) -> DataFrame:
    """Root, depth and path of every node: node_id, root_id, node_depth, ancestors (array from the root to the node).

    ``df`` has the text columns ``node`` and ``parent``; a parent that is null
    or that is no node of ``df`` makes a root.  Rows with a null node are left
    out; of repeated nodes the row with the smallest parent counts, a null
    parent last.  A node on a cycle gets depth -1, a node below a cycle -2, both with null
    root and ancestors.  Trees may be of any depth.  An empty table gives no
    rows; other columns of ``df`` are left out.
    """
    nodes = df.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(parent).alias("p"))
    known = nodes.select(F.col("id").alias("k"))
    linked = nodes.join(known, nodes.p == known.k, "left").select("id", F.col("k").alias("parent"))
    live = linked.withColumn("between", F.array().cast("array<string>"))
    removed: list[Written] = []
    first = start = write_cut(live, "links")
    live = start.read()
    while True:
        done = _round(live, len(removed))
        # One run counts what is left while it writes; a cycle's last node is its own parent.
        seen = Observation()
        loop = F.coalesce(F.col("parent") == F.col("id"), F.lit(False))
        left = F.when(~F.col("gone"), F.lit(1))
        table = write_cut(done.observe(seen, F.count(left).alias("n"), F.count(F.when(loop, left)).alias("loops")), "round")
        if first is not None:
            first.drop()
            first = None
        removed.append(table)
        live = table.read().where("not gone").drop("gone")
        if seen.get["n"] == seen.get["loops"]:
            return _expand(removed, live)


def _expand(removed: list[Written], rest: DataFrame) -> DataFrame:
    """Reverses the recorded rounds, the last one first."""
    # What is left are single nodes of cycles that are their own parents.
    on_cycle = rest.select(F.explode(F.concat("between", F.array("id"))).alias("node"))
    parts = [write_cut(rest.select("id", F.lit(-2).alias("depth"), F.lit(None).cast("array<string>").alias("path")), "resolved")]
    for first in range(len(removed), 0, -ROUNDS_AT_ONCE):
        # Some rounds in one run; each joins what is written with what the rounds after it resolve.
        block: DataFrame | None = None
        for table in reversed(removed[max(0, first - ROUNDS_AT_ONCE) : first]):
            have = _union(parts) if block is None else _union(parts).unionByName(block)
            fresh = _attached(table.read().where("gone"), have)
            block = fresh if block is None else block.unionByName(fresh)
        parts.append(write_cut(block, "resolved"))
    for table in removed[:-1]:
        table.drop()
    every = _union(parts)
    marked = every.join(on_cycle, every.id == on_cycle.node, "left")
    return marked.select(
        F.col("id").alias("node_id"),
        F.element_at("path", 1).alias("root_id"),
        F.when(F.col("node").isNotNull(), F.lit(-1)).otherwise(F.col("depth")).alias("node_depth"),
        F.col("path").alias("ancestors"),
    )


def _attached(gone: DataFrame, have: DataFrame) -> DataFrame:
    """Depth and path of removed nodes from those of the nodes that they hang from."""
    above = have.select(F.col("id").alias("k"), F.col("depth").alias("k_depth"), F.col("path").alias("k_path"))
    up = gone.join(above, gone.parent == above.k, "left")
    below = F.col("k_depth") < 0
    return up.select(
        "id",
        F.when(F.col("parent").isNull(), F.lit(0)).when(below, F.lit(-2)).otherwise(F.col("k_depth") + F.size("between") + 1).alias("depth"),
        F.when(F.col("parent").isNull(), F.array("id")).when(~below, F.concat("k_path", "between", F.array("id"))).alias("path"),
    )


def _union(parts: list[Written]) -> DataFrame:
    out = parts[0].read()
    for part in parts[1:]:
        out = out.unionByName(part.read())
    return out


def descendants(found: DataFrame) -> DataFrame:
    """Every (ancestor_id, node_id, distance) of the trees in a result of ``hierarchy``; nodes of cycles have none."""
    above = found.where(F.col("node_depth") > 0).select("node_id", "node_depth", F.posexplode(F.slice("ancestors", 1, F.col("node_depth"))).alias("at", "ancestor_id"))
    return above.select("ancestor_id", "node_id", (F.col("node_depth") - F.col("at")).cast("int").alias("distance"))


def session_links(sessions: DataFrame) -> DataFrame:
    """(id, parent) of sessions: only children of a task have a parent, forks and others are roots."""
    child = F.col("task_type").isin("subagent_child", "workflow_child")
    return sessions.select("id", F.when(child, F.col("parent_id")).alias("parent"))


def session_hierarchy(sessions: DataFrame) -> DataFrame:
    """session_id, root_id, node_depth, node_path of every distinct session."""
    found = hierarchy(session_links(sessions), "id", "parent")
    return found.select(
        F.col("node_id").alias("session_id"), F.coalesce("root_id", F.lit("")).alias("root_id"), F.col("node_depth").cast("int").alias("node_depth"),
        F.coalesce(F.array_join("ancestors", "/"), F.lit("")).alias("node_path"),
    )
