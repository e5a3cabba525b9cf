"""Reachability and connected groups of edge tables, by joins until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import write_cut


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Every node that a start leads to, with the fewest steps: node, steps.

    ``edges``: src, dst.  ``starts``: node.  Each round joins only the nodes
    found in the round before.
    """
    links = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    found = write_cut(starts.select("node").where("node is not null").distinct().withColumn("steps", F.lit(0)), "found")
    front, parts, step = found.read(), [found], 0
    while True:
        step += 1
        seen = parts[0].read()
        for p in parts[1:]:
            seen = seen.unionByName(p.read())
        new = front.join(links, front.node == links.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(step))
        table = write_cut(new, "found")
        front = table.read()
        if front.isEmpty():
            return seen
        parts.append(table)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The connected group of every node: node, grp (the smallest node of the group).

    ``edges``: src, dst, taken both ways.  ``nodes``: node.  Large-star and
    small-star steps alternate until the links stand still, which takes a
    number of rounds that grows with the logarithm of the nodes.
    """
    links = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    table = write_cut(links, "links")
    while True:
        e = table.read()
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("k"), F.least("src", "m").alias("m"))
        # Large star: greater neighbours are linked to the smallest one.
        large = both.where("dst > src").join(low, F.col("src") == F.col("k")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        # Small star: smaller neighbours and the node itself are linked to the smallest one.
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        small = down.groupBy("src").agg(F.min("dst").alias("m"))
        linked = down.join(small, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(small.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
        next_ = write_cut(linked, "links")
        same = next_.read().exceptAll(e).isEmpty() and e.exceptAll(next_.read()).isEmpty()
        table.drop()
        table = next_
        if same:
            break
    group = table.read().groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("g"))
    return nodes.where("node is not null").select("node").distinct().join(group, "node", "left").select("node", F.coalesce("g", "node").alias("grp"))
