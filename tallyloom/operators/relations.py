"""Owners and inherited copies along session links, from resolved hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.hierarchy import hierarchy


def owners(links: DataFrame) -> DataFrame:
    """node_id, owner_id (the root that a node's work counts for), hops and state.

    ``links``: id, parent.  Nodes on or below a cycle have no owner and state
    ``cycle``.
    """
    found = hierarchy(links, "id", "parent")
    state = F.when(F.col("node_depth") < 0, "cycle").when(F.col("node_depth") == 0, "root").otherwise("owned")
    return found.select("node_id", F.when(F.col("node_depth") >= 0, F.col("root_id")).alias("owner_id"), F.when(F.col("node_depth") >= 0, F.col("node_depth")).cast("int").alias("hops"), state.alias("state"))


def family(links: DataFrame) -> DataFrame:
    """Every root with each node of its tree, itself included: root_id, node_id."""
    return hierarchy(links, "id", "parent").where("node_depth >= 0").select("root_id", "node_id")


def inherited_copies(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records whose call was already counted in an ancestor of their session: record_id.

    ``records``: record_id, session_id, call_id.  The ancestors of each session
    are joined as rows, so a long chain of forks spreads over tasks.
    """
    found = hierarchy(links, "id", "parent").where("node_depth > 0")
    above = found.select("node_id", F.explode(F.slice("ancestors", 1, F.col("node_depth"))).alias("ancestor_id"))
    calls = records.where("call_id is not null").select(F.col("session_id").alias("ancestor_id"), F.col("call_id").alias("c")).distinct()
    asked = records.where("call_id is not null").join(above, F.col("session_id") == F.col("node_id"))
    hit = asked.join(calls, (asked.ancestor_id == calls.ancestor_id) & (asked.call_id == calls.c), "left_semi")
    return hit.select("record_id").distinct()
