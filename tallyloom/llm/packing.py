"""Filling containers of fixed capacity with whole texts.

Best fit with the largest items first.  Bins are kept by what is left in them,
as one bit mask over all residuals, so that the tightest bin that takes an item
is the lowest set bit from the item's size on.  A bin carries the sources and
the clusters of equal texts in it; it does not take an item whose cluster it
holds already, nor one whose source may not stand beside one of its own.  The
search goes on to the next larger residual until a bin fits.

Items are packed in groups of a bounded size.  Bins that a group leaves with
much unused space, a few of each group, are opened again and packed together
with those of other groups, in rounds until one group is left.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut, write_cut

#: Items of one group in the first round, and groups that a later round puts together.
GROUP_ITEMS = 20_000
MERGED_GROUPS = 64
#: Bins with more than this share unused are opened again while there are several groups; of all others the share bounds the waste.
LOOSE = 0.02


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int, conflicts: dict[int, int]) -> list[int]:
    """The bin number of each item.

    ``sizes`` lie between 1 and ``capacity``.  Items of equal non-negative
    ``clusters`` never share a bin; -1 is no cluster.  ``conflicts`` gives for
    a source the bit mask of the sources that must not be in its bin.
    """
    where = [-1] * len(sizes)
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    held_sources: list[int] = []
    held_clusters: list[int] = []
    mask = 0
    # Copies of one text have one size and need different bins: one sweep over the residuals serves them all.
    batches: dict[tuple, list[int]] = {}
    for i, (size, cluster) in enumerate(zip(sizes, clusters)):
        batches.setdefault((size, cluster, i if cluster < 0 else -1), []).append(i)
    for (size, cluster, _), items in sorted(batches.items(), key=lambda b: (-b[0][0], b[1][0])):
        bit = 1 << cluster if cluster >= 0 else 0
        waiting = items
        moved: list[tuple[int, int]] = []
        rest = mask >> size
        base = size
        while waiting and rest:
            step = (rest & -rest).bit_length() - 1
            base += step
            stack, kept = by_residual[base], []
            while stack and waiting:
                b = stack.pop()
                taken = None
                if not held_clusters[b] & bit:
                    taken = next((i for i in reversed(waiting) if not held_sources[b] & conflicts.get(sources[i], 0)), None)
                if taken is None:
                    kept.append(b)
                    continue
                waiting.remove(taken) if taken != waiting[-1] else waiting.pop()
                where[taken] = b
                held_sources[b] |= 1 << sources[taken]
                held_clusters[b] |= bit
                moved.append((b, base - size))
            stack.extend(reversed(kept))
            if not stack:
                mask &= ~(1 << base)
            rest >>= step + 1
            base += 1
        for i in waiting:
            b = len(held_sources)
            held_sources.append(1 << sources[i])
            held_clusters.append(bit)
            where[i] = b
            moved.append((b, capacity - size))
        for b, residual in moved:
            if residual:
                by_residual[residual].append(b)
                mask |= 1 << residual
    return where


def _pack_group(frame: pd.DataFrame, conflicts: dict[int, int]) -> pd.Series:
    capacity = int(frame["capacity"].iloc[0])
    ordered = frame.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True])
    # Clusters with one member in the group need no bit.
    codes, _ = pd.factorize(ordered["cluster"])
    counts = pd.Series(codes).map(pd.Series(codes).value_counts())
    several = pd.factorize(pd.Series(codes).where(counts > 1))[0]
    bins = best_fit(ordered["n_tokens"].tolist(), several.tolist(), ordered["source_no"].tolist(), capacity, conflicts)
    return pd.Series(bins, index=ordered.index)


_OUT = "limit_name string, capacity long, grp long, bin long, doc_id long, part_no int, n_tokens long, source_no int, cluster long"


def pack(items: DataFrame, limits: DataFrame, source_conflicts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Containers of every limit: limit_name, container_id, doc_id, part_no, n_tokens.

    ``items``: doc_id, source, n_tokens, cluster (equal for copies of one
    text).  ``limits``: limit_name, capacity_tokens.  A text longer than a
    container is cut into full containers and one rest; no other is split.
    Copies of one text stand in different containers.  ``source_conflicts``
    lists pairs of sources that must not share a container.  Texts without a
    token (null, empty) are in no container; limits that are null or below 1
    give no rows; null sources are a source of their own.
    """
    spark = items.sparkSession
    names = sorted({s for pair in source_conflicts or () for s in pair})
    number = {s: i + 1 for i, s in enumerate(names)}
    conflicts: dict[int, int] = defaultdict(int)
    for a, b in source_conflicts or ():
        conflicts[number[a]] |= 1 << number[b]
        conflicts[number[b]] |= 1 << number[a]
    conflicts = dict(conflicts)
    source_no = F.lit(0)
    for s, i in number.items():
        source_no = F.when(F.col("source") == s, i).otherwise(source_no)
    sized = items.where("n_tokens > 0").select("doc_id", "source", "n_tokens", "cluster")
    groups = max(1, -(-sized.count() // GROUP_ITEMS))
    # The limits are a fixed table of parameters; every text is measured against each of them.
    wanted = limits.where("capacity_tokens >= 1 and limit_name is not null").select("limit_name", F.col("capacity_tokens").cast("long").alias("capacity")).collect()
    each = F.array(*[F.struct(F.lit(r.limit_name).alias("limit_name"), F.lit(r.capacity).cast("long").alias("capacity")) for r in wanted])
    measured = sized.withColumn("limit", F.explode(each.cast("array<struct<limit_name:string,capacity:bigint>>"))).select("limit.*", *sized.columns)
    pieces = measured.withColumn("part_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int"))))
    pieces = pieces.select(
        "limit_name", "capacity", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("grp"), "doc_id", "part_no",
        F.least(F.col("capacity"), F.col("n_tokens") - F.col("part_no") * F.col("capacity")).alias("n_tokens"), source_no.cast("int").alias("source_no"), "cluster",
    )
    full = pieces.where("n_tokens = capacity").select("limit_name", F.concat_ws("-", F.lit("full"), "doc_id", "part_no").alias("container_id"), "doc_id", "part_no", "n_tokens")
    # Rounds: bins that a round leaves with much space are opened again, with those of MERGED_GROUPS groups together, until all groups were one.
    out, waiting, number = full, pieces.where("n_tokens < capacity"), 0
    while True:
        packed = write_cut(_packed(waiting, conflicts), "packed")
        filled = packed.read().groupBy("limit_name", "grp", "bin").agg(F.sum("n_tokens").alias("used"))
        judged = packed.read().join(filled, ["limit_name", "grp", "bin"]).withColumn("loose", F.lit(groups > 1) & (F.col("used") < (1 - LOOSE) * F.col("capacity")))
        judged = cut(judged, "judged")
        packed.drop()
        out = out.unionByName(judged.where("not loose").select("limit_name", F.concat_ws("-", F.lit(str(number)), "grp", "bin").alias("container_id"), "doc_id", "part_no", "n_tokens"))
        if groups == 1:
            return out
        groups, number = -(-groups // MERGED_GROUPS), number + 1
        waiting = judged.where("loose").select("limit_name", "capacity", F.expr(f"grp div {MERGED_GROUPS}").alias("grp"), "doc_id", "part_no", "n_tokens", "source_no", "cluster")


def _packed(pieces: DataFrame, conflicts: dict[int, int]) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(bin=_pack_group(frame, conflicts))[["limit_name", "capacity", "grp", "bin", "doc_id", "part_no", "n_tokens", "source_no", "cluster"]]

    return pieces.groupBy("limit_name", "grp").applyInPandas(run, _OUT)


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """For each limit: containers, tokens, the least number of containers and the share of space used."""
    used = packed.groupBy("limit_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    out = used.join(limits, "limit_name")
    return out.select("limit_name", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
