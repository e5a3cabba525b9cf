"""Overlapping and gapped intervals to continuous periods and gaps.

Intervals are range-partitioned by entity and start, so that an entity of any
size spreads over as many tasks as it needs.  One pass over each sorted
partition compares a start with the running maximum of the ends before it and
writes the partition's islands.  What the earlier partitions know of an
entity's end is then carried over; only islands at the edge of a partition can
change by that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import scans
from tallyloom.session import write_cut

NO_END = np.iinfo(np.int64).min


def local_islands(sorted_df: DataFrame, keys: list[str]) -> DataFrame:
    """The islands of each partition of (keys, from_ms, upto_ms), sorted by keys and from_ms.

    ``before_ms`` is the end of the island before it of the same entity in the
    same partition, ``pid`` the partition.
    """
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_df.select(*keys).schema)

    def islands(batches):
        pid, held = scans.partition_number(), None  # held: the open island (key, from, upto, before)
        for table in scans.blocks(batches):
            new = scans.starts_of_groups(table, keys, held[0] if held else None)
            begin = table.column("from_ms").to_numpy()
            top = scans.running_max(table.column("upto_ms").to_numpy(), new, held[2] if held else None)
            earlier = np.empty_like(top)
            earlier[1:] = top[:-1]
            earlier[0] = held[2] if held else NO_END
            start = new | (begin > earlier)
            at = np.flatnonzero(start)
            if held is not None:
                # The island that was open ends before this block's first start.
                stop = at[0] if len(at) else len(top)
                upto = int(top[stop - 1]) if stop else held[2]
                if not len(at):
                    held = (held[0], held[1], upto, held[3])
                    continue
                yield from _rows([held[0]], [held[1]], [upto], [held[3]], keys, table, pid)
            ends = top[np.append(at[1:], len(top)) - 1]
            before = np.where(new[at], NO_END, earlier[at])
            done = at[:-1]
            if len(done):
                part = table.select(keys).take(pa.array(done))
                yield from _table(part, begin[done], ends[:-1], before[:-1], pid)
            k = int(at[-1])
            held = (scans.key_at(table, keys, k), int(begin[k]), int(ends[-1]), int(before[-1]))
            schema_of = table
        if held is not None:
            yield from _rows([held[0]], [held[1]], [held[2]], [held[3]], keys, schema_of, pid)

    def _rows(key, begin, upto, before, keys, table, pid):
        columns = [pa.array([k[i] for k in key], table.schema.field(name).type) for i, name in enumerate(keys)]
        yield from _table(pa.table(columns, names=keys), np.array(begin), np.array(upto), np.array(before), pid)

    def _table(part, begin, upto, before, pid):
        out = pa.table({
            **{k: part.column(k) for k in keys}, "from_ms": pa.array(begin, pa.int64()), "upto_ms": pa.array(upto, pa.int64()),
            "before_ms": pa.array(before, pa.int64(), mask=before == NO_END), "pid": pa.array(np.full(len(begin), pid, np.int32)),
        })
        yield from out.to_batches()

    return sorted_df.mapInArrow(islands, f"{head}, from_ms bigint, upto_ms bigint, before_ms bigint, pid int")


def periods_and_gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Continuous periods and the gaps between them: ``keys``, span, from_ms, upto_ms.

    ``df`` has the ``keys`` and the longs ``from_ms`` and ``upto_ms``.  An
    interval counts if both ends are present and its end is after its start;
    intervals that touch form one period; repeated intervals change nothing.
    Null keys form an entity of their own.  Other columns are ignored.  An
    empty input gives no rows.
    """
    valid = df.where((F.col("upto_ms") > F.col("from_ms"))).select(*keys, F.col("from_ms").cast("long"), F.col("upto_ms").cast("long"))
    # The end and a row number as last keys of the ranges let equal starts spread over partitions.
    spread = valid.withColumn("__tie", F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = spread.repartitionByRange(parts, *keys, "from_ms", "upto_ms", "__tie").sortWithinPartitions(*keys, "from_ms").drop("__tie")
    islands = write_cut(local_islands(ranged, keys), "islands").read()

    # Entities in more than one partition: at most one for each edge between two partitions.
    whole = islands.groupBy(*keys).agg(F.min("pid").alias("__a"), F.max("pid").alias("__b"))
    crossing = whole.where("__a < __b").select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    marked = islands.join(F.broadcast(crossing), on, "left").withColumn("__crosses", F.col(f"__{keys[-1]}").isNotNull() if len(keys) == 1 else _any_set(keys))
    marked = marked.drop(*[f"__{k}" for k in keys])
    inside = marked.where(~F.col("__crosses")).select(*keys, "from_ms", "upto_ms", "before_ms")

    edge = marked.where("__crosses").drop("__crosses")
    # One row for each entity and partition: at most two partitions' worth of entities per edge.
    tops = edge.groupBy(*keys, "pid").agg(F.max("upto_ms").alias("__top"))
    earlier = W.partitionBy(*keys).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("pid").alias("__pid"), F.max("__top").over(earlier).alias("__carry"))
    edge = edge.join(F.broadcast(carry), on & (F.col("pid") == F.col("__pid")), "left").drop("__pid", *[f"__{k}" for k in keys])
    edge = edge.withColumn("__starts", F.col("__carry").isNull() | (F.col("from_ms") > F.col("__carry")))
    edge = edge.withColumn("before_ms", F.greatest("before_ms", "__carry"))
    # Inside one partition only the last start can be continued by later partitions,
    # and what an earlier partition absorbs stands before every start.
    last = F.max(F.when(F.col("__starts"), F.col("from_ms"))).over(W.partitionBy(*keys, "pid"))
    edge = edge.withColumn("__last", last)
    settled = edge.where(F.col("__starts") & (F.col("from_ms") < F.col("__last"))).select(*keys, "from_ms", "upto_ms", "before_ms")
    open_ = edge.where(~F.col("__starts") | (F.col("from_ms") == F.col("__last")))
    open_ = open_.groupBy(*keys, "pid", "__starts").agg(F.min("from_ms").alias("from_ms"), F.max("upto_ms").alias("upto_ms"), F.max("before_ms").alias("before_ms"))
    order = W.partitionBy(*keys).orderBy("pid", "__starts").rowsBetween(W.unboundedPreceding, 0)
    open_ = open_.withColumn("__island", F.sum(F.col("__starts").cast("int")).over(order))
    stitched = open_.groupBy(*keys, "__island").agg(
        F.min(F.when(F.col("__starts"), F.col("from_ms"))).alias("from_ms"),
        F.max("upto_ms").alias("upto_ms"),
        F.max(F.when(F.col("__starts"), F.col("before_ms"))).alias("before_ms"),
    )
    periods = inside.unionByName(settled).unionByName(stitched.select(*keys, "from_ms", "upto_ms", "before_ms"))
    spans = F.explode(
        F.when(F.col("before_ms").isNull(), F.array(_span("period", "from_ms", "upto_ms"))).otherwise(
            F.array(_span("period", "from_ms", "upto_ms"), _span("gap", "before_ms", "from_ms"))
        )
    )
    return periods.select(*keys, spans.alias("__s")).select(*keys, "__s.span", "__s.from_ms", "__s.upto_ms")


def _any_set(keys):
    out = F.lit(False)
    for k in keys:
        out = out | F.col(f"__{k}").isNotNull()
    return out


def _span(kind: str, a: str, b: str):
    return F.struct(F.lit(kind).alias("span"), F.col(a).alias("from_ms"), F.col(b).alias("upto_ms"))
