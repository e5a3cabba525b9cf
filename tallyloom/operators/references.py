"""References to records that do not exist, were deleted or came in later.

Keys are hashed and the hash space is cut into ranges of equal width, as many
as the rows need.  Each range's parents become sorted arrays; batches of
references probe them by binary search.  A range in which one key is referred
to by very many rows is probed by several tasks, each with a copy of that
range's parents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import has_text, utc_month
from tallyloom.session import cut

#: References and parents that one range holds about; the number of ranges follows the data.
ROWS_PER_SLOT = 200_000
#: Busy ranges up to this number are sent to all tasks, more are joined by shuffle.
BROADCAST_RANGES = 500_000


def composite_key(*parts: str) -> Column:
    """One text for several key columns; equal only if all parts are equal.  Null if a part is null."""
    if len(parts) == 1:
        return F.col(parts[0]).cast("string")
    head = [F.concat(F.length(F.col(p).cast("string")).cast("string"), F.lit(":"), F.col(p).cast("string")) for p in parts[:-1]]
    return F.concat(*head, F.col(parts[-1]).cast("string"))


def _range(h: Column, bits: int) -> Column:
    """The range of the hash space that a hash lies in, of 2^bits ranges of equal width."""
    return F.shiftright(h, 64 - bits) if bits else F.lit(0).cast("long")


def _busy_ranges(refs: DataFrame, bits: int) -> DataFrame:
    """The ranges that more references fall into than one task probes: range, tasks."""
    tasks = F.ceil(F.col("r") / ROWS_PER_SLOT).cast("int")
    return refs.groupBy(_range(F.col("h"), bits).alias("range")).agg(F.count("*").alias("r")).select("range", tasks.alias("tasks")).where("tasks > 1")


def failing_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose target is missing, late or deleted, as ``state``.

    ``refs`` has key (string), at (timestamp), any payload columns; a null key
    finds no parent.  ``parents`` has key (string), seen_at (timestamp),
    deleted_at (timestamp, null for never); repeated parents count with their
    earliest times.  State is ``missing`` if no parent has the key, else
    ``late`` if the parent was first seen after ``at``, else ``deleted`` if it
    was deleted not after ``at``.  Empty inputs are fine; a null ``at`` can
    only be missing.
    """
    payload = [c for c in refs.columns if c not in ("key", "at")]
    keyed = parents.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min(F.unix_micros("seen_at")).alias("seen"), F.min(F.unix_micros("deleted_at")).alias("gone")
    ).withColumn("h", F.xxhash64("key"))
    asked = refs.withColumn("h", F.xxhash64("key")).withColumn("at", F.unix_micros("at"))
    # Different keys spread evenly over the hash space, so ranges of equal width hold about as many parents each;
    # a range with a key that very many rows refer to is probed by several tasks, each with that range's parents.
    rows = keyed.count() + asked.count()
    n = max(1, -(-rows // ROWS_PER_SLOT))
    bits = (n - 1).bit_length()
    busy = cut(_busy_ranges(asked, bits), "busy")
    small = busy.count() <= BROADCAST_RANGES
    split = F.broadcast(busy) if small else busy
    tasks = F.coalesce("tasks", F.lit(1))
    asked = asked.withColumn("range", _range(F.col("h"), bits)).join(split, "range", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), tasks).cast("int")).drop("tasks")
    stored = keyed.withColumn("range", _range(F.col("h"), bits)).join(split, "range", "left")
    stored = stored.select("range", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("part"), "h", "key", "seen", "gone")
    names = ["key", "at", *payload]
    types = {f.name: f.dataType.simpleString() for f in asked.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in payload) + ", at bigint, state string"

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        found, seen, gone = lookup(left.column("key").combine_chunks(), left.column("h").to_numpy(), right)
        at = left.column("at").to_numpy(zero_copy_only=False).astype("float64") if left.column("at").null_count else left.column("at").to_numpy()
        state = np.where(~found, 1, np.where(seen > at, 2, np.where((gone <= at), 3, 0)))
        if left.column("at").null_count:
            state = np.where(found & pc.is_null(left.column("at")).to_numpy(zero_copy_only=False), 0, state)
        rows = np.flatnonzero(state)
        text = pa.DictionaryArray.from_arrays(pa.array(state[rows] - 1, pa.int8()), pa.array(["missing", "late", "deleted"])).cast(pa.string())
        part = left.select([*payload, "at"]).take(pa.array(rows))
        return part.append_column("state", text)

    # The number of tasks follows the data.
    probes = asked.select("range", "part", "h", *names).repartition(n, "range", "part")
    held = stored.repartition(n, "range", "part")
    out = probes.groupBy("range", "part").cogroup(held.groupBy("range", "part")).applyInArrow(probe, schema)
    return out.withColumn("at", F.timestamp_micros("at"))


def lookup(keys: pa.Array, hashes: np.ndarray, parents: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Finds each key among the parents by binary search on sorted hashes; different keys of one hash are told apart."""
    n, never = len(hashes), np.iinfo(np.int64).max
    found, seen, gone = np.zeros(n, bool), np.full(n, never), np.full(n, never)
    if parents.num_rows == 0 or n == 0:
        return found, seen, gone
    stored = parents.column("h").to_numpy()
    order = np.argsort(stored, kind="stable")
    stored = stored[order]
    names = parents.column("key").combine_chunks().take(pa.array(order))
    s = pc.fill_null(parents.column("seen"), np.iinfo(np.int64).min).to_numpy()[order]
    g = pc.fill_null(parents.column("gone"), never).to_numpy()[order]
    place = np.searchsorted(stored, hashes)
    open_ = np.flatnonzero(place < len(stored))
    open_ = open_[stored[place[open_]] == hashes[open_]]
    while len(open_):
        at = place[open_]
        same = pc.fill_null(pc.equal(keys.take(pa.array(open_)), names.take(pa.array(at))), False).to_numpy(zero_copy_only=False)
        hit, where = open_[same], at[same]
        found[hit], seen[hit], gone[hit] = True, s[where], g[where]
        open_ = open_[~same]
        place[open_] += 1
        open_ = open_[place[open_] < len(stored)]
        open_ = open_[stored[place[open_]] == hashes[open_]]
    return found, seen, gone


def usage_references(model_usage: DataFrame, turn_usage: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every failing session and turn reference: ref_table, ref_field, row_id, state, ref_month.

    Null and empty references are none; a turn beside a null session finds
    none.  Repeated parents count once, with their earliest times; repeated
    rows of a referring table are judged each.  A row without arrival time can
    only be missing and has a null month.  Empty tables of parents make every
    reference missing, empty referring tables give no rows.  Other columns,
    whatever their names, are left out before anything is joined.
    """
    to_session = [
        df.where(has_text(F.col("session_id"))).select(
            F.concat(F.lit("s"), composite_key("session_id")).alias("key"), F.col("ingested_at").alias("at"),
            F.lit(code).cast("byte").alias("field"), F.col("row_id").cast("long").alias("row_id"),
        )
        for code, df in ((0, model_usage), (2, turn_usage))
    ]
    to_turn = model_usage.where(has_text(F.col("turn_id"))).select(
        F.concat(F.lit("t"), composite_key("session_id", "turn_id")).alias("key"), F.col("ingested_at").alias("at"),
        F.lit(1).cast("byte").alias("field"), F.col("row_id").cast("long").alias("row_id"),
    )
    parents = sessions.select(F.concat(F.lit("s"), composite_key("id")).alias("key"), F.col("ingested_at").alias("seen_at"), F.col("deleted_at")).unionByName(
        turn_usage.select(F.concat(F.lit("t"), composite_key("session_id", "turn_id")).alias("key"), F.col("ingested_at").alias("seen_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    )
    failing = failing_references(to_session[0].unionByName(to_session[1]).unionByName(to_turn), parents)
    return failing.select(
        F.when(F.col("field") == 2, "turn_usage").otherwise("model_usage").alias("ref_table"),
        F.when(F.col("field") == 1, "turn_id").otherwise("session_id").alias("ref_field"),
        "row_id", "state", utc_month(F.col("at")).alias("ref_month"),
    )
