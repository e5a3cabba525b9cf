"""Messages delivered at least once: exactly one copy of each is kept.

An identifier that ends in a number is a sequence number of its producer (all
that stands before the number, together with the rest of the message key).
For each producer the numbers seen so far are held as disjoint ranges.  A
delivery is taken in like this: the first row of each number that no range
covers is accepted, and the new numbers are merged with the ranges.
Identifiers of another form are looked up by their exact text.  Ranges are cut
at multiples of BLOCK numbers and rows of one number are put together before
they are shuffled, so neither a busy producer nor a message with very many
copies ends in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import fresh_name
from tallyloom.session import Written, write_cut

#: Identifiers ending in up to this many hexadecimal digits carry a sequence number.
HEX_DIGITS = 15
_SEQUENCE = rf"^(.*[^0-9a-f]|)([0-9a-f]{{1,{HEX_DIGITS}}})$"
#: Ranges are cut at multiples of this many numbers, so that a busy producer spreads over tasks.
BLOCK = 4096
#: A whole table is taken in as this many deliveries, in the order of arrival.
ARRIVALS = 3
#: Rows of one message that are paired by one task.
PAIR_ROWS = 2_000
KEYS = ["scope", "attempt", "producer", "width"]


def message_identity(identifier: Column) -> tuple[Column, Column, Column]:
    """Producer text, digits' width and sequence number of an identifier already in its compared form.

    Malformed identifiers get the whole text as producer, width 0 and number 0.
    """
    number = F.regexp_extract(identifier, _SEQUENCE, 2)
    formed = number != ""
    return (
        F.when(formed, F.regexp_extract(identifier, _SEQUENCE, 1)).otherwise(identifier),
        F.when(formed, F.length(number)).otherwise(F.lit(0)),
        F.when(formed, F.conv(number, 16, 10).cast("long")).otherwise(F.lit(0).cast("long")),
    )


def deliveries(df: DataFrame, scope: str, identifier: str, attempt: str, row: str) -> DataFrame:
    """The rows that carry a whole message key, with its parts."""
    name = F.lower(F.btrim(F.col(identifier), F.lit(" \t\r\n\u00a0\u3000")))
    producer, width, seq = message_identity(F.col("__name"))
    whole = df.where(F.col(scope).isNotNull() & F.col(attempt).isNotNull() & (name != "")).select(
        F.col(scope).alias("scope"), F.col(attempt).cast("int").alias("attempt"), name.alias("__name"), F.col(row).cast("long").alias("row_id")
    )
    return whole.select("scope", "attempt", producer.alias("producer"), width.cast("int").alias("width"), seq.alias("seq"), "row_id")


# --- taking in deliveries ------------------------------------------------------

_TAKEN = "scope string, attempt int, producer string, width int, block long, message boolean, seq long, upto long, row_id long, accepted boolean, repeated boolean"


def take_in(rows: DataFrame, seen: DataFrame | None = None) -> Written:
    """Takes in a delivery: one row for each of its messages, and the ranges seen after it.

    ``rows``: scope, attempt, producer, width, seq, row_id (see
    ``deliveries``).  ``seen``: the ranges seen before (see ``ranges_of``).
    Messages (``message`` is true): row_id is the first row of the delivery,
    ``accepted`` tells that the number was not seen before, ``repeated`` that
    it was or that the delivery has it more than once.  Ranges: seq to upto.
    """
    first = rows.groupBy(*KEYS, "seq").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))
    keys = [*KEYS, "block"]
    fresh = first.where("width > 0").withColumn("block", F.expr(f"seq div {BLOCK}"))
    # At most BLOCK numbers of one producer.
    fresh = fresh.groupBy(*keys).agg(F.collect_list("seq").alias("seqs"), F.collect_list("row_id").alias("row_ids"), F.collect_list("n").alias("ns"))
    if seen is None:
        joined = fresh.withColumns({c: F.lit(None).cast("array<bigint>") for c in ("los", "his")})
        known = first.where("width = 0").withColumn("found", F.lit(False))
    else:
        held = seen.where("width > 0").groupBy(*keys).agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
        joined = fresh.join(held, keys, "full")
        names = seen.where("width = 0").select(*KEYS, F.lit(True).alias("found"))
        known = first.where("width = 0").join(names, KEYS, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    numbered = joined.select(*keys, "seqs", "row_ids", "ns", "los", "his").mapInArrow(_merged, _TAKEN)
    zero = F.lit(0).cast("long")
    plain = known.select(*KEYS, zero.alias("block"), F.lit(True).alias("message"), zero.alias("seq"), zero.alias("upto"), "row_id", (~F.col("found")).alias("accepted"), (F.col("found") | (F.col("n") > 1)).alias("repeated"))
    names = known.select(*KEYS).unionByName(seen.where("width = 0").select(*KEYS)).distinct() if seen is not None else known.select(*KEYS)
    no = F.lit(None).cast("boolean")
    names = names.select(*KEYS, zero.alias("block"), F.lit(False).alias("message"), zero.alias("seq"), zero.alias("upto"), F.lit(None).cast("long").alias("row_id"), no.alias("accepted"), no.alias("repeated"))
    return write_cut(numbered.unionByName(plain).unionByName(names), "taken")


def ranges_of(taken: DataFrame) -> DataFrame:
    """The disjoint ranges in a result of ``take_in``: scope, attempt, producer, width, block, lo, hi."""
    return taken.where("not message").select(*KEYS, "block", F.col("seq").alias("lo"), F.col("upto").alias("hi"))


def _merged(batches):
    """Accepts the numbers that no range covers and merges them with the ranges, for many blocks at once.

    A block's numbers stand BLOCK apart from those of the next one, so that
    sorted numbers and ranges of all blocks never meet.
    """
    for batch in batches:
        n = batch.num_rows
        base = batch.column("block").to_numpy() * BLOCK
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        of = lambda c: np.repeat(np.arange(n), pa.compute.fill_null(batch.column(c).value_lengths(), 0).to_numpy(zero_copy_only=False))
        owner, held = of("seqs"), of("los")
        number, row, times = flat("seqs"), flat("row_ids"), flat("ns")
        place = owner * 2 * BLOCK + number - base[owner]
        lo, hi = (held * 2 * BLOCK + flat(c) - base[held] for c in ("los", "his"))
        order = np.argsort(lo, kind="stable")
        lo, hi, held = lo[order], hi[order], held[order]
        at = np.searchsorted(lo, place, side="right") - 1
        covered = (at >= 0) & (hi[np.maximum(at, 0)] >= place) if len(lo) else np.zeros(len(place), bool)
        yield _taken(batch, owner, True, number, number, row, ~covered, covered | (times > 1))
        # The accepted numbers are ranges of one; ranges that touch are one range.
        every = np.concatenate([lo, place[~covered]])
        upto, block = np.concatenate([hi, place[~covered]]), np.concatenate([held, owner[~covered]])
        order = np.argsort(every, kind="stable")
        every, upto, block = every[order], upto[order], block[order]
        begins = np.flatnonzero(np.append(True, every[1:] > upto[:-1] + 1)) if len(every) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(every)) - 1
        block = block[begins] if len(every) else np.zeros(0, np.int64)
        shift = base[block] - block * 2 * BLOCK
        none = np.zeros(len(block), bool)
        yield _taken(batch, block, False, every[begins] + shift, (upto[ends] if len(every) else every) + shift, np.zeros(len(block), np.int64), none, none)


def _taken(batch, owner, message, seq, upto, row, accepted, repeated):
    keys = [batch.column(k).take(pa.array(owner)) for k in (*KEYS, "block")]
    values = [pa.array(np.full(len(owner), message)), *[pa.array(x) for x in (seq, upto, row, accepted, repeated)]]
    return pa.RecordBatch.from_arrays([*keys, *values], names=[f.split()[0] for f in _TAKEN.split(", ")])


def taken_in(df: DataFrame, scope: str, identifier: str, attempt: str, row: str) -> DataFrame:
    """The messages of all deliveries of ``df``, which are taken in one after the other in the order of ``row``.

    Columns of ``take_in``; a message has one accepted row, and one more for
    each later delivery that has it again.
    """
    rows = deliveries(df, scope, identifier, attempt, row)
    ends = df.agg(F.min(F.col(row).cast("long")).alias("a"), F.max(F.col(row).cast("long")).alias("b")).first()
    if ends.a is None:
        return take_in(rows).read().where("message")
    step = max(1, -(-(ends.b - ends.a + 1) // ARRIVALS))
    out, last = None, None
    for low in range(ends.a, ends.b + 1, step):
        part = take_in(rows.where((F.col("row_id") >= low) & (F.col("row_id") < low + step)), ranges_of(last.read()) if last else None)
        last = part
        told = part.read().where("message")
        out = told if out is None else out.unionByName(told)
    return out


def copies(df: DataFrame, scope: str, identifier: str, attempt: str, row: str) -> DataFrame:
    """Rows that are copies of one message: row_id and kept_row_id, the message's first row.

    Lists every row of a message that has more than one row, the kept one
    included.  Messages are known by ``scope``, ``identifier`` (ignoring case
    and surrounding blanks) and ``attempt``; rows in which one is null or the
    identifier is blank are no copies.  ``row`` is unique and follows arrival.
    Identifiers of any length and form are taken whole; an empty table gives no
    rows; other columns of ``df`` are left out.
    """
    key = [*KEYS, "seq"]
    told = taken_in(df, scope, identifier, attempt, row)
    again = told.groupBy(*key).agg(F.bool_or("repeated").alias("repeated"), F.min(F.when(F.col("accepted"), F.col("row_id"))).alias("kept_row_id")).where("repeated")
    return deliveries(df, scope, identifier, attempt, row).join(again, key).select("row_id", "kept_row_id")


def delivered_once(df: DataFrame, scope: str, identifier: str, attempt: str, row: str) -> DataFrame:
    """``df`` with exactly one row of each message: the one that came first; rows that are no copies stay."""
    key = fresh_name(df.columns, "again")
    again = copies(df, scope, identifier, attempt, row).where("row_id <> kept_row_id").select(F.col("row_id").alias(key))
    return df.join(again, df[row] == again[key], "left_anti")


def copy_pairs(found: DataFrame) -> DataFrame:
    """Every pair of rows of one message, from a result of ``copies``: row_id_a < row_id_b.

    The rows of a message with very many copies are cut into blocks, and
    blocks are paired by different tasks.
    """
    sizes = found.groupBy("kept_row_id").agg(F.count("*").alias("n"))
    many = sizes.where(F.col("n") > PAIR_ROWS).select(F.col("kept_row_id").alias("k"), F.ceil(F.col("n") / PAIR_ROWS).cast("int").alias("blocks"))
    cut_up = found.join(many, F.col("kept_row_id") == F.col("k"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut_up = cut_up.select("kept_row_id", "row_id", "blocks", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = cut_up.select("kept_row_id", F.col("own").alias("x"), every.alias("y"), F.col("row_id").alias("row_id_a"))
    b = cut_up.select("kept_row_id", every.alias("x"), F.col("own").alias("y"), F.col("row_id").alias("row_id_b"))
    return a.join(b, ["kept_row_id", "x", "y"]).where("row_id_a < row_id_b").select("row_id_a", "row_id_b")


def seen_ranges(df: DataFrame, scope: str, identifier: str, attempt: str, row: str, earlier: DataFrame | None = None) -> DataFrame:
    """The disjoint ranges of sequence numbers seen per producer: scope, attempt, producer, width, block, lo, hi.

    ``earlier`` are ranges of former deliveries, which the new ones are merged
    with.  Malformed identifiers stand as ranges of width 0 from 0 to 0, one
    for each exact text.
    """
    return ranges_of(take_in(deliveries(df, scope, identifier, attempt, row), earlier).read())


def unseen(df: DataFrame, ranges: DataFrame, scope: str, identifier: str, attempt: str, row: str) -> DataFrame:
    """The first row of each message of a new delivery whose number no range of former ones covers."""
    told = take_in(deliveries(df, scope, identifier, attempt, row), ranges).read().where("message and accepted")
    key = fresh_name(df.columns, "row")
    first = told.select(F.col("row_id").alias(key))
    return df.join(first, df[row] == first[key], "left_semi")
