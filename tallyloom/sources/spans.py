"""Usage between the counters of an event log: calls, replies and intervals.

A counter line closes a span: all lines of its file since the counter before.
What a span contributes is decided once for each span: calls that state their
own usage, else the one reply that the counter's last usage belongs to, else
the difference of two counters, which may reach over several turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.metering import epochs

#: The counts of a log's usage objects, and those that a reply is recognised by.
COUNTS = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cached_input_tokens", "total": "total_tokens"}
CORE = ("input", "output", "cache_read")


def _counts(root: str) -> Column:
    """The counts of a usage object; texts, fractions and negative numbers are null."""

    def one(key):
        value = F.get_json_object("line", f"$.payload.{root}.{key}")
        return F.when(value.rlike("^[0-9]{1,18}$"), value.cast("long"))

    return F.struct(*[one(k).alias(m) for m, k in COUNTS.items()])


def spans(log: DataFrame) -> DataFrame:
    """One row for each counter of a log (see ``logs.event_log``) with what its span contributes.

    path, epoch, session, turn, model, provider, time, kind (direct, reply,
    interval, none), call_id (of a reply), turns (of the span, sorted),
    interval_start, the counts and issue.  Lines behind the last counter close
    no span.
    """
    at = lambda p: F.get_json_object("line", f"$.{p}")
    counter = F.coalesce((F.col("event") == "token_count") & at("payload.info.total_token_usage").startswith("{"), F.lit(False))
    reply = (F.col("type") == "response_item") & (at("payload.role") == "assistant")
    rows = log.select(
        "path", "line_no", "session", "turn", "model", "provider", "time", counter.alias("closes"), F.when(reply, F.coalesce(at("payload.id"), F.lit(""))).alias("reply"),
        F.when(F.col("type") == "token_usage_record", _counts("usage")).alias("direct"), F.when(counter, _counts("info.total_token_usage")).alias("totals"),
        F.when(counter & at("payload.info.last_token_usage").startswith("{"), _counts("info.last_token_usage")).alias("last"),
    )
    rows = epochs(rows, ["path"], ["line_no"], F.col("closes"), spread=True)
    own = lambda c: F.max(F.when(F.col("closes"), F.col(c))).alias(c)
    out = rows.groupBy("path", "epoch").agg(
        *[own(c) for c in ("line_no", "session", "turn", "model", "provider", "time", "totals", "last")],
        F.count("reply").alias("replies"), F.max("reply").alias("reply"), F.count("direct").alias("directs"), F.array_sort(F.collect_set("turn")).alias("turns"),
        *[F.sum(f"direct.{m}").alias(f"direct_{m}") for m in CORE], *[F.count(f"direct.{m}").alias(f"stated_{m}") for m in CORE],
    ).where("totals is not null")
    w = W.partitionBy("path").orderBy("epoch")
    out = out.withColumns({"before": F.lag("totals").over(w), "interval_start": F.lag("time").over(w)})
    first = F.col("before").isNull()
    delta = {m: F.col(f"totals.{m}") - F.col(f"before.{m}") for m in COUNTS}
    every = lambda conditions: _all(conditions)
    fits = every([F.col(f"last.{m}").isNotNull() for m in CORE]) & (first | every([F.coalesce(delta[m] == F.col(f"last.{m}"), F.lit(False)) for m in CORE]))
    unique = (F.col("replies") == 1) & (F.col("reply") != "") & F.col("last").isNotNull() & fits
    fell = ~every([F.coalesce(d >= 0, F.lit(True)) for d in delta.values()])
    moved = ~every([F.coalesce(d == 0, F.lit(True)) for d in delta.values()])
    kind = F.when(F.col("directs") > 0, "direct").when(F.coalesce(unique, F.lit(False)), "reply").when(~first & ~fell & moved, "interval").otherwise("none")
    differs = ~every([F.coalesce(delta[m] == F.col(f"direct_{m}"), F.lit(True)) | (F.col(f"stated_{m}") < F.col("directs")) for m in CORE])
    early = first & ~every([F.coalesce(F.col(f"totals.{m}") == F.col(f"last.{m}"), F.lit(True)) for m in CORE])
    full = ~every([F.coalesce(F.col(f"totals.{m}") == 0, F.lit(True)) for m in COUNTS])
    issue = (
        F.when((F.col("kind") == "direct") & ~first & differs, "calls differ from counter").when((F.col("kind") == "reply") & early, "earlier use without baseline")
        .when((F.col("kind") == "none") & ~first & fell, "reset").when((F.col("kind") == "none") & first & full, "no baseline")
    )
    out = out.withColumn("kind", kind)
    value = lambda m: F.when(F.col("kind") == "reply", F.col(f"last.{m}")).when(F.col("kind") == "interval", delta[m])
    return out.select(
        "path", "epoch", "line_no", "session", "turn", "model", "provider", "time", "kind", F.when(F.col("kind") == "reply", F.col("reply")).alias("call_id"), "turns",
        F.when(F.col("kind") == "interval", F.col("interval_start")).alias("interval_start"), *[value(m).alias(m) for m in COUNTS], issue.alias("issue"),
    )


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def metered(direct: DataFrame, found: DataFrame) -> DataFrame:
    """The records of a log: its calls, its replies, and the intervals that touch no turn with calls of its own.

    call_id, session, turn (null for an interval over several turns), turns,
    granularity (model_call, reply_usage, cumulative_interval), time,
    interval_start, calls (null for intervals) and the counts.
    """
    calls = direct.select(
        "call_id", "session", "turn", F.array("turn").alias("turns"), F.lit("model_call").alias("granularity"), "time", F.lit(None).cast("string").alias("interval_start"), F.lit(1).alias("calls"), *COUNTS
    )
    rows = found.where("kind in ('reply', 'interval')").withColumn("turns", F.when(F.col("kind") == "reply", F.array("turn")).otherwise(F.col("turns")))
    keyed = rows.withColumn("key", F.struct("path", "epoch"))
    covered = keyed.select("key", "session", F.explode("turns").alias("turn")).join(direct.select("session", "turn").distinct(), ["session", "turn"], "left_semi").select("key").distinct()
    rest = keyed.join(covered, "key", "left_anti")
    alone = F.when((F.col("kind") == "reply") | (F.size("turns") == 1), F.col("turns")[0])
    return calls.unionByName(rest.select(
        "call_id", "session", alone.alias("turn"), "turns", F.when(F.col("kind") == "reply", "reply_usage").otherwise("cumulative_interval").alias("granularity"), "time", "interval_start",
        F.when(F.col("kind") == "reply", 1).alias("calls"), *COUNTS,
    ))


def compactions(log: DataFrame) -> DataFrame:
    """The compaction marks of a log: call_id (null if it names none), session, path, line_no."""
    return log.where("type = 'compacted'").select(F.get_json_object("line", "$.payload.compaction_response_id").alias("call_id"), "session", "path", "line_no")


def reclassified(records: DataFrame, marks: DataFrame) -> DataFrame:
    """``records`` with ``internal_kind``: ``compaction`` for calls that a mark names, null for others."""
    named = marks.where("call_id is not null").select("call_id").distinct().withColumn("internal_kind", F.lit("compaction"))
    return records.join(named, "call_id", "left")


def unmatched_compactions(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks that name no call, or one without usage: the mark's columns and ``problem``."""
    calls = records.where("call_id is not null").select(F.col("call_id").alias("c")).distinct()
    out = marks.join(calls, marks.call_id == F.col("c"), "left").where("c is null").drop("c")
    return out.withColumn("problem", F.when(F.col("call_id").isNull(), "names no call").otherwise("call without usage"))


def in_turns(records: DataFrame, turns: DataFrame) -> DataFrame:
    """``records`` with ``scope``: kept, crossing (an interval partly inside), other or unassigned (no turn).

    ``turns``: turn, the selected ones (a small table of parameters is not
    required; it is joined).  Records carry ``turns``, the turns they lie in.
    """
    named = records.withColumn("__id", F.monotonically_increasing_id())
    hit = named.select("__id", F.explode("turns").alias("turn")).join(turns.select("turn").distinct(), "turn", "left_semi").groupBy("__id").agg(F.count("*").alias("__n"))
    out = named.join(hit, "__id", "left")
    inside, size = F.coalesce("__n", F.lit(0)), F.size(F.array_compact("turns"))
    scope = F.when(size == 0, "unassigned").when(inside == size, "kept").when(inside > 0, "crossing").otherwise("other")
    return out.withColumn("scope", scope).drop("__id", "__n")


def spawned(events: DataFrame) -> DataFrame:
    """The turn that each child session was spawned in: child, parent, origin_turn; the first spawn of an agent counts.

    ``events``: event, session, turn, agent, parent, path, line_no; a child's
    own events name its parent session, the parent's spawn events its turn.
    """
    children = events.where("agent is not null and parent is not null").groupBy(F.col("parent").alias("session"), "agent").agg(F.max_by("session", F.struct("path", "line_no")).alias("child"))
    starts = events.where("agent is not null and event in ('subagent.spawned', 'subagent.background.started')").groupBy("session", "agent").agg(F.min_by("turn", F.struct("path", "line_no")).alias("origin_turn"))
    return children.join(starts, ["session", "agent"]).select("child", F.col("session").alias("parent"), "origin_turn")
