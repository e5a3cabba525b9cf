"""Selection, ordering and lifecycles of usage records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import cut


def classify_source(c: Column) -> Column:
    """The group of a query source."""
    return (
        F.when(c == "main_turn", "main").when(c.isin("subagent", "workflow_child"), "child")
        .when(c.isin("compact", "session_title", "web_fetch_processing", "web_search_tool"), "internal").otherwise("unknown")
    )


def local_date(at_ms: Column, zone: str) -> Column:
    """The calendar day in ``zone`` (tz name or +HH:MM) of epoch milliseconds; the session must run in UTC."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(at_ms), zone))


def day_start_ms(day: Column, zone: str) -> Column:
    """The epoch milliseconds of a local midnight; days have 23 or 25 hours where clocks change."""
    return F.unix_millis(F.to_utc_timestamp(day.cast("timestamp"), zone))


def disposition(at_ms: Column, since_ms: int | None, upto_ms: int) -> Column:
    """Where a record stands to the half-open range [since, upto)."""
    out = F.when(at_ms.isNull(), "no_time").when(at_ms == upto_ms, "at_cutoff").when(at_ms > upto_ms, "after")
    if since_ms is not None:
        out = out.when(at_ms < since_ms, "before")
    return out.otherwise("in_range")


def bucketing(df: DataFrame, at_ms: str, interval_start_ms: str | None, zone: str, since_ms: int | None) -> DataFrame:
    """Adds ``day``; null where the record's interval began before its day's or the range's lower bound."""
    day = local_date(F.col(at_ms), zone)
    if interval_start_ms is None:
        return df.withColumn("day", day)
    lower = day_start_ms(day, zone)
    lower = F.greatest(lower, F.lit(since_ms)) if since_ms is not None else lower
    return df.withColumn("day", F.when(F.coalesce(F.col(interval_start_ms) < lower, F.lit(False)), F.lit(None)).otherwise(day))


# --- lifecycles against a window ------------------------------------------------


def turn_intersects(start: Column, end: Column, since: Column, upto: Column) -> Column:
    """Whether a lifecycle's own bounds prove that it meets [since, upto)."""
    open_since = since.isNull()
    return (
        F.when(start.isNull() & end.isNull(), F.lit(False))
        .when(start.isNotNull() & end.isNotNull(), (start < upto) & (open_since | (end > since)))
        .when(start.isNotNull(), (start < upto) & (open_since | (start >= since)))
        .otherwise((end <= upto) & (open_since | (end > since)))
    )


def unproven_reason(start: Column, end: Column, since: Column) -> Column:
    """Why a lifecycle that does not provably meet the window cannot be ruled out either; null if it can."""
    return (
        F.when(start.isNull() & end.isNull(), "no bounds")
        .when(start.isNotNull() & end.isNotNull(), F.lit(None))
        .when(start.isNotNull(), F.when(since.isNotNull() & (start < since), "start only, before the range"))
        .when(since.isNotNull() & (end <= since), F.lit(None))
        .otherwise("end only")
    )


def span_state(start: Column, end: Column, since: Column, upto: Column) -> Column:
    before, after = start < since, end > upto
    return (
        F.when(end < start, "conflict").when(F.coalesce(before, F.lit(False)) & F.coalesce(after, F.lit(False)), "extends_both")
        .when(before, "extends_before").when(after, "extends_after").otherwise("in_range")
    )


def cutoff_status(start: Column, end: Column, upto: Column) -> Column:
    return (
        F.when(end.isNotNull(), F.when(end < upto, "ended_before_cutoff").otherwise("ended_after_cutoff"))
        .when(start < upto, "not_confirmed_ended_at_cutoff").otherwise("unknown_at_cutoff")
    )


def wall_clock(df: DataFrame, by: list[str], start: str, end: str, upto_ms: int) -> DataFrame:
    """Earliest start to latest end of each group, known only if every member has sound bounds before the cut-off."""
    s, e = F.col(start), F.col(end)
    out = df.groupBy(*by).agg(
        F.count("*").alias("members"), F.count(F.when(e < s, 1)).alias("reversed"), F.count(F.when(s.isNull() | e.isNull(), 1)).alias("missing"),
        F.count(F.when(e >= upto_ms, 1)).alias("late"), F.min(s).alias("__a"), F.max(e).alias("__b"),
    )
    state = F.when(F.col("reversed") > 0, "conflict").when((F.col("missing") > 0) | (F.col("late") > 0), "unknown").otherwise("known")
    return out.withColumn("state", state).withColumn("wall_ms", F.when(F.col("state") == "known", F.col("__b") - F.col("__a"))).drop("__a", "__b")


# --- ordered logs ------------------------------------------------------------------


CHUNK = "__chunk"


def chunked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` in range chunks by ``by`` and ``order``, numbered in ``__chunk``: a key of any size spreads over tasks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *by, *order).withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _carried(rows: DataFrame, by: list[str], summary: list[Column], carry: dict[str, Column]) -> DataFrame:
    """``rows`` with columns that tell of the earlier chunks of their key.

    ``summary``: aggregates of a chunk.  ``carry``: window expressions over a
    key's chunks, one row each.
    """
    chunks = rows.groupBy(*by, CHUNK).agg(*summary)
    told = chunks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*by, CHUNK])], *[c.alias(n) for n, c in carry.items()])
    on = F.lit(True)
    for i, k in enumerate([*by, CHUNK]):
        on = on & rows[k].eqNullSafe(told[f"__k{i}"])
    return rows.join(told, on, "left").drop(*[f"__k{i}" for i in range(len(by) + 1)])


def forward_fill(df: DataFrame, by: list[str], order: list[str], columns: list[str], resets: Column | None = None, spread: bool = False) -> DataFrame:
    """Adds ``ctx_<column>``: the value of the last context row at or before each row.

    Without ``resets`` a context row of a column is one with a value.  With it,
    every row where it is true sets all columns, to null if they are null.
    ``spread`` cuts keys with very many rows into chunks.
    """
    states = {"__all": F.when(resets, F.struct(*columns))} if resets is not None else {f"__{c}": F.when(F.col(c).isNotNull(), F.struct(c)) for c in columns}
    rows, keys = (chunked(df, by, order), [*by, CHUNK]) if spread else (df, by)
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if spread:
        at = F.struct(*order)
        before = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
        rows = _carried(rows, by, [F.max_by(s, F.when(s.isNotNull(), at)).alias(n) for n, s in states.items()], {f"{n}_before": F.last(n, ignorenulls=True).over(before) for n in states})
    held = {n: F.last(s, ignorenulls=True).over(w) for n, s in states.items()}
    out = rows.withColumns({n: F.coalesce(h, F.col(f"{n}_before")) if spread else h for n, h in held.items()})
    out = out.withColumns({f"ctx_{c}": F.col("__all" if resets is not None else f"__{c}")[c] for c in columns})
    return out.drop(*states, *[f"{n}_before" for n in states], CHUNK)


def counter_deltas(df: DataFrame, by: list[str], order: list[str], counters: list[str], spread: bool = False) -> DataFrame:
    """Differences of cumulative counters: delta_<counter> and ``issue``.

    A first reading above zero has no baseline, a decrease is a reset; both
    give null differences.  ``spread`` cuts keys with very many rows into
    chunks.
    """
    rows, keys = (chunked(df, by, order), [*by, CHUNK]) if spread else (df, by)
    w = W.partitionBy(*keys).orderBy(*order)
    previous = F.lag(F.struct(*counters)).over(w)
    if spread:
        rows = _carried(rows, by, [F.max_by(F.struct(*counters), F.struct(*order)).alias("__s")], {"__before": F.lag("__s").over(W.partitionBy(*by).orderBy(CHUNK))})
        previous = F.coalesce(previous, F.col("__before"))
    out = rows.withColumn("__p", previous)
    first = F.col("__p").isNull()
    fell, based = F.lit(False), F.lit(False)
    for c in counters:
        fell = fell | F.coalesce(F.col(c) < F.col("__p")[c], F.lit(False))
        based = based | (first & F.coalesce(F.col(c) > 0, F.lit(False)))
    out = out.withColumn("issue", F.when(based, "no baseline").when(fell, "reset"))
    out = out.withColumns({f"delta_{c}": F.when(F.col("issue").isNull(), F.when(first, F.col(c)).otherwise(F.col(c) - F.col("__p")[c])) for c in counters})
    return out.drop("__p", "__before", CHUNK)


def epochs(df: DataFrame, by: list[str], order: list[str], closes: Column, spread: bool = False) -> DataFrame:
    """Adds ``epoch``: how many closing rows stand before each row of its key.  ``spread`` cuts keys with very many rows into chunks."""
    rows, keys = (chunked(df, by, order), [*by, CHUNK]) if spread else (df, by)
    one = F.when(closes, 1).otherwise(0)
    local = F.coalesce(F.sum(one).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if spread:
        before = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
        rows = _carried(rows, by, [F.sum(one).alias("__n")], {"__before": F.coalesce(F.sum("__n").over(before), F.lit(0))})
        local = local + F.col("__before")
    return rows.withColumn("epoch", local).drop("__before", CHUNK)


def without_covered(fallback: DataFrame, direct: DataFrame, keys: list[str]) -> DataFrame:
    """The fallback records of those groups that have no direct record."""
    return fallback.join(direct.select(*keys).distinct(), keys, "left_anti")


def merge_start_complete(df: DataFrame, keys: list[str], kind: str, at: str) -> DataFrame:
    """One row for each call from its start and completion rows: started, completed, state."""
    begun, done = F.col(kind) == "started", F.col(kind) == "completed"
    out = df.groupBy(*keys).agg(
        F.min(F.when(begun, F.col(at))).alias("started"), F.max(F.when(done, F.col(at))).alias("completed"), F.count(F.when(begun, 1)).alias("starts"), F.count(F.when(done, 1)).alias("completions")
    )
    state = (
        F.when((F.col("starts") > 1) | (F.col("completions") > 1), "conflict").when(F.col("started").isNull(), "start missing").when(F.col("completed").isNull(), "running")
        .when(F.col("completed") < F.col("started"), "conflict").otherwise("complete")
    )
    return out.withColumn("state", state)


# --- durations and latencies ---------------------------------------------------------


def duration_evidence(direct: Column, start: Column, end: Column, tolerance_ms: Column | int = 1) -> tuple[Column, Column]:
    """Value and state of a duration from a direct field and a record's own ends, compared as finely as the ends are written."""
    span = end - start
    state = (
        F.when(direct < 0, "conflict").when(span < 0, "conflict").when(direct.isNotNull() & (F.abs(span - direct) > tolerance_ms), "conflict")
        .when(direct.isNotNull() | span.isNotNull(), "known").otherwise("unknown")
    )
    return F.when(state == "known", F.coalesce(direct, span)), state


def latency_outcome(start: Column, first: Column, tools: Column, native: Column, since: int | None, upto: int) -> Column:
    """The first rule that keeps a record out of the latency sample, as ``kind: reason``; null if none does."""
    diff = first - start
    out = (
        F.when(start.isNull() | first.isNull(), "missing: start or first token").when(tools.isNull(), "missing: tool call count").when(tools > 0, "unsupported: tool arguments")
        .when(diff < 0, "conflict: first token before start").when(native < 0, "conflict: native latency").when(native.isNotNull() & (native != diff), "conflict: native latency differs")
    )
    outside = first >= upto
    return out.when(outside if since is None else outside | (first < since), "range: first token")


def throughput_outcome(output_known: Column, first: Column, end: Column, retries: Column, tools: Column, since: int | None, upto: int) -> Column:
    """The first rule that keeps a record out of the throughput sample."""
    out = (
        F.when(~output_known, "missing: output").when(first.isNull(), "missing: first token").when(end.isNull(), "missing: completion").when(retries.isNull(), "missing: retry count")
        .when(retries != 0, "unsupported: retried").when(tools.isNull(), "missing: tool call count").when(tools > 0, "unsupported: tool arguments").when(end - first <= 0, "conflict: empty interval")
    )
    outside = end >= upto
    return out.when(outside if since is None else outside | (end < since), "range: completion")


def preset_start(preset: Column, cutoff: Column, zone: str) -> Column:
    """The lower bound (timestamp) of a quick range before ``cutoff``; null for ``all`` and unknown presets.

    Days, weeks (from Monday) and months follow the zone's calendar.
    """
    local = F.from_utc_timestamp(cutoff, zone)
    back = lambda unit: F.to_utc_timestamp(F.date_trunc(unit, local), zone)
    hours = F.when(preset == "last_1d", 24).when(preset == "last_3d", 72).when(preset == "last_7d", 168).when(preset == "last_30d", 720)
    return (
        F.when(preset == "today", back("day")).when(preset == "week", back("week")).when(preset == "month", back("month"))
        .when(hours.isNotNull(), F.timestamp_micros(F.unix_micros(cutoff) - hours.cast("long") * F.lit(3_600_000_000).cast("long")))
    )
