"""Queries on usage records, turns and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import cells, graphs, metering, relations, timestamps
from tallyloom.plans import times_sql
from tallyloom.session import read_table

MAPPING = {"input": "inputTokens", "output": "outputTokens", "cache_read": "cacheReadTokens"}
VERIFIED = "builtin:nimbus-plan", "tern-cloud"
ZONE = "+08:00"
SINCE, UPTO = 1_772_323_200_000, 1_788_220_800_000  # 2026-03-01 to 2026-09-01 UTC


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records with their cells; only the columns that the queries read reach the scan."""
    usage = read_table(spark, sf_dir, "model_usage").withColumn("grp", metering.classify_source(F.col("query_source")))
    return cells.usage_cells(usage, "raw_usage_json", MAPPING, "totalTokens", F.col("provider_id").isin(*VERIFIED))


def timed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``records`` with ``started_ms``; null only where started_at denotes no single instant.

    Every spelling that p1 reads counts: finer digits than milliseconds are
    dropped, parts not written are zero, and ``started_unit_ms`` is the unit of
    the finest part written, 1 at least.
    """
    times = timestamps.normalise_times(read_table(spark, sf_dir, "model_usage"), "started_at", "recorded_tz", ["row_id"], "us", "unit")
    times = times.select("row_id", F.expr("us div 1000").alias("started_ms"), F.greatest(F.lit(1), F.expr("unit div 1000")).alias("started_unit_ms"))
    return records(spark, sf_dir).join(times, "row_id", "left")


def usage_cells(spark, sf_dir):
    out = records(spark, sf_dir)
    return out.select("row_id", *[F.col(m)[p].alias(f"{m}_{p}") for m in cells.METRICS for p in ("value", "state", "reason")])


def usage_by_group(spark, sf_dir):
    return cells.aggregate(records(spark, sf_dir), ["grp"])


def usage_by_status(spark, sf_dir):
    return cells.aggregate(records(spark, sf_dir), ["status", "grp"], calls="retry_count")


def usage_views(spark, sf_dir):
    return cells.dimension_views(records(spark, sf_dir), {"model": ["provider_id", "model_id"], "source": ["query_source"], "session": ["session_id"], "turn": ["session_id", "turn_id"]})


def usage_internal(spark, sf_dir):
    """Internal records by their source."""
    return cells.aggregate(records(spark, sf_dir).where("grp = 'internal'"), ["query_source"], ["input", "output", "total"])


def _days(spark, sf_dir):
    out = timed_records(spark, sf_dir).withColumn("disposition", metering.disposition(F.col("completed_at"), SINCE, UPTO))
    out = metering.bucketing(out.where("disposition = 'in_range'"), "completed_at", "started_ms", ZONE, SINCE)
    return out.withColumn("day", F.col("day").cast("string"))


def usage_daily(spark, sf_dir):
    """Days of the range in a time zone, by group; records whose interval crosses their day's start are in no day."""
    return cells.aggregate(_days(spark, sf_dir).where("day is not null"), ["day", "grp"], ["input", "output", "total"])


def usage_daily_sessions(spark, sf_dir):
    days = _days(spark, sf_dir).where("day is not null")
    once = days.groupBy("day", "session_id").agg(F.count("*").alias("n"))  # a distinct count without one hot task
    return once.groupBy("day").agg(F.count("session_id").alias("sessions"), F.sum("n").alias("records"))


def usage_day_models(spark, sf_dir):
    return cells.aggregate(_days(spark, sf_dir).where("day is not null"), ["day", "model_id"], ["output"])


def usage_unbucketed(spark, sf_dir):
    return cells.aggregate(_days(spark, sf_dir).where("day is null"), ["grp"], ["input", "output", "total"])


def usage_dispositions(spark, sf_dir):
    out = read_table(spark, sf_dir, "model_usage").withColumn("disposition", metering.disposition(F.col("completed_at"), SINCE, UPTO))
    return out.groupBy("disposition").agg(F.count("*").alias("n"))


def usage_partition(spark, sf_dir):
    """Days and unbucketed records are a partition of the selection: each record in exactly one part."""
    out = _days(spark, sf_dir).groupBy(F.when(F.col("day").isNull(), "unbucketed").otherwise("days").alias("part")).agg(F.count("*").alias("n"), F.count("row_id").alias("rows"))
    return out


def usage_reconciled(spark, sf_dir):
    """Copies of one message put together: equal cells stay, differing ones become conflicts."""
    name = F.lower(F.btrim("logical_request_id"))
    rows = records(spark, sf_dir).withColumn("call", name).where("session_id is not null and attempt_index is not null and call <> ''")
    out = cells.reconcile(rows, ["session_id", "call", "attempt_index"], ["input", "output"], "row_id")
    return out.select("session_id", "call", "attempt_index", "copies", *[F.col(m)[p].alias(f"{m}_{p}") for m in ("input", "output") for p in ("value", "state")])


def usage_rankings(spark, sf_dir):
    """Models by known total, largest first."""
    out = cells.aggregate(records(spark, sf_dir), ["model_id"], ["total"])
    return out.where("model_id is not null").orderBy(F.desc_nulls_last("total"), "model_id").select("model_id", "total", "total_state", "records")


def usage_export(spark, sf_dir):
    """One wide table of unlike rows: groups, days and turn counts."""
    group = usage_by_group(spark, sf_dir).select(F.lit("group").alias("row_type"), F.col("grp").alias("name"), "records", "total")
    day = usage_daily_sessions(spark, sf_dir).select(F.lit("day").alias("row_type"), F.col("day").alias("name"), "records", "sessions")
    part = usage_dispositions(spark, sf_dir).select(F.lit("disposition").alias("row_type"), F.col("disposition").alias("name"), F.col("n").alias("records"))
    return group.unionByName(day, allowMissingColumns=True).unionByName(part, allowMissingColumns=True)


# --- sessions and turns ---------------------------------------------------------


def session_index(spark, sf_dir):
    """Every session with its turns, last end and usage records; sessions without any stay."""
    sessions = read_table(spark, sf_dir, "agent_session").where("id is not null").groupBy("id").agg(F.min("time_created").alias("created"))
    turns = read_table(spark, sf_dir, "turn_usage").where("session_id is not null").groupBy("session_id", "turn_id").agg(F.max("completed_at").alias("e"))
    turns = turns.groupBy(F.col("session_id").alias("id")).agg(F.count("turn_id").alias("turns"), F.max("e").alias("last_end"))
    usage = read_table(spark, sf_dir, "model_usage").where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("usage_records"))
    out = sessions.join(turns, "id", "left").join(usage, "id", "left")
    return out.select(F.col("id").alias("session_id"), "created", F.coalesce("turns", F.lit(0)).alias("turns"), "last_end", F.coalesce("usage_records", F.lit(0)).alias("usage_records"))


def session_status(spark, sf_dir):
    """How much a session's records prove: zero only if all turns ended without requests and nothing was recorded."""
    turns = read_table(spark, sf_dir, "turn_usage").where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(
        F.count("*").alias("turns"), F.bool_and(F.col("completed_at").isNotNull()).alias("ended"), F.bool_and(F.coalesce(F.col("model_request_count") == 0, F.lit(False))).alias("quiet")
    )
    usage = records(spark, sf_dir).where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"), F.count(F.when(cells.known(F.col("total")), 1)).alias("with_total"))
    ids = read_table(spark, sf_dir, "agent_session").where("id is not null").select("id").distinct()
    out = ids.join(turns, "id", "left").join(usage, "id", "left")
    zero = F.coalesce(F.col("ended") & F.col("quiet"), F.lit(False)) & F.col("n").isNull()
    state = F.when(zero, "confirmed_zero").when(F.col("with_total") > 0, "partial").when(F.col("n") > 0, "count_only").otherwise("unstatisticable")
    return out.select(F.col("id").alias("session_id"), state.alias("state"))


def turn_spans(spark, sf_dir):
    s, e, since, upto = F.col("started_at"), F.col("completed_at"), F.lit(SINCE), F.lit(UPTO)
    return read_table(spark, sf_dir, "turn_usage").select(
        "row_id", metering.turn_intersects(s, e, since, upto).alias("intersects"), metering.unproven_reason(s, e, since).alias("unproven"),
        metering.span_state(s, e, since, upto).alias("span"), metering.cutoff_status(s, e, upto).alias("cutoff"),
    )


def turn_wall(spark, sf_dir):
    return metering.wall_clock(read_table(spark, sf_dir, "turn_usage").where("session_id is not null"), ["session_id"], "started_at", "completed_at", UPTO)


def duration_groups(spark, sf_dir):
    """Durations by source: direct field against the record's own ends."""
    value, state = metering.duration_evidence(F.col("duration_ms"), F.col("started_ms"), F.col("completed_at"), F.col("started_unit_ms"))
    out = timed_records(spark, sf_dir).select("grp", value.alias("v"), state.alias("s")).groupBy("grp").agg(
        F.count("*").alias("records"), F.count(F.when(F.col("s") == "known", 1)).alias("valid"), F.count(F.when(F.col("s") == "conflict", 1)).alias("conflict"),
        F.count(F.when(F.col("s") == "unknown", 1)).alias("missing"), F.sum("v").alias("total_ms"),
    )
    return out.withColumn("state", F.when(F.col("valid") == F.col("records"), "complete").when(F.col("valid") > 0, "known_subset").otherwise("unknown"))


# --- latency and throughput -------------------------------------------------------


def _latency(spark, sf_dir):
    out = timed_records(spark, sf_dir)
    return out.withColumn("why", metering.latency_outcome(F.col("started_ms"), F.col("first_token_at"), F.col("tool_call_count"), F.col("time_to_first_token_ms"), SINCE, UPTO))


def latency_outcomes(spark, sf_dir):
    return _latency(spark, sf_dir).groupBy(F.coalesce("why", F.lit("sample")).alias("outcome")).agg(F.count("*").alias("n"))


def latency_by_model(spark, sf_dir):
    """Time to first token as a ratio of sums."""
    out = _latency(spark, sf_dir).where("why is null").groupBy("model_id").agg(F.count("*").alias("samples"), F.sum(F.col("first_token_at") - F.col("started_ms")).alias("total_ms"))
    return out.withColumn("mean_ms", F.col("total_ms") / F.col("samples"))


def _throughput(spark, sf_dir):
    out = records(spark, sf_dir)
    why = metering.throughput_outcome(cells.known(F.col("output")), F.col("first_token_at"), F.col("completed_at"), F.col("retry_count"), F.col("tool_call_count"), SINCE, UPTO)
    return out.withColumn("why", why)


def throughput_outcomes(spark, sf_dir):
    return _throughput(spark, sf_dir).groupBy(F.coalesce("why", F.lit("sample")).alias("outcome")).agg(F.count("*").alias("n"))


def throughput_by_day(spark, sf_dir):
    out = _throughput(spark, sf_dir).where("why is null").groupBy(metering.local_date(F.col("completed_at"), ZONE).cast("string").alias("day")).agg(
        F.count("*").alias("samples"), F.sum(F.col("output")["value"]).alias("output"), F.sum(F.col("completed_at") - F.col("first_token_at")).alias("interval_ms")
    )
    return out.withColumn("per_second", F.col("output") * 1000 / F.col("interval_ms"))


# --- ordered logs -----------------------------------------------------------------


def context_fill(spark, sf_dir):
    """The model last named before each record of a turn."""
    rows = read_table(spark, sf_dir, "model_usage").select("row_id", "session_id", "turn_id", "provider_id", "query_source")
    return metering.forward_fill(rows, ["session_id", "turn_id"], ["row_id"], ["provider_id", "query_source"], spread=True).select("row_id", "ctx_provider_id", "ctx_query_source")


def context_reset(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    filled = metering.forward_fill(rows, ["user_id"], ["event_id"], ["props"], F.col("event_type") == "signup", spread=True)
    return filled.select("event_id", "ctx_props")


def counter_differences(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return metering.counter_deltas(rows, ["user_id"], ["event_id"], ["k"], spread=True).select("event_id", "delta_k", "issue")


def reply_epochs(spark, sf_dir):
    """Events between two purchases of a user, and whether exactly one of them is a click."""
    rows = metering.epochs(read_table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "purchase", spread=True)
    return rows.groupBy("user_id", "epoch").agg(F.count("*").alias("n"), (F.count(F.when(F.col("event_type") == "click", 1)) == 1).alias("one_click"))


def without_direct(spark, sf_dir):
    """Turn rows that no usage record covers."""
    turns = read_table(spark, sf_dir, "turn_usage").where("session_id is not null and turn_id is not null")
    return metering.without_covered(turns, read_table(spark, sf_dir, "model_usage"), ["session_id", "turn_id"]).select("row_id")


def start_complete(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("call"), F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "completed").alias("kind"), "event_id")
    return metering.merge_start_complete(rows.where("kind is not null"), ["user_id", "call"], "kind", "event_id")


# --- links between sessions ----------------------------------------------------------


def _all_links(spark, sf_dir):
    return read_table(spark, sf_dir, "agent_session").select("id", F.col("parent_id").alias("parent"))


def owner_walk(spark, sf_dir):
    return relations.owners(_all_links(spark, sf_dir))


def family_closure(spark, sf_dir):
    return relations.family(_all_links(spark, sf_dir))


def session_groups(spark, sf_dir):
    """Sessions that links to existing parents connect, whatever the task type."""
    links = _all_links(spark, sf_dir)
    ids = links.select(F.col("id").alias("node")).where("node is not null").distinct()
    edges = links.join(ids, F.col("parent") == F.col("node"), "left_semi").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return graphs.components(edges, ids)


def inherited_copies(spark, sf_dir):
    """Records whose call, known by its request and attempt, a session that this one was forked from has already."""
    call = F.concat_ws("#", F.lower(F.btrim("logical_request_id")), F.coalesce("attempt_index", F.lit(0)).cast("string"))
    usage = read_table(spark, sf_dir, "model_usage").select(F.col("row_id").alias("record_id"), "session_id", F.when(F.btrim("logical_request_id") != "", call).alias("call_id"))
    sessions = read_table(spark, sf_dir, "agent_session")
    return relations.inherited_copies(usage, sessions.select("id", F.when(F.col("task_type") == "fork", F.col("parent_id")).alias("parent")))


def time_presets(spark, sf_dir):
    """Lower bounds of quick ranges in a zone with clock changes."""
    rows = read_table(spark, sf_dir, "saved_query").select("row_id", F.expr("try_cast(upto as timestamp)").alias("cutoff"))
    rows = rows.where("cutoff is not null").withColumn("preset", F.explode(F.array(*map(F.lit, ("today", "week", "month", "last_1d", "last_7d", "all")))))
    return rows.select("row_id", "preset", metering.preset_start(F.col("preset"), F.col("cutoff"), "America/New_York").alias("since"))


QUERIES = {
    f.__name__: f
    for f in (
        usage_cells, usage_by_group, usage_by_status, usage_views, usage_internal, usage_daily, usage_daily_sessions, usage_day_models, usage_unbucketed, usage_dispositions, usage_partition,
        usage_reconciled, usage_rankings, usage_export, session_index, session_status, turn_spans, turn_wall, duration_groups, latency_outcomes, latency_by_model, throughput_outcomes,
        throughput_by_day, context_fill, context_reset, counter_differences, reply_epochs, without_direct, start_complete, owner_walk, family_closure, session_groups, inherited_copies, time_presets,
    )
}

# --- SQL ------------------------------------------------------------------------------


def _j(key: str) -> str:
    return f"""CASE WHEN u IS NULL OR json_type(u, '$.{key}') IS NULL OR json_type(u, '$.{key}') = 'NULL' THEN NULL WHEN json_type(u, '$.{key}') IN ('UBIGINT', 'BIGINT') AND CAST(u->>'$.{key}' AS BIGINT) >= 0 THEN CAST(u->>'$.{key}' AS BIGINT) END"""


def _s(key: str) -> str:
    return f"""CASE WHEN u IS NULL OR json_type(u, '$.{key}') IS NULL OR json_type(u, '$.{key}') = 'NULL' THEN 'unknown' WHEN json_type(u, '$.{key}') IN ('UBIGINT', 'BIGINT') AND CAST(u->>'$.{key}' AS BIGINT) >= 0 THEN 'reported' ELSE 'conflict' END"""


def _records(timed: bool) -> str:
    """CTEs up to ``k``, a record with its cells in each row; ``timed`` adds the start in whatever spelling."""
    if not timed:
        return "WITH " + _CELLS.format(columns="*", source="model_usage")
    given = "SELECT 'model_usage' AS src, row_id, started_at AS v, recorded_tz AS z FROM model_usage"
    return f"WITH {times_sql.instants(given)}, " + _CELLS.format(
        columns="m.*, utc_us // 1000 AS started_ms, greatest(1, unit_us // 1000) AS started_unit_ms", source="model_usage m LEFT JOIN instant ON instant.row_id = m.row_id"
    )


_CELLS = f"""raw AS (
  SELECT {{columns}}, CASE WHEN query_source = 'main_turn' THEN 'main' WHEN query_source IN ('subagent', 'workflow_child') THEN 'child'
    WHEN query_source IN ('compact', 'session_title', 'web_fetch_processing', 'web_search_tool') THEN 'internal' ELSE 'unknown' END AS grp,
    CASE WHEN json_valid(raw_usage_json) THEN CAST(raw_usage_json AS JSON) END AS u FROM {{source}}),
c1 AS (SELECT *, {_j('inputTokens')} AS iv, {_s('inputTokens')} AS ist, {_j('outputTokens')} AS ov, {_s('outputTokens')} AS ost, {_j('cacheReadTokens')} AS cv0, {_s('cacheReadTokens')} AS cst0,
  json_type(u, '$.totalTokens') IS NOT NULL AS has_total, {_j('totalTokens')} AS tv0, coalesce(provider_id IN ('builtin:nimbus-plan', 'tern-cloud'), false) AS ok FROM raw),
c2 AS (SELECT *, iv IS NOT NULL AND cv0 IS NOT NULL AND cv0 > iv AS over_, iv IS NOT NULL AND ov IS NOT NULL AS both_ FROM c1),
c3 AS (SELECT *, CASE WHEN over_ THEN NULL ELSE cv0 END AS cv, CASE WHEN over_ THEN 'conflict' ELSE cst0 END AS cst,
  CASE WHEN iv IS NOT NULL AND cv0 IS NOT NULL AND NOT over_ THEN iv - cv0 END AS nv, CASE WHEN iv IS NOT NULL AND cv0 IS NOT NULL AND NOT over_ THEN 'derived' ELSE 'unknown' END AS nst,
  CASE WHEN both_ AND NOT (has_total AND coalesce(tv0 <> iv + ov, true)) THEN iv + ov END AS tv,
  CASE WHEN NOT both_ THEN 'unknown' WHEN has_total AND coalesce(tv0 <> iv + ov, true) THEN 'conflict' ELSE 'derived' END AS tst FROM c2),
w AS (SELECT *, CASE ist WHEN 'unknown' THEN 'not reported' WHEN 'conflict' THEN 'not a non-negative integer' ELSE '' END AS iw, CASE ost WHEN 'unknown' THEN 'not reported' WHEN 'conflict' THEN 'not a non-negative integer' ELSE '' END AS ow,
  CASE WHEN over_ THEN 'cache exceeds input' WHEN cst0 = 'unknown' THEN 'not reported' WHEN cst0 = 'conflict' THEN 'not a non-negative integer' ELSE '' END AS cw,
  CASE nst WHEN 'unknown' THEN 'not reported' ELSE '' END AS nw, CASE tst WHEN 'unknown' THEN 'not reported' WHEN 'conflict' THEN 'total differs from input plus output' ELSE '' END AS tw FROM c3),
r AS (SELECT * EXCLUDE (iw, ow, cw, nw, tw, ist, ost, cst, nst, tst),
  CASE WHEN ok THEN ist ELSE 'unknown' END AS ist, CASE WHEN ok THEN ost ELSE 'unknown' END AS ost, CASE WHEN ok THEN cst ELSE 'unknown' END AS cst, CASE WHEN ok THEN nst ELSE 'unknown' END AS nst, CASE WHEN ok THEN tst ELSE 'unknown' END AS tst,
  CASE WHEN ok THEN iw ELSE 'provider not verified' END AS iw, CASE WHEN ok THEN ow ELSE 'provider not verified' END AS ow, CASE WHEN ok THEN cw ELSE 'provider not verified' END AS cw,
  CASE WHEN ok THEN nw ELSE 'provider not verified' END AS nw, CASE WHEN ok THEN tw ELSE 'provider not verified' END AS tw FROM w),
k AS (SELECT *, ist IN ('reported', 'derived') AND iv IS NOT NULL AS ik, ost IN ('reported', 'derived') AND ov IS NOT NULL AS ok_, cst IN ('reported', 'derived') AND cv IS NOT NULL AS ck,
  nst IN ('reported', 'derived') AND nv IS NOT NULL AS nk, tst IN ('reported', 'derived') AND tv IS NOT NULL AS tk FROM r)
"""
_RECORDS, _TIMED = _records(False), _records(True)
_SHORT = {"input": ("iv", "ik", "iw"), "output": ("ov", "ok_", "ow"), "cache_read": ("cv", "ck", "cw"), "non_cache_read": ("nv", "nk", "nw"), "total": ("tv", "tk", "tw")}


def _agg(by: str, metrics=tuple(_SHORT), source: str = "k", calls: str = "1") -> str:
    parts = []
    for m in metrics:
        v, k, w = _SHORT[m]
        parts.append(
            f"CAST(sum(CASE WHEN {k} THEN {v} END) AS BIGINT) AS {m}, count(*) FILTER ({k}) AS {m}_known, "
            f"CASE WHEN count(*) FILTER ({k}) = 0 THEN 'unknown' WHEN count(*) FILTER ({k}) = count(*) THEN 'known' ELSE 'partial' END AS {m}_state, "
            f"coalesce(string_agg(DISTINCT {w}, '; ' ORDER BY {w}) FILTER ({w} <> ''), '') AS {m}_reasons"
        )
    pair = "ik AND ck"
    return f"""SELECT {by}, count(*) AS records, {', '.join(parts)},
  CASE WHEN sum(iv) FILTER ({pair}) > 0 THEN sum(cv) FILTER ({pair}) / sum(iv) FILTER ({pair}) END AS hit_rate,
  CASE WHEN count(*) FILTER ({pair}) > 0 AND sum(iv) FILTER ({pair}) = 0 THEN 'not_applicable' WHEN count(*) FILTER ({pair}) = 0 THEN 'unknown' WHEN count(*) FILTER ({pair}) = count(*) THEN 'known' ELSE 'partial' END AS hit_rate_state,
  CASE WHEN count({calls}) = count(*) THEN CAST(sum({calls}) AS BIGINT) END AS calls, CAST(coalesce(sum({calls}), 0) AS BIGINT) AS known_calls
FROM {source} GROUP BY ALL"""


_DISP = f"CASE WHEN completed_at IS NULL THEN 'no_time' WHEN completed_at = {UPTO} THEN 'at_cutoff' WHEN completed_at > {UPTO} THEN 'after' WHEN completed_at < {SINCE} THEN 'before' ELSE 'in_range' END"
_DAYS = _TIMED + f""", d0 AS (SELECT *, CAST(make_timestamp((completed_at + 28800000) * 1000) AS DATE) AS d FROM k WHERE completed_at >= {SINCE} AND completed_at < {UPTO}),
dd AS (SELECT *, CASE WHEN started_ms < greatest(epoch_ms(CAST(d AS TIMESTAMP)) - 28800000, {SINCE}) THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS day FROM d0)
"""
_LAT = f"""CASE WHEN started_ms IS NULL OR first_token_at IS NULL THEN 'missing: start or first token' WHEN tool_call_count IS NULL THEN 'missing: tool call count' WHEN tool_call_count > 0 THEN 'unsupported: tool arguments'
 WHEN first_token_at < started_ms THEN 'conflict: first token before start' WHEN time_to_first_token_ms < 0 THEN 'conflict: native latency' WHEN time_to_first_token_ms <> first_token_at - started_ms THEN 'conflict: native latency differs'
 WHEN first_token_at >= {UPTO} OR first_token_at < {SINCE} THEN 'range: first token' END"""
_THR = f"""CASE WHEN NOT ok_ THEN 'missing: output' WHEN first_token_at IS NULL THEN 'missing: first token' WHEN completed_at IS NULL THEN 'missing: completion' WHEN retry_count IS NULL THEN 'missing: retry count'
 WHEN retry_count <> 0 THEN 'unsupported: retried' WHEN tool_call_count IS NULL THEN 'missing: tool call count' WHEN tool_call_count > 0 THEN 'unsupported: tool arguments' WHEN completed_at - first_token_at <= 0 THEN 'conflict: empty interval'
 WHEN completed_at >= {UPTO} OR completed_at < {SINCE} THEN 'range: completion' END"""
_LINKS = """
WITH RECURSIVE n AS (SELECT id, min(parent_id) AS p FROM agent_session WHERE id IS NOT NULL GROUP BY id), e AS (SELECT n.id, k.id AS p FROM n LEFT JOIN n k ON k.id = n.p),
down AS (SELECT id, id AS root_id, 0 AS hops FROM e WHERE p IS NULL UNION ALL SELECT e.id, root_id, hops + 1 FROM down JOIN e ON e.p = down.id)
"""
_DUR = "CASE WHEN duration_ms < 0 THEN 'conflict' WHEN completed_at < started_ms THEN 'conflict' WHEN abs(completed_at - started_ms - duration_ms) > started_unit_ms THEN 'conflict' WHEN duration_ms IS NOT NULL OR completed_at - started_ms IS NOT NULL THEN 'known' ELSE 'unknown' END"
_NAMES = [("iv", "ist", "iw", "input"), ("ov", "ost", "ow", "output"), ("cv", "cst", "cw", "cache_read"), ("nv", "nst", "nw", "non_cache_read"), ("tv", "tst", "tw", "total")]
_VIEW = lambda d, i: _agg(f"'{d}' AS dimension, {i} AS identity")
_GROUP_SQL = _RECORDS + _agg("grp")
_SESSIONS_SQL = _DAYS + "SELECT day, count(DISTINCT session_id) AS sessions, count(*) AS records FROM dd WHERE day IS NOT NULL GROUP BY day"
_DISP_SQL = f"SELECT {_DISP} AS disposition, count(*) AS n FROM model_usage GROUP BY 1"

ORACLES = {
    "session_groups": """WITH RECURSIVE n AS (SELECT id, min(parent_id) AS p FROM agent_session WHERE id IS NOT NULL GROUP BY id), e AS (SELECT n.id, k.id AS p FROM n LEFT JOIN n k ON k.id = n.p),
      up AS (SELECT id, p AS anc FROM e WHERE p IS NOT NULL UNION SELECT up.id, e.p FROM up JOIN e ON e.id = up.anc WHERE e.p IS NOT NULL),
      top AS (SELECT id, id AS t FROM e WHERE p IS NULL UNION ALL SELECT up.id, up.anc FROM up JOIN e ON e.id = up.anc WHERE e.p IS NULL
        UNION ALL SELECT id, min(anc) FROM up WHERE anc IN (SELECT id FROM up WHERE id = anc) GROUP BY id)
      SELECT id AS node, min(id) OVER (PARTITION BY t) AS grp FROM top""",
    "usage_cells": _RECORDS + "SELECT row_id, " + ", ".join(f"{v} AS {n}_value, {s} AS {n}_state, {w} AS {n}_reason" for v, s, w, n in _NAMES) + " FROM k",
    "usage_by_group": _GROUP_SQL,
    "usage_by_status": _RECORDS + _agg("status, grp", calls="retry_count"),
    "usage_views": _RECORDS + " UNION ALL ".join([
        _VIEW("model", "coalesce(provider_id, '') || '/' || coalesce(model_id, '')"), _VIEW("source", "coalesce(query_source, '')"),
        _VIEW("session", "coalesce(session_id, '')"), _VIEW("turn", "coalesce(session_id, '') || '/' || coalesce(turn_id, '')")]),
    "usage_internal": _RECORDS + _agg("query_source", ("input", "output", "total"), "(SELECT * FROM k WHERE grp = 'internal')"),
    "usage_daily": _DAYS + _agg("day, grp", ("input", "output", "total"), "(SELECT * FROM dd WHERE day IS NOT NULL)"),
    "usage_daily_sessions": _SESSIONS_SQL,
    "usage_day_models": _DAYS + _agg("day, model_id", ("output",), "(SELECT * FROM dd WHERE day IS NOT NULL)"),
    "usage_unbucketed": _DAYS + _agg("grp", ("input", "output", "total"), "(SELECT * FROM dd WHERE day IS NULL)"),
    "usage_dispositions": _DISP_SQL,
    "usage_partition": _DAYS + "SELECT CASE WHEN day IS NULL THEN 'unbucketed' ELSE 'days' END AS part, count(*) AS n, count(row_id) AS rows FROM dd GROUP BY 1",
    "usage_reconciled": _RECORDS + """SELECT session_id, lower(trim(logical_request_id)) AS call, attempt_index, count(*) AS copies,
      CASE WHEN count(DISTINCT (coalesce(iv, -1), ist, iw)) = 1 THEN arg_min(iv, row_id) END AS input_value, CASE WHEN count(DISTINCT (coalesce(iv, -1), ist, iw)) = 1 THEN min(ist) ELSE 'conflict' END AS input_state,
      CASE WHEN count(DISTINCT (coalesce(ov, -1), ost, ow)) = 1 THEN arg_min(ov, row_id) END AS output_value, CASE WHEN count(DISTINCT (coalesce(ov, -1), ost, ow)) = 1 THEN min(ost) ELSE 'conflict' END AS output_state
      FROM k WHERE session_id IS NOT NULL AND attempt_index IS NOT NULL AND trim(logical_request_id) <> '' GROUP BY 1, 2, 3""",
    "usage_rankings": _RECORDS + "SELECT model_id, CAST(sum(CASE WHEN tk THEN tv END) AS BIGINT) AS total, CASE WHEN count(*) FILTER (tk) = 0 THEN 'unknown' WHEN count(*) FILTER (tk) = count(*) THEN 'known' ELSE 'partial' END AS total_state, count(*) AS records FROM k WHERE model_id IS NOT NULL GROUP BY 1",
    "usage_export": f"SELECT 'group' AS row_type, grp AS name, records, total, NULL AS sessions FROM ({_GROUP_SQL}) UNION ALL SELECT 'day', day, records, NULL, sessions FROM ({_SESSIONS_SQL}) UNION ALL SELECT 'disposition', disposition, n, NULL, NULL FROM ({_DISP_SQL})",
    "session_index": """WITH t AS (SELECT session_id AS id, count(DISTINCT turn_id) AS turns, max(completed_at) AS last_end FROM turn_usage WHERE session_id IS NOT NULL GROUP BY 1),
      u AS (SELECT session_id AS id, count(*) AS n FROM model_usage WHERE session_id IS NOT NULL GROUP BY 1), s AS (SELECT id, min(time_created) AS created FROM agent_session WHERE id IS NOT NULL GROUP BY 1)
      SELECT s.id AS session_id, created, coalesce(turns, 0) AS turns, last_end, coalesce(n, 0) AS usage_records FROM s LEFT JOIN t ON t.id = s.id LEFT JOIN u ON u.id = s.id""",
    "session_status": _RECORDS + """, t AS (SELECT session_id AS id, bool_and(completed_at IS NOT NULL) AS ended, bool_and(coalesce(model_request_count = 0, false)) AS quiet FROM turn_usage WHERE session_id IS NOT NULL GROUP BY 1),
      us AS (SELECT session_id AS id, count(*) AS n, count(*) FILTER (tk) AS wt FROM k WHERE session_id IS NOT NULL GROUP BY 1), s AS (SELECT DISTINCT id FROM agent_session WHERE id IS NOT NULL)
      SELECT s.id AS session_id, CASE WHEN coalesce(ended AND quiet, false) AND n IS NULL THEN 'confirmed_zero' WHEN wt > 0 THEN 'partial' WHEN n > 0 THEN 'count_only' ELSE 'unstatisticable' END AS state FROM s LEFT JOIN t ON t.id = s.id LEFT JOIN us ON us.id = s.id""",
    "turn_spans": f"""SELECT row_id, CASE WHEN started_at IS NULL AND completed_at IS NULL THEN false WHEN started_at IS NOT NULL AND completed_at IS NOT NULL THEN started_at < {UPTO} AND completed_at > {SINCE} WHEN started_at IS NOT NULL THEN started_at < {UPTO} AND started_at >= {SINCE} ELSE completed_at <= {UPTO} AND completed_at > {SINCE} END AS intersects,
      CASE WHEN started_at IS NULL AND completed_at IS NULL THEN 'no bounds' WHEN started_at IS NOT NULL AND completed_at IS NOT NULL THEN NULL WHEN started_at IS NOT NULL THEN CASE WHEN started_at < {SINCE} THEN 'start only, before the range' END WHEN completed_at <= {SINCE} THEN NULL ELSE 'end only' END AS unproven,
      CASE WHEN completed_at < started_at THEN 'conflict' WHEN coalesce(started_at < {SINCE}, false) AND coalesce(completed_at > {UPTO}, false) THEN 'extends_both' WHEN started_at < {SINCE} THEN 'extends_before' WHEN completed_at > {UPTO} THEN 'extends_after' ELSE 'in_range' END AS span,
      CASE WHEN completed_at IS NOT NULL THEN CASE WHEN completed_at < {UPTO} THEN 'ended_before_cutoff' ELSE 'ended_after_cutoff' END WHEN started_at < {UPTO} THEN 'not_confirmed_ended_at_cutoff' ELSE 'unknown_at_cutoff' END AS cutoff FROM turn_usage""",
    "turn_wall": f"""WITH g AS (SELECT session_id, count(*) AS members, count(*) FILTER (completed_at < started_at) AS reversed, count(*) FILTER (started_at IS NULL OR completed_at IS NULL) AS missing, count(*) FILTER (completed_at >= {UPTO}) AS late, min(started_at) AS a, max(completed_at) AS b FROM turn_usage WHERE session_id IS NOT NULL GROUP BY 1),
      h AS (SELECT *, CASE WHEN reversed > 0 THEN 'conflict' WHEN missing > 0 OR late > 0 THEN 'unknown' ELSE 'known' END AS state FROM g) SELECT session_id, members, reversed, missing, late, state, CASE WHEN state = 'known' THEN b - a END AS wall_ms FROM h""",
    "duration_groups": _TIMED + f"""SELECT grp, count(*) AS records, count(*) FILTER (s = 'known') AS valid, count(*) FILTER (s = 'conflict') AS conflict, count(*) FILTER (s = 'unknown') AS missing, CAST(sum(CASE WHEN s = 'known' THEN coalesce(duration_ms, completed_at - started_ms) END) AS BIGINT) AS total_ms,
      CASE WHEN count(*) FILTER (s = 'known') = count(*) THEN 'complete' WHEN count(*) FILTER (s = 'known') > 0 THEN 'known_subset' ELSE 'unknown' END AS state FROM (SELECT *, {_DUR} AS s FROM k) GROUP BY 1""",
    "latency_outcomes": _TIMED + f"SELECT coalesce({_LAT}, 'sample') AS outcome, count(*) AS n FROM k GROUP BY 1",
    "latency_by_model": _TIMED + f"SELECT model_id, count(*) AS samples, CAST(sum(first_token_at - started_ms) AS BIGINT) AS total_ms, sum(first_token_at - started_ms) / count(*) AS mean_ms FROM k WHERE ({_LAT}) IS NULL GROUP BY 1",
    "throughput_outcomes": _RECORDS + f"SELECT coalesce({_THR}, 'sample') AS outcome, count(*) AS n FROM k GROUP BY 1",
    "throughput_by_day": _RECORDS + f"SELECT strftime(make_timestamp((completed_at + 28800000) * 1000), '%Y-%m-%d') AS day, count(*) AS samples, CAST(sum(ov) AS BIGINT) AS output, CAST(sum(completed_at - first_token_at) AS BIGINT) AS interval_ms, sum(ov) * 1000 / sum(completed_at - first_token_at) AS per_second FROM k WHERE ({_THR}) IS NULL GROUP BY 1",
    "context_fill": "SELECT row_id, last_value(provider_id IGNORE NULLS) OVER w AS ctx_provider_id, last_value(query_source IGNORE NULLS) OVER w AS ctx_query_source FROM model_usage WINDOW w AS (PARTITION BY session_id, turn_id ORDER BY row_id ROWS UNBOUNDED PRECEDING)",
    "context_reset": "SELECT event_id, (last_value(CASE WHEN event_type = 'signup' THEN {'p': props} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)).p AS ctx_props FROM events",
    "counter_differences": """WITH x AS (SELECT event_id, user_id, CAST(CAST(props AS JSON)->>'$.k' AS BIGINT) AS k FROM events), y AS (SELECT *, lag(k) OVER w AS b, row_number() OVER w = 1 AS f FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      z AS (SELECT *, CASE WHEN f AND k > 0 THEN 'no baseline' WHEN k < b THEN 'reset' END AS issue FROM y) SELECT event_id, CASE WHEN issue IS NULL THEN CASE WHEN f THEN k ELSE k - b END END AS delta_k, issue FROM z""",
    "reply_epochs": "WITH x AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM events) SELECT user_id, CAST(e AS BIGINT) AS epoch, count(*) AS n, count(*) FILTER (event_type = 'click') = 1 AS one_click FROM x GROUP BY 1, 2",
    "without_direct": "SELECT row_id FROM turn_usage t WHERE session_id IS NOT NULL AND turn_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM model_usage m WHERE m.session_id = t.session_id AND m.turn_id = t.turn_id)",
    "start_complete": """WITH x AS (SELECT user_id, CAST(props AS JSON)->>'$.k' AS call, CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'completed' END AS kind, event_id FROM events),
      g AS (SELECT user_id, call, min(event_id) FILTER (kind = 'started') AS started, max(event_id) FILTER (kind = 'completed') AS completed, count(*) FILTER (kind = 'started') AS starts, count(*) FILTER (kind = 'completed') AS completions FROM x WHERE kind IS NOT NULL GROUP BY 1, 2)
      SELECT *, CASE WHEN starts > 1 OR completions > 1 THEN 'conflict' WHEN started IS NULL THEN 'start missing' WHEN completed IS NULL THEN 'running' WHEN completed < started THEN 'conflict' ELSE 'complete' END AS state FROM g""",
    "owner_walk": _LINKS + "SELECT id AS node_id, root_id AS owner_id, hops, CASE WHEN hops = 0 THEN 'root' ELSE 'owned' END AS state FROM down UNION ALL SELECT id, NULL, NULL, 'cycle' FROM e WHERE id NOT IN (SELECT id FROM down)",
    "family_closure": _LINKS + "SELECT root_id, id AS node_id FROM down",
    "inherited_copies": _LINKS.replace("min(parent_id)", "min(CASE WHEN task_type = 'fork' THEN parent_id END)") + """, pairs AS (SELECT id AS node_id, p AS anc FROM e WHERE p IS NOT NULL AND id IN (SELECT id FROM down) UNION ALL SELECT node_id, e.p FROM pairs JOIN e ON e.id = anc WHERE e.p IS NOT NULL),
      m AS (SELECT row_id, session_id, lower(trim(logical_request_id)) || '#' || coalesce(attempt_index, 0) AS c FROM model_usage WHERE trim(logical_request_id) <> ''), calls AS (SELECT DISTINCT session_id, c FROM m)
      SELECT DISTINCT m.row_id AS record_id FROM m JOIN pairs ON pairs.node_id = m.session_id JOIN calls k ON k.session_id = anc AND k.c = m.c""",
    "time_presets": """WITH q AS (SELECT row_id, TRY_CAST(upto AS TIMESTAMPTZ) AS c FROM saved_query), x AS (SELECT row_id, c, unnest(['today', 'week', 'month', 'last_1d', 'last_7d', 'all']) AS preset FROM q WHERE c IS NOT NULL)
      SELECT row_id, preset, CASE preset WHEN 'today' THEN timezone('America/New_York', date_trunc('day', timezone('America/New_York', c))) WHEN 'week' THEN timezone('America/New_York', date_trunc('week', timezone('America/New_York', c)))
        WHEN 'month' THEN timezone('America/New_York', date_trunc('month', timezone('America/New_York', c))) WHEN 'last_1d' THEN c - INTERVAL 24 HOUR WHEN 'last_7d' THEN c - INTERVAL 168 HOUR END AS since FROM x""",
}
