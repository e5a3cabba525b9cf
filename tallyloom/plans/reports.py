"""Queries that check reports and put evidence beside their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import cells, compare, metering, reports, textfacts
from tallyloom.plans import texts, usage
from tallyloom.plans.texts import _LINES, _PAIRS, _TITLE
from tallyloom.plans.usage import _RECORDS, _TIMED, SINCE, UPTO
from tallyloom.session import read_table

MESSAGE = ["session_id", "call", "attempt_index"]
#: Markers of work that is not done, and placeholders of blocks.
MARKERS = ["TODO", "[IMG:", "<!--", "```", "~~~", "$$"]


def _usage(spark, sf_dir):
    return read_table(spark, sf_dir, "model_usage")


def _messages(spark, sf_dir):
    return _usage(spark, sf_dir).withColumn("call", F.lower(F.btrim("logical_request_id"))).where("session_id is not null and attempt_index is not null and call <> ''")


def usage_united(spark, sf_dir):
    """Copies of one message as one record with all their sources."""
    out = reports.united(_messages(spark, sf_dir), MESSAGE, ["duration_ms", "retry_count", "status"], ["turn_id", "completed_at"], "row_id")
    return out.withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


def tool_wall(spark, sf_dir):
    """Calls with tools of each session: sum of durations and the span from the first start to the last end."""
    rows = usage.timed_records(spark, sf_dir).where("tool_call_count > 0 and session_id is not null")
    return reports.envelope(rows, ["session_id"], "started_ms", "completed_at")


def tool_totals(spark, sf_dir):
    """Durations of calls with tools: samples, sum, and how many are left out for which reason."""
    value, state = metering.duration_evidence(F.col("duration_ms"), F.col("started_ms"), F.col("completed_at"), F.col("started_unit_ms"))
    rows = usage.timed_records(spark, sf_dir).where("tool_call_count > 0").select(value.alias("v"), F.when(state == "unknown", "missing: duration").when(state == "conflict", "conflict: duration").otherwise("sample").alias("outcome"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("v").alias("total_ms"))


def tool_reports_once(spark, sf_dir):
    """Reports of tools, each once whatever row brought it."""
    key = ["session_id", "turn_id", "model_id", "completed_at", "tool_call_count"]
    return _usage(spark, sf_dir).where("tool_call_count > 0").select(*key).distinct().groupBy("model_id").agg(F.count("*").alias("n"), F.sum("tool_call_count").alias("calls"))


def support_facts(spark, sf_dir):
    """What the records say of five kinds of internal work."""
    facts = _usage(spark, sf_dir).agg(
        F.count(F.when(F.col("retry_count") > 0, 1)).alias("retries"), F.count(F.when(F.col("query_source") == "compact", 1)).alias("compactions"), F.count(F.when(F.col("query_source") == "session_title", 1)).alias("titles"),
        F.count(F.when(F.col("query_source").isin("subagent", "workflow_child"), 1)).alias("children"), F.count(F.when(F.col("query_source") == "workflow_child", 1)).alias("background"),
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("retries", "compactions", "titles", "children", "background")])
    out = facts.select(F.explode(kinds).alias("x")).select("x.*")
    return out.withColumn("status", F.when(F.col("n") == 0, "not_checked").when(F.col("kind") == "retries", "checked_gap").otherwise("checked_available"))


def turn_timeline(spark, sf_dir):
    """Every turn with what it used, and records of no listed turn as rows of their own."""
    turns = read_table(spark, sf_dir, "turn_usage").where("session_id is not null and turn_id is not null").groupBy("session_id", "turn_id").agg(F.min("started_at").alias("begin_ms"), F.max("completed_at").alias("end_ms"), F.lit("turn").alias("row_type"))
    sums = usage.records(spark, sf_dir).groupBy("session_id", "turn_id").agg(F.count("*").alias("records"), F.sum(F.when(cells.known(F.col("total")), F.col("total")["value"])).alias("total"))
    out = turns.join(sums, ["session_id", "turn_id"], "left").withColumn("records", F.coalesce("records", F.lit(0)))
    loose = sums.join(turns.select("session_id", "turn_id"), ["session_id", "turn_id"], "left_anti").withColumn("row_type", F.lit("loose"))
    return out.unionByName(loose, allowMissingColumns=True)


def relation_rows(spark, sf_dir):
    """How each session is tied to another one."""
    rows = read_table(spark, sf_dir, "agent_session").where("id is not null").groupBy("id").agg(F.min("parent_id").alias("parent_id"), F.min("task_type").alias("task_type"))
    there = rows.select(F.col("id").alias("k"))
    out = rows.join(there, F.col("parent_id") == F.col("k"), "left")
    named = F.coalesce(F.col("parent_id") != "", F.lit(False))
    kind = F.when(~named, "none").when(F.col("k").isNull(), "parent missing").when(F.col("task_type") == "fork", "fork").when(F.col("task_type").isin("subagent_child", "workflow_child"), "child").otherwise("link only")
    return out.select(F.col("id").alias("session_id"), kind.alias("relation"), F.when(named, F.col("parent_id")).alias("parent_id"))


def record_evidence(spark, sf_dir):
    """The rule that put each record into its group, counted."""
    source = F.col("query_source")
    rule = F.when(source == "compact", "marked as compaction").when(source == "session_title", "marked as title").when(source == "workflow_child", "child of a workflow").when(source == "subagent", "child by its session")
    rule = rule.when(metering.classify_source(source) == "internal", "marked as internal").when(source == "main_turn", "plain call").otherwise("no known source")
    return _usage(spark, sf_dir).groupBy(metering.classify_source(source).alias("grp"), rule.alias("rule")).agg(F.count("*").alias("n"))


def request_cutoffs(spark, sf_dir):
    """Which requests can serve as a cut-off."""
    rows = _usage(spark, sf_dir).withColumn("request", F.nullif(F.lower(F.btrim("logical_request_id")), F.lit("")))
    out = reports.cutoffs(rows, "request", "completed_at", F.coalesce(F.col("query_source") == "main_turn", F.lit(False)) & F.col("completed_at").isNotNull())
    return out.withColumnRenamed("at", "cutoff_ms")


def turn_rows_checked(spark, sf_dir):
    """Records that end outside the bounds of their turn."""
    turns = read_table(spark, sf_dir, "turn_usage").where("session_id is not null and turn_id is not null").groupBy("session_id", "turn_id").agg(F.min("started_at").alias("a"), F.max("completed_at").alias("b"), F.count("completed_at").alias("n"), F.count("*").alias("m"))
    rows = _usage(spark, sf_dir).select("row_id", "session_id", "turn_id", "completed_at").join(turns, ["session_id", "turn_id"])
    problem = F.when(F.col("completed_at") < F.col("a"), "ends before its turn").when((F.col("n") == F.col("m")) & (F.col("completed_at") > F.col("b")), "ends after its turn")
    return rows.select("row_id", problem.alias("problem")).where("problem is not null")


def keys_checked(spark, sf_dir):
    """Record keys that stand more than once, and whether some rows of a key carry a time to the first token and others do not."""
    out = _usage(spark, sf_dir).where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.count("time_to_first_token_ms").alias("extended"))
    return out.where("n > 1").select("id", "n", ((F.col("extended") == 0) | (F.col("extended") == F.col("n"))).alias("all_or_none"))


def members_uncovered(spark, sf_dir):
    """Records in range that a saved list of members, made without failed calls, does not cover."""
    rows = _usage(spark, sf_dir).where(f"completed_at >= {SINCE} and completed_at < {UPTO}")
    saved = rows.where("status is not null and status <> 'error'")
    return reports.uncovered(rows, saved, ["row_id"])


def usage_keys(spark, sf_dir):
    """The keys of all sound JSON texts, and whether a report may carry them."""
    rows = reports.json_keys(_usage(spark, sf_dir), "row_id", "raw_usage_json")
    return rows.groupBy("name").agg(F.count("*").alias("n")).withColumn("private", F.col("name").isin(reports.PRIVATE_KEYS))


def scopes_merged(spark, sf_dir):
    """The bounds that hold at each saved query of a session."""
    rows = read_table(spark, sf_dir, "saved_query").where("session_id is not null")
    return reports.carried_scope(rows, ["session_id"], ["row_id"], ["since", "upto"]).select("row_id", "now_since", "now_upto")


def channel_values(spark, sf_dir):
    """The number of requests that a turn states against its records."""
    turns = read_table(spark, sf_dir, "turn_usage").where("session_id is not null and turn_id is not null").groupBy("session_id", "turn_id").agg(F.max("model_request_count").alias("stated"), F.lit(True).alias("t"))
    rows = _messages(spark, sf_dir).where("turn_id is not null").select("session_id", "turn_id", "call", "attempt_index").distinct().groupBy("session_id", "turn_id").agg(F.count("*").alias("found"))
    out = turns.join(rows, ["session_id", "turn_id"], "full")
    state = F.when(F.col("t").isNull(), "records only").when(F.col("found").isNull(), "turn only").when(F.col("stated").isNull(), "not stated").when(F.col("stated") == F.col("found"), "equal").otherwise("differs")
    return out.groupBy(state.alias("state")).agg(F.count("*").alias("turns"), F.sum("stated").alias("stated"), F.sum("found").alias("found"))


def candidates_metered(spark, sf_dir):
    """Candidates for latency and whether their tokens are metered."""
    rows = usage.records(spark, sf_dir).where("first_token_at is not null")
    return rows.groupBy("grp", cells.known(F.col("output")).alias("metered")).agg(F.count("*").alias("n"))


def pages_numbered(spark, sf_dir):
    """Pages of each work against the numbers from 1 on: how many are missing, repeated, out of range and without a number."""
    rows = read_table(spark, sf_dir, "image_item").where("media_id is not null")
    have = rows.groupBy("media_id", "item_index").agg(F.count("*").alias("n"))
    top = rows.groupBy("media_id").agg(F.max("item_index").alias("top")).where("top >= 1").select("media_id", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("item_index"))
    both = top.join(have, ["media_id", "item_index"], "full")
    problem = F.when(F.col("item_index").isNull(), "no number").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("item_index") < 1, "out of range")
    problem = F.coalesce(problem, F.lit("right"))
    kinds = ("right", "missing", "repeated", "out of range", "no number")
    return both.groupBy("media_id").agg(*[F.count(F.when(problem == k, 1)).alias(k.replace(" ", "_")) for k in kinds])


def page_coverage(spark, sf_dir):
    """Pages of each work by what came of their text."""
    rows = read_table(spark, sf_dir, "image_item").withColumn("kind", F.when(F.col("ocr_text").isNull(), "no_text").when(F.btrim("ocr_text", F.lit(" \t\r\n")) == "", "blank").when(textfacts.usable(F.col("ocr_text")), "usable").otherwise("poor"))
    kinds = ("usable", "poor", "blank", "no_text")
    return rows.groupBy("media_id").agg(F.count("*").alias("pages"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])


def first_texts(spark, sf_dir):
    """The first text of a media that says anything: title, summary or address."""
    rows = read_table(spark, sf_dir, "media_manifest").where("media_id is not null")
    parts = F.array("title", "summary", "canonical_url", "original_url")
    return rows.select("media_id", F.get(F.filter(parts, lambda x: F.btrim(x) != ""), F.lit(0)).alias("shown")).distinct()


def owners_ambiguous(spark, sf_dir):
    """Works whose texts come from several sources."""
    once = read_table(spark, sf_dir, "documents").where("origin_key is not null and source is not null").select("origin_key", "source").distinct()
    return once.groupBy("origin_key").agg(F.count("*").alias("sources"), F.min("source").alias("first"), F.max("source").alias("last")).where("sources > 1")


def paths_attributed(spark, sf_dir):
    """The page image that the address of each media means."""
    media = read_table(spark, sf_dir, "media_manifest").where("media_id is not null").groupBy("media_id").agg(F.min("canonical_url").alias("path"))
    files = read_table(spark, sf_dir, "image_item").where("url is not null").select(F.col("url").alias("file"))
    entries = media.unionByName(files.select(F.concat(F.lit("page "), "file").alias("media_id"), F.regexp_replace("file", "^https?://[^/]*", "").alias("path")).distinct())
    return reports.attributed(entries.select(F.col("media_id").alias("entry"), "path"), files)


def declared_media(spark, sf_dir):
    """Media that manifests declare against those that have pages or cues."""
    actual = read_table(spark, sf_dir, "image_item").select("media_id").unionByName(read_table(spark, sf_dir, "subtitle_cue").select("media_id"))
    return reports.declared_and_actual(read_table(spark, sf_dir, "media_manifest").select("media_id"), actual, "media_id")


def lengths_checked(spark, sf_dir):
    """Texts whose stated number of characters is not theirs."""
    rows = read_table(spark, sf_dir, "documents").where(~F.col("n_chars").eqNullSafe(F.coalesce(F.length("text"), F.lit(0)).cast("long")))
    return rows.select("doc_id", "n_chars", F.length("text").alias("found"))


def reviews_missing(spark, sf_dir):
    """What every session needs, a turn and a record, and does not have."""
    ids = read_table(spark, sf_dir, "agent_session").where("id is not null").select(F.col("id").alias("session_id")).distinct()
    need = ids.withColumn("kind", F.explode(F.array(F.lit("turn"), F.lit("record"))))
    have = read_table(spark, sf_dir, "turn_usage").select("session_id", F.lit("turn").alias("kind")).unionByName(_usage(spark, sf_dir).select("session_id", F.lit("record").alias("kind")))
    return reports.uncovered(need, have, ["session_id", "kind"])


def sources_outside(spark, sf_dir):
    """Sources of documents that a mix does not name."""
    rows = read_table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    mixes = read_table(spark, sf_dir, "mix_target").select("mix_name", "source").distinct()
    names = mixes.agg(F.array_sort(F.collect_set("mix_name")).alias("names")).first().names  # a table of parameters
    need = rows.select("source", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("mix_name"))
    return reports.uncovered(need, mixes, ["mix_name", "source"]).join(rows, "source")


def template_samples(spark, sf_dir):
    """Three samples of each message that differs only in numbers."""
    lines = textfacts.lines_of(read_table(spark, sf_dir, "documents"), "doc_id", "text").where("line <> ''").select("line", F.regexp_replace("line", "[0-9]+", "N").alias("template")).distinct()
    return reports.bounded(lines, ["template"], ["line"], 3)


def largest_texts(spark, sf_dir):
    """The five longest texts of each source."""
    rows = read_table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", F.length("text").alias("size"))
    return reports.bounded(rows, ["source"], [F.desc("size"), "doc_id"], 5)


def residual_markers(spark, sf_dir):
    """Markers and placeholders that are left in texts."""
    rows = read_table(spark, sf_dir, "documents").where("text is not null")
    known = F.array(*[F.struct(F.lit(m).alias("marker"), ((F.length("text") - F.length(F.replace("text", F.lit(m), F.lit("")))) / len(m)).cast("long").alias("n")) for m in MARKERS])
    blocks = F.regexp_extract_all("text", F.lit(r"(?m)^\[([A-Z]+:[0-9]+)\]$"), F.lit(1))
    a = rows.select("doc_id", F.explode(known).alias("x")).select("doc_id", "x.*").where("n > 0")
    b = rows.select("doc_id", F.explode(blocks).alias("b")).groupBy("doc_id", F.concat(F.lit("["), "b", F.lit("]")).alias("marker")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


def section_instances(spark, sf_dir):
    """Sections of one name in a document, numbered."""
    heads = texts._facts(spark, sf_dir).where("kind = 'heading'")
    return reports.bounded(heads, ["doc_id", "value"], ["ord"], 2**31 - 1).select("doc_id", "line_no", F.col("value").alias("title"), F.col("rank").alias("instance"))


def _paired_facts(spark, sf_dir, kind, columns):
    _, pairs = texts._pairs(spark, sf_dir)
    rows = texts._facts(spark, sf_dir).where(F.col("kind") == kind).select("doc_id", "ord", *columns)
    now = pairs.select("doc_id").join(rows, "doc_id")
    before = pairs.select(F.col("doc_id").alias("d"), "first_doc").join(rows, F.col("first_doc") == F.col("doc_id")).select(F.col("d").alias("doc_id"), "ord", *columns)
    return before, now


def heading_matches(spark, sf_dir):
    """Headings in order against those of the work's first text: level, title with a remark behind it, or missing."""
    before, now = _paired_facts(spark, sf_dir, "heading", ["level", "value"])
    place = lambda df, names: reports.bounded(df, ["doc_id"], ["ord"], 2**31 - 1).select("doc_id", "rank", F.col("level").alias(names[0]), F.col("value").alias(names[1]))
    both = place(before, ("l0", "t0")).join(place(now, ("l1", "t1")), ["doc_id", "rank"], "full")
    outcome = F.when(F.col("l1").isNull(), "missing").when(F.col("l0").isNull(), "added").when(F.col("l0") != F.col("l1"), "level").when(reports.title_matches(F.col("t0"), F.col("t1")), "same").otherwise("title")
    return both.groupBy("doc_id", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def item_differences(spark, sf_dir):
    """List items in order, with their indentation, against those of the work's first text."""
    text = F.concat_ws(" ", F.col("level").cast("string"), F.col("value"))
    before, now = (df.select("doc_id", "ord", text.alias("v")) for df in _paired_facts(spark, sf_dir, "item", ["level", "value"]))
    return compare.first_difference(compare.stream_diff(before, now, ["doc_id"], ["ord"], "v"), ["doc_id"])


def fence_differences(spark, sf_dir):
    """Code block by code block against the work's first text: the first line that differs."""
    before, now = _paired_facts(spark, sf_dir, "fence", ["value"])
    diff = compare.stream_diff(before, now, ["doc_id"], ["ord"], "value")
    a, b = F.split("left_value", "\n", -1), F.split("right_value", "\n", -1)
    lines = F.when(F.col("kind") == "changed", F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b))), lambda k: ~F.get(a, k - 1).eqNullSafe(F.get(b, k - 1)))))
    return diff.select("doc_id", "pos", "kind", lines.alias("first_line"))


def table_differences(spark, sf_dir):
    """Table rows in order against those of the work's first text."""
    before, now = _paired_facts(spark, sf_dir, "table", ["level", "value"])
    text = F.concat_ws(" ", F.col("level").cast("string"), F.col("value"))
    diff = compare.stream_diff(before.select("doc_id", "ord", text.alias("v")), now.select("doc_id", "ord", text.alias("v")), ["doc_id"], ["ord"], "v")
    return diff.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def ranking_lines(spark, sf_dir):
    """Models as lines of text, the largest known total first."""
    rows = usage.usage_rankings(spark, sf_dir).where("total is not null")
    return rows.select("model_id", F.concat(F.col("model_id"), F.lit(": "), F.format_number("total", 0), F.lit(" ("), F.col("total_state"), F.lit(", "), F.format_number("records", 0), F.lit(" records)")).alias("line"))


def media_cards(spark, sf_dir):
    """A card for each media as JSON, of white-listed fields only."""
    rows = read_table(spark, sf_dir, "media_manifest").where("media_id is not null and title is not null").groupBy("media_id").agg(F.min("title").alias("title"), F.min("platform").alias("platform"))
    return rows.select("media_id", F.to_json(F.struct("title", F.coalesce("platform", F.lit("")).alias("platform"))).alias("card"))


QUERIES = {
    f.__name__: f
    for f in (
        usage_united, tool_wall, tool_totals, tool_reports_once, support_facts, turn_timeline, relation_rows, record_evidence, request_cutoffs, turn_rows_checked, keys_checked, members_uncovered, usage_keys, scopes_merged,
        channel_values, candidates_metered, pages_numbered, page_coverage, first_texts, owners_ambiguous, paths_attributed, declared_media, lengths_checked, reviews_missing, sources_outside, template_samples, largest_texts,
        residual_markers, section_instances, heading_matches, item_differences, fence_differences, table_differences, ranking_lines, media_cards,
    )
}

_M = "SELECT *, lower(trim(logical_request_id)) AS call FROM model_usage WHERE session_id IS NOT NULL AND attempt_index IS NOT NULL AND trim(logical_request_id) <> ''"
_TURNS = "SELECT * FROM turn_usage WHERE session_id IS NOT NULL AND turn_id IS NOT NULL"
_GRP = "CASE WHEN query_source = 'main_turn' THEN 'main' WHEN query_source IN ('subagent', 'workflow_child') THEN 'child' WHEN query_source IN ('compact', 'session_title', 'web_fetch_processing', 'web_search_tool') THEN 'internal' ELSE 'unknown' END"
_STATE = "CASE WHEN count({0}) = 0 THEN 'unknown' WHEN min({0}) = max({0}) THEN 'known' ELSE 'conflict' END AS {0}_state, CASE WHEN min({0}) = max({0}) THEN min({0}) END AS {0}"
_DIFFERS = "count(DISTINCT coalesce({0}::VARCHAR, chr(1))) > 1"
_FACTS = _LINES + f", {_PAIRS}, h AS (SELECT doc_id, line_no, kind, line, length(regexp_extract(line, '^ {{0,3}}(#{{1,8}})', 1)) AS level, {_TITLE} AS title FROM p)"
_SIDES = """, a AS (SELECT pr.doc_id, row_number() OVER (PARTITION BY pr.doc_id ORDER BY line_no) AS pos, {v} FROM pr JOIN {t} x ON x.doc_id = pr.first_doc), b AS (SELECT pr.doc_id, row_number() OVER (PARTITION BY pr.doc_id ORDER BY line_no) AS pos, {v} FROM pr JOIN {t} x ON x.doc_id = pr.doc_id),
d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.pos, b.pos) AS pos, a.doc_id AS l, b.doc_id AS r, {pairs} FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos)"""
_KIND = "CASE WHEN l IS NULL THEN 'added' WHEN r IS NULL THEN 'missing' ELSE 'changed' END"
_WIDE_DUR = "CASE WHEN duration_ms < 0 THEN 'conflict: duration' WHEN completed_at < started_ms THEN 'conflict: duration' WHEN abs(completed_at - started_ms - duration_ms) > started_unit_ms THEN 'conflict: duration' WHEN duration_ms IS NOT NULL OR completed_at - started_ms IS NOT NULL THEN 'sample' ELSE 'missing: duration' END"
_FENCE_BLOCKS = ", fb AS (SELECT doc_id, before, string_agg(line, chr(10) ORDER BY line_no) AS value FROM l WHERE NOT f AND before % 2 = 1 GROUP BY 1, 2), fs AS (SELECT doc_id, before + 1 AS before, line_no FROM l WHERE f AND before % 2 = 0), fe AS (SELECT doc_id, before FROM l WHERE f AND before % 2 = 1), fz AS (SELECT fs.doc_id, fs.line_no, coalesce(value, '') AS value FROM fs JOIN fe ON fe.doc_id = fs.doc_id AND fe.before = fs.before LEFT JOIN fb ON fb.doc_id = fs.doc_id AND fb.before = fs.before)"

ORACLES = {
    "usage_united": f"SELECT session_id, call, attempt_index, count(*) AS copies, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS sources, {_STATE.format('duration_ms')}, {_STATE.format('retry_count')}, {_STATE.format('status')}, CASE WHEN NOT ({_DIFFERS.format('turn_id')} OR {_DIFFERS.format('completed_at')}) THEN min(turn_id) END AS turn_id, CASE WHEN NOT ({_DIFFERS.format('turn_id')} OR {_DIFFERS.format('completed_at')}) THEN min(completed_at) END AS completed_at, CASE WHEN {_DIFFERS.format('turn_id')} OR {_DIFFERS.format('completed_at')} THEN 'copies differ in time or turn' END AS issue FROM ({_M}) GROUP BY 1, 2, 3",
    "tool_wall": _TIMED + "SELECT session_id, count(*) AS samples, CAST(sum(completed_at - started_ms) FILTER (completed_at >= started_ms) AS BIGINT) AS total, count(*) FILTER (started_ms IS NULL OR completed_at IS NULL) AS missing, CASE WHEN count(*) FILTER (completed_at < started_ms) > 0 THEN 'conflict' WHEN count(*) FILTER (started_ms IS NULL OR completed_at IS NULL) > 0 THEN 'unknown' ELSE 'known' END AS state, CASE WHEN count(*) FILTER (completed_at < started_ms OR started_ms IS NULL OR completed_at IS NULL) = 0 THEN max(completed_at) - min(started_ms) END AS wall FROM k WHERE tool_call_count > 0 AND session_id IS NOT NULL GROUP BY 1",
    "tool_totals": _TIMED + f"SELECT outcome, count(*) AS n, CAST(sum(CASE WHEN outcome = 'sample' THEN coalesce(duration_ms, completed_at - started_ms) END) AS BIGINT) AS total_ms FROM (SELECT *, {_WIDE_DUR} AS outcome FROM k WHERE tool_call_count > 0) GROUP BY 1",
    "tool_reports_once": "SELECT model_id, count(*) AS n, CAST(sum(tool_call_count) AS BIGINT) AS calls FROM (SELECT DISTINCT session_id, turn_id, model_id, completed_at, tool_call_count FROM model_usage WHERE tool_call_count > 0) GROUP BY 1",
    "support_facts": "WITH f AS (SELECT 'retries' AS kind, count(*) FILTER (retry_count > 0) AS n FROM model_usage UNION ALL SELECT 'compactions', count(*) FILTER (query_source = 'compact') FROM model_usage UNION ALL SELECT 'titles', count(*) FILTER (query_source = 'session_title') FROM model_usage UNION ALL SELECT 'children', count(*) FILTER (query_source IN ('subagent', 'workflow_child')) FROM model_usage UNION ALL SELECT 'background', count(*) FILTER (query_source = 'workflow_child') FROM model_usage) SELECT kind, n, CASE WHEN n = 0 THEN 'not_checked' WHEN kind = 'retries' THEN 'checked_gap' ELSE 'checked_available' END AS status FROM f",
    "turn_timeline": _RECORDS + f", t AS (SELECT session_id, turn_id, min(started_at) AS begin_ms, max(completed_at) AS end_ms FROM ({_TURNS}) GROUP BY 1, 2), s AS (SELECT session_id, turn_id, count(*) AS records, CAST(sum(CASE WHEN tk THEN tv END) AS BIGINT) AS total FROM k GROUP BY 1, 2) SELECT t.session_id, t.turn_id, begin_ms, end_ms, 'turn' AS row_type, coalesce(records, 0) AS records, total FROM t LEFT JOIN s ON s.session_id = t.session_id AND s.turn_id = t.turn_id UNION ALL SELECT session_id, turn_id, NULL, NULL, 'loose', records, total FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.session_id = s.session_id AND t.turn_id = s.turn_id)",
    "relation_rows": "WITH n AS (SELECT id, min(parent_id) AS p, min(task_type) AS t FROM agent_session WHERE id IS NOT NULL GROUP BY 1) SELECT n.id AS session_id, CASE WHEN coalesce(n.p, '') = '' THEN 'none' WHEN k.id IS NULL THEN 'parent missing' WHEN n.t = 'fork' THEN 'fork' WHEN n.t IN ('subagent_child', 'workflow_child') THEN 'child' ELSE 'link only' END AS relation, nullif(n.p, '') AS parent_id FROM n LEFT JOIN n k ON k.id = n.p",
    "record_evidence": f"SELECT {_GRP} AS grp, CASE WHEN query_source = 'compact' THEN 'marked as compaction' WHEN query_source = 'session_title' THEN 'marked as title' WHEN query_source = 'workflow_child' THEN 'child of a workflow' WHEN query_source = 'subagent' THEN 'child by its session' WHEN query_source IN ('web_fetch_processing', 'web_search_tool') THEN 'marked as internal' WHEN query_source = 'main_turn' THEN 'plain call' ELSE 'no known source' END AS rule, count(*) AS n FROM model_usage GROUP BY 1, 2",
    "request_cutoffs": "WITH g AS (SELECT nullif(lower(trim(logical_request_id)), '') AS request, count(*) AS matches, count(*) FILTER (query_source = 'main_turn' AND completed_at IS NOT NULL) AS e, min(completed_at) AS a, max(completed_at) AS b FROM model_usage GROUP BY 1), s AS (SELECT *, CASE WHEN e = 0 THEN 'no eligible match' WHEN a <> b THEN 'several times' WHEN matches > 1 THEN 'several matches' ELSE 'usable' END AS state FROM g WHERE request IS NOT NULL) SELECT request, matches, state, CASE WHEN state = 'usable' THEN a END AS cutoff_ms FROM s",
    "turn_rows_checked": f"WITH t AS (SELECT session_id, turn_id, min(started_at) AS a, max(completed_at) AS b, count(completed_at) = count(*) AS whole FROM ({_TURNS}) GROUP BY 1, 2), x AS (SELECT row_id, CASE WHEN m.completed_at < a THEN 'ends before its turn' WHEN whole AND m.completed_at > b THEN 'ends after its turn' END AS problem FROM model_usage m JOIN t ON t.session_id = m.session_id AND t.turn_id = m.turn_id) SELECT * FROM x WHERE problem IS NOT NULL",
    "keys_checked": "SELECT id, count(*) AS n, count(time_to_first_token_ms) IN (0, count(*)) AS all_or_none FROM model_usage WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "members_uncovered": f"SELECT DISTINCT row_id FROM model_usage WHERE completed_at >= {SINCE} AND completed_at < {UPTO} AND coalesce(status, 'error') = 'error'",
    "usage_keys": "WITH k AS (SELECT row_id, unnest(list_distinct(regexp_extract_all(lower(raw_usage_json), '\"((?:[^\"\\\\]|\\\\.)*)\"\\s*:', 1))) AS name FROM model_usage WHERE json_valid(raw_usage_json)) SELECT name, count(*) AS n, name IN (" + ", ".join(f"'{k}'" for k in reports.PRIVATE_KEYS) + ") AS private FROM k GROUP BY 1",
    "scopes_merged": "SELECT row_id, nullif(last_value(since IGNORE NULLS) OVER w, '') AS now_since, nullif(last_value(upto IGNORE NULLS) OVER w, '') AS now_upto FROM saved_query WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY row_id ROWS UNBOUNDED PRECEDING)",
    "channel_values": f"WITH t AS (SELECT session_id, turn_id, max(model_request_count) AS stated FROM ({_TURNS}) GROUP BY 1, 2), r AS (SELECT session_id, turn_id, count(DISTINCT (call, attempt_index)) AS found FROM ({_M}) WHERE turn_id IS NOT NULL GROUP BY 1, 2) SELECT CASE WHEN t.session_id IS NULL THEN 'records only' WHEN found IS NULL THEN 'turn only' WHEN stated IS NULL THEN 'not stated' WHEN stated = found THEN 'equal' ELSE 'differs' END AS state, count(*) AS turns, CAST(sum(stated) AS BIGINT) AS stated, CAST(sum(found) AS BIGINT) AS found FROM t FULL JOIN r ON r.session_id = t.session_id AND r.turn_id = t.turn_id GROUP BY 1",
    "candidates_metered": _RECORDS + "SELECT grp, ok_ AS metered, count(*) AS n FROM k WHERE first_token_at IS NOT NULL GROUP BY 1, 2",
    "pages_numbered": "WITH r AS (SELECT media_id, item_index, count(*) AS n FROM image_item WHERE media_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT media_id, unnest(range(1, max(item_index) + 1)) AS item_index FROM r GROUP BY media_id HAVING max(item_index) >= 1), x AS (SELECT coalesce(t.media_id, r.media_id) AS media_id, CAST(coalesce(t.item_index, r.item_index) AS INTEGER) AS item_index, n FROM t FULL JOIN r ON r.media_id = t.media_id AND r.item_index = t.item_index), y AS (SELECT media_id, CASE WHEN item_index IS NULL THEN 'no number' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN item_index < 1 THEN 'out of range' ELSE 'right' END AS q FROM x) SELECT media_id, count(*) FILTER (q = 'right') AS \"right\", count(*) FILTER (q = 'missing') AS missing, count(*) FILTER (q = 'repeated') AS repeated, count(*) FILTER (q = 'out of range') AS out_of_range, count(*) FILTER (q = 'no number') AS no_number FROM y GROUP BY 1",
    "page_coverage": "WITH u AS (SELECT media_id, ocr_text, regexp_replace(ocr_text, '\\s', '', 'g') AS d FROM image_item), x AS (SELECT media_id, CASE WHEN ocr_text IS NULL THEN 'no_text' WHEN trim(ocr_text, chr(32) || chr(9) || chr(13) || chr(10)) = '' THEN 'blank' WHEN length(d) >= 20 AND length(regexp_replace(d, '[^\\p{L}\\p{N}]', '', 'g')) / length(d) >= 0.6 THEN 'usable' ELSE 'poor' END AS k FROM u) SELECT media_id, count(*) AS pages, count(*) FILTER (k = 'usable') AS usable, count(*) FILTER (k = 'poor') AS poor, count(*) FILTER (k = 'blank') AS blank, count(*) FILTER (k = 'no_text') AS no_text FROM x GROUP BY 1",
    "first_texts": "SELECT DISTINCT media_id, CASE WHEN trim(title) <> '' THEN title WHEN trim(summary) <> '' THEN summary WHEN trim(canonical_url) <> '' THEN canonical_url WHEN trim(original_url) <> '' THEN original_url END AS shown FROM media_manifest WHERE media_id IS NOT NULL",
    "owners_ambiguous": "SELECT origin_key, count(DISTINCT source) AS sources, min(source) AS first, max(source) AS last FROM documents WHERE origin_key IS NOT NULL AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "paths_attributed": "WITH f AS (SELECT DISTINCT url AS file FROM image_item WHERE url IS NOT NULL), e AS (SELECT media_id AS entry, min(canonical_url) AS path FROM media_manifest WHERE media_id IS NOT NULL GROUP BY 1 UNION ALL SELECT 'page ' || file, regexp_replace(file, '^https?://[^/]*', '') FROM f), n AS (SELECT regexp_extract(file, '([^/]*)$', 1) AS name, count(*) AS n, min(file) AS only_one FROM f GROUP BY 1), j AS (SELECT e.*, f.file, n.n, n.only_one FROM e LEFT JOIN f ON f.file = e.path LEFT JOIN n ON n.name = regexp_extract(e.path, '([^/]*)$', 1)) SELECT entry, CASE WHEN file IS NOT NULL THEN 'path' WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how, CASE WHEN file IS NOT NULL THEN file WHEN n = 1 THEN only_one END AS file FROM j",
    "declared_media": "WITH d AS (SELECT DISTINCT media_id FROM media_manifest WHERE media_id IS NOT NULL), a AS (SELECT media_id FROM image_item WHERE media_id IS NOT NULL UNION SELECT media_id FROM subtitle_cue WHERE media_id IS NOT NULL) SELECT coalesce(d.media_id, a.media_id) AS media_id, CASE WHEN a.media_id IS NULL THEN 'not there' WHEN d.media_id IS NULL THEN 'not declared' ELSE 'both' END AS state FROM d FULL JOIN a ON a.media_id = d.media_id",
    "lengths_checked": "SELECT doc_id, n_chars, length(text)::INTEGER AS found FROM documents WHERE n_chars IS DISTINCT FROM coalesce(length(text), 0)",
    "reviews_missing": "WITH s AS (SELECT DISTINCT id FROM agent_session WHERE id IS NOT NULL) SELECT id AS session_id, 'turn' AS kind FROM s WHERE id NOT IN (SELECT session_id FROM turn_usage WHERE session_id IS NOT NULL) UNION ALL SELECT id, 'record' FROM s WHERE id NOT IN (SELECT session_id FROM model_usage WHERE session_id IS NOT NULL)",
    "sources_outside": "WITH d AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), m AS (SELECT DISTINCT mix_name FROM mix_target) SELECT mix_name, source, n FROM d, m WHERE NOT EXISTS (SELECT 1 FROM mix_target t WHERE t.mix_name = m.mix_name AND t.source = d.source)",
    "template_samples": "WITH l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), t AS (SELECT line, regexp_replace(line, '[0-9]+', 'N', 'g') AS template FROM l WHERE line <> '') SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY line) AS rank FROM t) WHERE rank <= 3",
    "largest_texts": "SELECT * FROM (SELECT source, doc_id, length(text)::INTEGER AS size, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents WHERE text IS NOT NULL) WHERE rank <= 5",
    "residual_markers": "WITH m AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in MARKERS) + "]) AS marker), x AS (SELECT doc_id, marker, CAST((length(text) - length(replace(text, marker, ''))) / length(marker) AS BIGINT) AS n FROM documents, m WHERE text IS NOT NULL), b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT * FROM x WHERE n > 0 UNION ALL SELECT doc_id, line, count(*) FROM b WHERE regexp_full_match(line, '\\[[A-Z]+:[0-9]+\\]') GROUP BY 1, 2",
    "section_instances": _FACTS + "SELECT doc_id, line_no, title, row_number() OVER (PARTITION BY doc_id, title ORDER BY line_no) AS instance FROM h WHERE kind = 'heading'",
    "heading_matches": _FACTS + ", hh AS (SELECT * FROM h WHERE kind = 'heading')" + _SIDES.format(v="level, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title", t="hh", pairs="a.level AS l0, b.level AS l1, a.title AS t0, b.title AS t1") + "SELECT doc_id, CASE WHEN r IS NULL THEN 'missing' WHEN l IS NULL THEN 'added' WHEN l0 <> l1 THEN 'level' WHEN t0 = t1 OR (t0 <> '' AND starts_with(t1, t0) AND regexp_full_match(trim(substr(t1, length(t0) + 1)), '（.+）', 's')) THEN 'same' ELSE 'title' END AS outcome, count(*) AS n FROM d GROUP BY 1, 2",
    "item_differences": _FACTS + ", hh AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(\\s*)', 1)) || ' ' || regexp_extract(line, '^\\s*(?:[-*+]|\\d{1,9}[.)])\\s+(.*)$', 1) AS v FROM h WHERE kind = 'item')" + _SIDES.format(v="v", t="hh", pairs="a.v AS v0, b.v AS v1") + f"SELECT doc_id, CAST(min(pos) AS INTEGER) AS first_pos, count(*) AS n, arg_min({_KIND}, pos) AS kind FROM d WHERE v0 IS DISTINCT FROM v1 GROUP BY 1",
    "fence_differences": _FACTS + _FENCE_BLOCKS + _SIDES.format(v="value", t="fz", pairs="a.value AS v0, b.value AS v1") + f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_KIND} AS kind, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN CAST(list_min(list_filter(range(1, greatest(len(string_split(v0, chr(10))), len(string_split(v1, chr(10)))) + 1), lambda k: string_split(v0, chr(10))[k] IS DISTINCT FROM string_split(v1, chr(10))[k])) AS INTEGER) END AS first_line FROM d WHERE v0 IS DISTINCT FROM v1",
    "table_differences": _FACTS + ", hh AS (SELECT doc_id, line_no, (row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no) - 1) || ' ' || trim(line) AS v FROM (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM p WHERE kind IN ('table', 'rule')) WHERE kind = 'table')" + _SIDES.format(v="v", t="hh", pairs="a.v AS v0, b.v AS v1") + f"SELECT doc_id, {_KIND} AS kind, count(*) AS n, CAST(min(pos) AS INTEGER) AS first_pos FROM d WHERE v0 IS DISTINCT FROM v1 GROUP BY 1, 2",
    "ranking_lines": _RECORDS + "SELECT model_id, model_id || ': ' || format('{:,}', CAST(sum(CASE WHEN tk THEN tv END) AS BIGINT)) || ' (' || CASE WHEN count(*) FILTER (tk) = count(*) THEN 'known' ELSE 'partial' END || ', ' || format('{:,}', count(*)) || ' records)' AS line FROM k WHERE model_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (tk) > 0",
    "media_cards": "SELECT media_id, CAST(json_object('title', min(title), 'platform', coalesce(min(platform), '')) AS VARCHAR) AS card FROM media_manifest WHERE media_id IS NOT NULL AND title IS NOT NULL GROUP BY 1",
}
