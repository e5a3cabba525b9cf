"""JSON-lines logs, their damaged lines and their dialects."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.cells import SOURCES_DIFFER
from tallyloom.operators.metering import counter_deltas, forward_fill


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """The lines of all matching files below ``path``: path, line_no (from 1), line, problem.

    problem is null, ``unterminated`` (a last line without line end), ``corrupt``
    (no JSON) or ``no object``.  Blank lines are left out but counted.  Files
    are read in splits, so one of any size spreads over tasks; the lines of
    the splits before give each line its number, and a file whose lines with
    their ends are longer than itself has no end behind its last one.
    """
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    rows = read.select(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("path")
    splits = splits.select(
        "path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), F.sum("n").over(whole).alias("lines"), (F.sum("bytes").over(whole) > F.max("size").over(whole)).alias("open_end")
    )
    numbered = rows.withColumn("k", F.row_number().over(W.partitionBy("path", "block").orderBy("at"))).join(splits, ["path", "block"])
    line_no = F.col("earlier") + F.col("k")
    parsed = F.try_parse_json("line")
    problem = F.when(F.col("open_end") & (line_no == F.col("lines")), "unterminated").when(parsed.isNull(), "corrupt").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "no object")
    out = numbered.select("path", line_no.cast("int").alias("line_no"), F.regexp_replace("line", "\r+$", "").alias("line"), problem.alias("problem"))
    return out.where(F.btrim("line", F.lit(" \t")) != "")


def distinct_paths(paths: list[str]) -> list[str]:
    """Paths without repetitions, sorted; local ones that lead to one file by links count once."""
    real = {}
    for p in sorted(paths):
        real.setdefault(p if ":" in p else os.path.realpath(p), p)
    return sorted(real.values())


def captured(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each path that was asked for: path, bytes, problem (``unreadable`` for one that cannot be read)."""
    asked = spark.createDataFrame([(p,) for p in distinct_paths(paths)], "path string")
    there = [p for p in distinct_paths(paths) if _exists(spark, p)]
    if not there:
        return asked.select("path", F.lit(None).cast("long").alias("bytes"), F.lit("unreadable").alias("problem"))
    found = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:(?://)?", "").alias("found"), F.col("length").alias("bytes"))
    out = asked.join(found, F.regexp_replace("path", "^file:(?://)?", "") == F.col("found"), "left")
    return out.select("path", "bytes", F.when(F.col("found").isNull(), "unreadable").alias("problem"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(target) and not files.getFileStatus(target).isDirectory()


def read_issues(lines: DataFrame) -> DataFrame:
    return lines.where("problem is not null").select("path", "line_no", "problem")


_TOKENS = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cached_input_tokens", "total": "total_tokens"}


def event_log(lines: DataFrame) -> DataFrame:
    """Lines of the event dialect with session, turn, model and provider carried forward inside their file.

    A turn context sets model and provider anew, to null if it has none.
    """
    at = lambda p: F.get_json_object("line", f"$.{p}")
    rows = lines.where("problem is null").select(
        "path", "line_no", "line", at("type").alias("type"), at("timestamp").alias("time"), at("payload.type").alias("event"),
        F.when(at("type") == "session_meta", at("payload.id")).alias("session"),
        F.when(at("type") == "turn_context", at("payload.turn_id")).when(at("payload.type") == "task_started", at("payload.turn_id")).alias("turn"),
        F.when(at("type") == "turn_context", at("payload.model")).alias("model"), F.when(at("type") == "turn_context", at("payload.model_provider_id")).alias("provider"),
    )
    filled = forward_fill(rows, ["path"], ["line_no"], ["session", "turn"])
    filled = forward_fill(filled, ["path"], ["line_no"], ["model", "provider"], F.col("type") == "turn_context")
    return filled.drop("session", "turn", "model", "provider").withColumnsRenamed({f"ctx_{c}": c for c in ("session", "turn", "model", "provider")})


def direct_records(log: DataFrame) -> DataFrame:
    """Usage records that state one call each: call_id, session, turn, model, provider, time, path, line_no and the counts."""
    u = lambda k: F.get_json_object("line", f"$.payload.usage.{k}").try_cast("long")
    rows = log.where("type = 'token_usage_record'")
    return rows.select(
        F.get_json_object("line", "$.payload.response_id").alias("call_id"), F.coalesce(F.get_json_object("line", "$.payload.thread_id"), "session").alias("session"),
        F.coalesce(F.get_json_object("line", "$.payload.turn_id"), "turn").alias("turn"), "model", "provider", "time", "path", "line_no", *[u(k).alias(m) for m, k in _TOKENS.items()],
    )


def counter_records(log: DataFrame) -> DataFrame:
    """Records from cumulative counters: the differences of one counter line to the one before in its file."""
    u = lambda k: F.get_json_object("line", f"$.payload.info.total_token_usage.{k}").try_cast("long")
    rows = log.where("event = 'token_count'").select("path", "line_no", "session", "turn", "model", "provider", "time", *[u(k).alias(m) for m, k in _TOKENS.items()]).where("input is not null")
    return counter_deltas(rows, ["path"], ["line_no"], list(_TOKENS))


def preferred_records(direct: DataFrame, counters: DataFrame) -> DataFrame:
    """Direct records, and counter records of the turns that have no direct one."""
    rest = counters.where("issue is null").join(direct.select("session", "turn").distinct(), ["session", "turn"], "left_anti")
    common = ["session", "turn", "model", "provider", "time", "path", "line_no"]
    return direct.select("call_id", *common, *_TOKENS, F.lit("model_call").alias("granularity")).unionByName(
        rest.select(F.lit(None).cast("string").alias("call_id"), *common, *[F.col(f"delta_{m}").alias(m) for m in _TOKENS], F.lit("interval").alias("granularity"))
    )


def unique_calls(records: DataFrame) -> DataFrame:
    """One record for each call: the first in (path, line_no); counts that differ become null, with the reason in ``conflict``."""
    keyed = records.where("call_id is not null")
    w = F.struct("path", "line_no")
    same = lambda m: F.count_distinct(F.coalesce(m, F.lit(-1))) == 1
    out = keyed.groupBy("call_id").agg(
        F.count("*").alias("copies"), *[F.min_by(c, w).alias(c) for c in records.columns if c not in ("call_id", *_TOKENS)],
        *[F.when(same(m), F.min_by(m, w)).alias(m) for m in _TOKENS], F.when(~(same("input") & same("output") & same("cache_read") & same("total")), SOURCES_DIFFER).alias("conflict"),
    )
    rest = records.where("call_id is null").withColumns({"copies": F.lit(1).cast("long"), "conflict": F.lit(None).cast("string")})
    return out.unionByName(rest)


def tool_events(log: DataFrame) -> DataFrame:
    """Completed items with a duration in nanoseconds: id, session, turn, status, duration_ns, problem."""
    rows = log.where("event = 'item_completed'")
    part = lambda p: F.get_json_object("line", f"$.payload.item.{p}")
    secs, nanos = part("duration.secs").try_cast("long"), part("duration.nanos").try_cast("long")
    bad = part("duration").isNotNull() & (secs.isNull() | nanos.isNull() | (secs < 0) | (nanos < 0) | (nanos >= 1_000_000_000))
    return rows.select(part("id").alias("id"), "session", "turn", part("status").alias("status"), F.when(~bad, secs * 1_000_000_000 + nanos).alias("duration_ns"), F.when(bad, "duration").alias("problem"))


def requests(log: DataFrame) -> DataFrame:
    """User requests, once per session, id and time, with the places they were read at."""
    rows = log.where("type = 'response_item'").where(F.get_json_object("line", "$.payload.role") == "user").select(
        "session", F.get_json_object("line", "$.payload.id").alias("id"), "time", F.concat_ws(":", "path", "line_no").alias("place")
    )
    keyed = rows.where("id is not null").groupBy("session", "id", "time").agg(F.array_sort(F.collect_set("place")).alias("places"))
    return keyed.unionByName(rows.where("id is null").select("session", "id", "time", F.array("place").alias("places")))


def request_dialect(lines: DataFrame) -> DataFrame:
    """Lines of the request dialect: one row for each attempt, null counts where the usage was redacted."""
    at = lambda p: F.get_json_object("line", f"$.{p}")
    rows = lines.where("problem is null").where(at("requestId").isNotNull())
    counts = {"input": "inputTokens", "output": "outputTokens", "cache_read": "cacheReadTokens", "total": "totalTokens"}
    rows = rows.select(
        at("sessionId").alias("session"), at("turnId").alias("turn"), at("requestId").alias("request"), at("attempt").try_cast("int").alias("attempt"), at("querySource").alias("source"),
        at("model.providerId").alias("provider"), at("model.modelId").alias("model"), at("completedAt").alias("time"), "path", "line_no",
        *[at(f"response.usage.{k}").try_cast("long").alias(m) for m, k in counts.items()],
    )
    first = W.partitionBy("session", "request", "attempt").orderBy("path", "line_no")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def file_session(df: DataFrame, path: str) -> DataFrame:
    """Adds ``file_session``: the identifier at the end of a log's file name."""
    return df.withColumn("file_session", F.nullif(F.regexp_extract(path, r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})[^/]*\.jsonl$", 1), F.lit("")))
