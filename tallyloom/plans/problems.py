"""Queries for the general problems 1 to 4 and 6 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import delivery, hierarchy, intervals, references, timestamps
from tallyloom.plans import times_sql
from tallyloom.session import read_table

MESSAGE = ("session_id", "logical_request_id", "attempt_index", "row_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = read_table(spark, sf_dir, "model_usage").select(F.lit("model_usage").alias("src"), "row_id", F.col("started_at").alias("v"), F.col("recorded_tz").alias("z"))
    query = read_table(spark, sf_dir, "saved_query").select(F.lit("saved_query").alias("src"), "row_id", F.col("since").alias("v"), F.col("tz").alias("z"))
    return timestamps.normalise_times(usage.unionByName(query), "v", "z", ["src", "row_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.usage_references(*(read_table(spark, sf_dir, t) for t in ("model_usage", "turn_usage", "agent_session")))


def p2_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("ref_table", "ref_field", "state", "ref_month").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.session_hierarchy(read_table(spark, sf_dir, "agent_session"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = hierarchy.session_links(read_table(spark, sf_dir, "agent_session"))
    return hierarchy.descendants(hierarchy.hierarchy(links, "id", "parent"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "turn_usage").where(F.col("session_id").isNotNull())
    cues = read_table(spark, sf_dir, "subtitle_cue").where(F.col("media_id").isNotNull() & F.col("track_no").isNotNull())
    a = turns.select(F.lit("turn_usage").alias("src"), F.col("session_id").alias("entity_id"), F.col("started_at").alias("from_ms"), F.col("completed_at").alias("upto_ms"))
    b = cues.select(F.lit("subtitle_cue").alias("src"), F.concat_ws("#", "media_id", F.col("track_no").cast("string")).alias("entity_id"), whole_ms("cue_start").alias("from_ms"), whole_ms("cue_end").alias("upto_ms"))
    return intervals.periods_and_gaps(a.unionByName(b), ["src", "entity_id"])


def whole_ms(seconds: str):
    """Seconds as whole milliseconds; values that are no number or out of range give null."""
    value = F.col(seconds)
    fine = ~F.isnan(value) & (F.abs(value) < 9e12)
    return F.when(fine, F.round(value * 1000).cast("long"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.copy_pairs(delivery.copies(read_table(spark, sf_dir, "model_usage"), *MESSAGE))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.delivered_once(read_table(spark, sf_dir, "model_usage"), *MESSAGE).select("row_id", "session_id", "logical_request_id", "attempt_index", "retry_count")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_by_month, p3_found, p3_descendants, p4_found, p6_found, p6_kept)}

_P2 = """
WITH s AS (SELECT id, min(ingested_at) AS seen, min(deleted_at) AS gone FROM agent_session GROUP BY id),
t AS (SELECT session_id AS sid, turn_id AS tid, min(ingested_at) AS seen FROM turn_usage WHERE session_id IS NOT NULL AND turn_id IS NOT NULL GROUP BY ALL),
refs AS (
  SELECT 'model_usage' AS ref_table, 'session_id' AS ref_field, row_id, session_id AS k, ingested_at FROM model_usage WHERE session_id <> ''
  UNION ALL SELECT 'turn_usage', 'session_id', row_id, session_id, ingested_at FROM turn_usage WHERE session_id <> ''),
judged AS (
  SELECT ref_table, ref_field, row_id, CASE WHEN s.id IS NULL THEN 'missing' WHEN seen > ingested_at THEN 'late' WHEN gone <= ingested_at THEN 'deleted' END AS state, ingested_at
  FROM refs LEFT JOIN s ON s.id = k
  UNION ALL
  SELECT 'model_usage', 'turn_id', row_id, CASE WHEN t.tid IS NULL THEN 'missing' WHEN seen > ingested_at THEN 'late' END, ingested_at
  FROM model_usage m LEFT JOIN t ON t.sid = m.session_id AND t.tid = m.turn_id WHERE m.turn_id <> '')
SELECT ref_table, ref_field, row_id, state, strftime(timezone('UTC', ingested_at), '%Y-%m') AS ref_month FROM judged WHERE state IS NOT NULL
"""

_P3 = """
WITH RECURSIVE n AS (
  SELECT id, CASE WHEN min(task_type) IN ('subagent_child', 'workflow_child') THEN min(parent_id) END AS p FROM agent_session WHERE id IS NOT NULL GROUP BY id),
e AS (SELECT n.id, k.id AS p FROM n LEFT JOIN n k ON k.id = n.p),
down AS (
  SELECT id, id AS root_id, 0 AS node_depth, id AS node_path FROM e WHERE p IS NULL
  UNION ALL SELECT e.id, root_id, node_depth + 1, node_path || '/' || e.id FROM down JOIN e ON e.p = down.id),
loose AS (SELECT id, p FROM e WHERE id NOT IN (SELECT id FROM down)),
up AS (SELECT id, p AS above FROM loose UNION SELECT up.id, loose.p FROM up JOIN loose ON loose.id = up.above),
cyc AS (SELECT DISTINCT id FROM up WHERE above = id)
"""
_P3_FOUND = _P3 + """
SELECT id AS session_id, root_id, node_depth, node_path FROM down
UNION ALL SELECT id, '', CASE WHEN id IN (SELECT id FROM cyc) THEN -1 ELSE -2 END, '' FROM loose
"""
_P3_DOWN = _P3 + """,
pairs AS (SELECT p AS ancestor_id, id AS node_id, 1 AS distance FROM e WHERE p IS NOT NULL AND id IN (SELECT id FROM down)
  UNION ALL SELECT e.p, node_id, distance + 1 FROM pairs JOIN e ON e.id = ancestor_id WHERE e.p IS NOT NULL)
SELECT ancestor_id, node_id, distance FROM pairs
"""

_P4 = """
WITH v AS (
  SELECT 'turn_usage' AS src, session_id AS entity_id, started_at AS f, completed_at AS u FROM turn_usage WHERE session_id IS NOT NULL
  UNION ALL SELECT 'subtitle_cue', media_id || '#' || track_no, CAST(round(cue_start * 1000) AS BIGINT), CAST(round(cue_end * 1000) AS BIGINT) FROM subtitle_cue),
w AS (SELECT *, max(u) OVER (PARTITION BY src, entity_id ORDER BY f, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v WHERE u > f),
x AS (SELECT *, sum(CASE WHEN b IS NULL OR f > b THEN 1 ELSE 0 END) OVER (PARTITION BY src, entity_id ORDER BY f, u ROWS UNBOUNDED PRECEDING) AS k FROM w),
y AS (SELECT src, entity_id, k, min(f) AS from_ms, max(u) AS upto_ms FROM x GROUP BY src, entity_id, k),
z AS (SELECT *, lag(upto_ms) OVER (PARTITION BY src, entity_id ORDER BY k) AS p FROM y)
SELECT src, entity_id, 'period' AS span, from_ms, upto_ms FROM y UNION ALL SELECT src, entity_id, 'gap', p, from_ms FROM z WHERE p IS NOT NULL
"""

_MESSAGES = """
WITH m AS (SELECT row_id, session_id AS s, attempt_index AS a, lower(trim(logical_request_id)) AS l FROM model_usage
  WHERE session_id IS NOT NULL AND attempt_index IS NOT NULL AND trim(logical_request_id) <> '')
"""

ORACLES = {
    "p1_found": times_sql.P1,
    "p2_found": _P2,
    "p2_by_month": f"SELECT ref_table, ref_field, state, ref_month, count(*) AS n FROM ({_P2}) GROUP BY ALL",
    "p3_found": _P3_FOUND,
    "p3_descendants": _P3_DOWN,
    "p4_found": _P4,
    "p6_found": _MESSAGES + "SELECT x.row_id AS row_id_a, y.row_id AS row_id_b FROM m x JOIN m y ON x.s = y.s AND x.a = y.a AND x.l = y.l AND x.row_id < y.row_id",
    "p6_kept": _MESSAGES + """, again AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY s, a, l ORDER BY row_id) AS k FROM m) WHERE k > 1)
SELECT row_id, session_id, logical_request_id, attempt_index, retry_count FROM model_usage WHERE row_id NOT IN (SELECT row_id FROM again)""",
}
