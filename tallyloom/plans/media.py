"""Queries on media, subtitle tracks and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import media
from tallyloom.session import read_table
from tallyloom.sources import subtitles

DOMAINS = ["pixleaf.example", "tidemark.example", "barrelbay.example"]


def _cues(spark, sf_dir):
    """Cues of known tracks, each row once."""
    rows = read_table(spark, sf_dir, "subtitle_cue").where("media_id is not null and track_no is not null and cue_no is not null")
    return rows.groupBy("media_id", "track_no", "cue_no", "cue_start", "cue_end", "cue_text", "lang", "kind").agg(F.min("row_id").alias("row_id"))


def media_hosts(spark, sf_dir):
    rows = read_table(spark, sf_dir, "media_manifest").select("platform", media.host_in(F.col("original_url"), DOMAINS).alias("domain"), F.try_parse_url(F.col("original_url"), F.lit("HOST")).alias("host"))
    return rows.groupBy("platform", "domain", "host").agg(F.count("*").alias("n"))


def media_addresses(spark, sf_dir):
    rows = read_table(spark, sf_dir, "media_manifest").where("original_url is not null").select("media_id", "original_url", "canonical_url").distinct()
    same = F.coalesce(media.bare_url(F.col("original_url")) == F.col("canonical_url"), F.lit(False))
    return rows.select("media_id", media.bare_url(F.col("original_url")).alias("bare"), media.content_id(F.col("original_url")).alias("content"), same.alias("canonical"), F.sha2("original_url", 256).alias("digest"))


def track_choice(spark, sf_dir):
    tracks = read_table(spark, sf_dir, "subtitle_cue").where("media_id is not null and track_no is not null").groupBy("media_id", "track_no").agg(F.min("lang").alias("lang"), F.min("kind").alias("kind"))
    return media.best_track(tracks)


def track_quality(spark, sf_dir):
    durations = read_table(spark, sf_dir, "media_manifest").groupBy("media_id").agg(F.max("duration").alias("duration"))
    return media.track_quality(_cues(spark, sf_dir).where("cue_start is not null and cue_end is not null"), durations)


def transcripts(spark, sf_dir):
    return media.transcripts(_cues(spark, sf_dir).where("cue_text is not null"))


def cue_clocks(spark, sf_dir):
    rows = read_table(spark, sf_dir, "subtitle_cue")
    sound = F.coalesce((F.col("cue_start") >= 0) & (F.col("cue_end") >= F.col("cue_start")), F.lit(False))
    shown, frames = media.clock(F.col("cue_start")), F.size(media.frame_positions(F.col("cue_start"), F.col("cue_end")))
    return rows.select("row_id", F.when(sound, shown).alias("shown"), F.when(sound, frames).alias("frames"))


def srt_round_trip(spark, sf_dir):
    """Cues written as SRT and read again: per track how many came back and their characters."""
    written = subtitles.srt_texts(_cues(spark, sf_dir), ["media_id", "track_no"])
    back = subtitles.parse_subtitles(written, "srt", ["media_id", "track_no"])
    return back.groupBy("media_id", "track_no").agg(F.count("*").alias("cues"), F.sum(F.length("cue_text")).alias("characters"), F.sum(F.round(F.col("cue_start") * 1000).cast("long")).alias("starts_ms"))


def titles_once(spark, sf_dir):
    rows = read_table(spark, sf_dir, "media_manifest").where("title is not null").select("title").distinct()
    doubled = rows.select(F.explode(F.array(F.col("title"), F.concat("title", F.lit(" "), "title"))).alias("title"))
    return doubled.select("title", media.single_title(F.col("title")).alias("once"))


def cues_corrected(spark, sf_dir):
    """Cues with the longest text of their number in place of theirs, as a review would set it."""
    rows = read_table(spark, sf_dir, "subtitle_cue").where("cue_text is not null").select("row_id", "media_id", "track_no", "cue_no", "cue_text")
    fixes = rows.where("cue_text <> btrim(cue_text)").select("row_id", F.btrim("cue_text").alias("new_text"))
    return media.corrected(rows, fixes, "row_id", "cue_text").select("row_id", "cue_text", "corrected")


def identifiers_redacted(spark, sf_dir):
    return read_table(spark, sf_dir, "agent_session").select("row_id", media.redacted(F.col("id")).alias("shown"), media.redacted(F.col("parent_id")).alias("parent_shown"))


QUERIES = {f.__name__: f for f in (media_hosts, media_addresses, track_choice, track_quality, transcripts, cue_clocks, srt_round_trip, titles_once, cues_corrected, identifiers_redacted)}

_CUES = "WITH c AS (SELECT media_id, track_no, cue_no, cue_start, cue_end, cue_text, lang, kind, min(row_id) AS row_id FROM subtitle_cue WHERE media_id IS NOT NULL AND track_no IS NOT NULL AND cue_no IS NOT NULL GROUP BY ALL)"
_HOST = "regexp_extract(original_url, '^[a-z]+://([^/?#:]+)', 1)"
_BARE = "regexp_replace(original_url, '[?#].*$', '')"
_LANG = "regexp_replace(replace(lower(lang), '_', '-'), '^ai-', '')"
_QUALITY = _CUES + """,
m AS (SELECT media_id, max(duration) AS duration FROM media_manifest GROUP BY 1),
r AS (SELECT c.*, CASE WHEN duration > 0 THEN duration END AS d, length(regexp_replace(coalesce(cue_text, ''), '\\s', '', 'g')) AS says FROM c LEFT JOIN m ON m.media_id = c.media_id WHERE cue_start IS NOT NULL AND cue_end IS NOT NULL),
o AS (SELECT *, cue_end < cue_start OR cue_start < lag(cue_start) OVER w AS unordered, greatest(CASE WHEN d IS NOT NULL THEN least(cue_start, d) ELSE cue_start END, 0.0) AS a, greatest(CASE WHEN d IS NOT NULL THEN least(cue_end, d) ELSE cue_end END, 0.0) AS b FROM r WINDOW w AS (PARTITION BY media_id, track_no ORDER BY cue_no, row_id)),
f AS (SELECT media_id, track_no, max(d) AS d, CAST(sum(says) AS BIGINT) AS characters, coalesce(bool_or(unordered), false) AS unordered, coalesce(bool_or(says > 0 AND (cue_start < -2.0 OR cue_end > d + 2.0)), false) AS beyond FROM o GROUP BY 1, 2),
t AS (SELECT *, max(b) OVER (PARTITION BY media_id, track_no ORDER BY cue_no, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o WHERE says > 0 AND b > a),
n AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, track_no ORDER BY cue_no, row_id ROWS UNBOUNDED PRECEDING) AS island FROM t),
i AS (SELECT media_id, track_no, island, max(d) AS d, arg_min(a, (cue_no, row_id)) AS a, max(b) AS b FROM n GROUP BY 1, 2, 3),
g0 AS (SELECT *, lag(b) OVER (PARTITION BY media_id, track_no ORDER BY island) AS p FROM i),
g AS (SELECT media_id, track_no, count(*) AS islands, round(sum(b - a), 3) AS covered, max(a - CASE WHEN p IS NOT NULL THEN p WHEN d IS NOT NULL THEN 0.0 END) AS widest, arg_max(b, island) AS last_end FROM g0 GROUP BY 1, 2),
q AS (SELECT f.*, g.* EXCLUDE (media_id, track_no), CASE WHEN d IS NOT NULL THEN greatest(30.0, d * 0.1) ELSE 30.0 END AS lim, CASE WHEN d IS NOT NULL THEN greatest(20, ceil(d / 10)) ELSE 20 END AS least_ FROM f LEFT JOIN g ON g.media_id = f.media_id AND g.track_no = f.track_no),
z AS (SELECT media_id, track_no, characters, coalesce(islands, 0) AS islands, coalesce(covered, 0.0) AS covered, unordered, beyond, characters = 0 AS empty, characters < least_ AS too_short, coalesce(coalesce(covered, 0.0) / d < 0.6, false) AS low_coverage, coalesce(widest > lim, false) AS wide_gap, coalesce(d - coalesce(last_end, 0.0) > lim, false) AS wide_tail FROM q)
SELECT *, NOT (empty OR unordered OR too_short OR beyond OR low_coverage OR wide_gap OR wide_tail) AS reliable FROM z
"""

ORACLES = {
    "media_hosts": f"SELECT platform, CASE WHEN {_HOST} = 'pixleaf.example' OR {_HOST} LIKE '%.pixleaf.example' THEN 'pixleaf.example' WHEN {_HOST} = 'tidemark.example' OR {_HOST} LIKE '%.tidemark.example' THEN 'tidemark.example' WHEN {_HOST} = 'barrelbay.example' OR {_HOST} LIKE '%.barrelbay.example' THEN 'barrelbay.example' END AS domain, nullif({_HOST}, '') AS host, count(*) AS n FROM media_manifest GROUP BY ALL",
    "media_addresses": f"SELECT DISTINCT media_id, {_BARE} AS bare, CASE WHEN regexp_extract({_BARE}, '/([A-Za-z0-9_-]+)/?$', 1) <> '' THEN regexp_extract({_BARE}, '/([A-Za-z0-9_-]+)/?$', 1) ELSE substr(sha256(original_url), 1, 10) END AS content, coalesce({_BARE} = canonical_url, false) AS canonical, sha256(original_url) AS digest FROM (SELECT DISTINCT media_id, original_url, canonical_url FROM media_manifest WHERE original_url IS NOT NULL)",
    "track_choice": f"WITH t AS (SELECT media_id, track_no, min(lang) AS lang, min(kind) AS kind FROM subtitle_cue WHERE media_id IS NOT NULL AND track_no IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, CASE WHEN {_LANG} LIKE 'zh%' AND kind = 'manual' THEN 0 WHEN {_LANG} LIKE 'zh%' AND kind = 'auto' THEN 1 WHEN {_LANG} NOT LIKE 'zh%' AND kind = 'manual' THEN 2 WHEN {_LANG} NOT LIKE 'zh%' AND kind = 'auto' THEN 3 ELSE 4 END AS rank FROM t) SELECT media_id, track_no, lang, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY rank, track_no) AS k FROM r) WHERE k = 1",
    "track_quality": _QUALITY,
    "transcripts": _CUES + ", t AS (SELECT media_id, track_no, cue_no, row_id, trim(regexp_replace(cue_text, '\\s*\\n\\s*', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM c WHERE cue_text IS NOT NULL) SELECT media_id, track_no, count(*) AS cues, list_reduce(list(t ORDER BY cue_no, row_id), lambda a, x: a || CASE WHEN regexp_matches(a, '[0-9A-Za-z]$') AND regexp_matches(x, '^[0-9A-Za-z]') THEN ' ' ELSE '' END || x) AS transcript FROM t WHERE t <> '' GROUP BY 1, 2",
    "cue_clocks": "SELECT row_id, CASE WHEN ok THEN printf('%02d:%02d:%02d', CAST(floor(cue_start) AS BIGINT) // 3600, CAST(floor(cue_start) AS BIGINT) // 60 % 60, CAST(floor(cue_start) AS BIGINT) % 60) END AS shown, CASE WHEN ok THEN CASE WHEN cue_end - cue_start > 4 THEN 3 ELSE 1 END END AS frames FROM (SELECT *, coalesce(cue_start >= 0 AND cue_end >= cue_start, false) AS ok FROM subtitle_cue)",
    "srt_round_trip": _CUES + " SELECT media_id, track_no, count(*) AS cues, CAST(sum(length(trim(regexp_replace(trim(cue_text), '\\s*\\n\\s*', ' ', 'g')))) AS BIGINT) AS characters, CAST(sum(CAST(round(cue_start * 1000) AS BIGINT)) AS BIGINT) AS starts_ms FROM c WHERE cue_start >= 0 AND cue_end >= 0 AND trim(cue_text) <> '' GROUP BY 1, 2",
    "titles_once": "WITH t AS (SELECT DISTINCT title FROM media_manifest WHERE title IS NOT NULL) SELECT title, title AS once FROM t UNION ALL SELECT title || ' ' || title, CASE WHEN length(title) >= 4 THEN trim(title) ELSE title || ' ' || title END FROM t",
    "cues_corrected": "SELECT row_id, CASE WHEN cue_text <> trim(cue_text) THEN trim(cue_text) ELSE cue_text END AS cue_text, cue_text <> trim(cue_text) AS corrected FROM subtitle_cue WHERE cue_text IS NOT NULL",
    "identifiers_redacted": "SELECT row_id, CASE WHEN coalesce(id, '') = '' THEN '' WHEN length(id) <= 8 THEN '***' ELSE left(id, 4) || '***' || right(id, 4) END AS shown, CASE WHEN coalesce(parent_id, '') = '' THEN '' WHEN length(parent_id) <= 8 THEN '***' ELSE left(parent_id, 4) || '***' || right(parent_id, 4) END AS parent_shown FROM agent_session",
}
