"""Subtitle tracks, media addresses and review overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What makes a track usable.
MIN_TEXT, SECONDS_PER_CHARACTER = 20, 10
MAX_GAP, MIN_COVERAGE, TOLERANCE = 30.0, 0.6, 2.0


def host_in(url: Column, domains: list[str]) -> Column:
    """The domain that a web address belongs to (its host is the domain or ends with a dot and it); null for none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    out = F.lit(None).cast("string")
    for d in domains:
        out = F.when((host == d) | host.endswith(f".{d}"), d).otherwise(out)
    return out


def bare_url(url: Column) -> Column:
    """An address without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def content_id(url: Column) -> Column:
    """The last path part if it is a plain name, else ten hexadecimal digits of the address's digest."""
    last = F.regexp_extract(bare_url(url), r"/([A-Za-z0-9_\-]+)/?$", 1)
    return F.when(last != "", last).otherwise(F.substring(F.sha2(url, 256), 1, 10))


def language_rank(lang: Column, kind: Column) -> Column:
    """0 to 4: Chinese by hand, Chinese automatic, other by hand, other automatic, anything else."""
    name = F.regexp_replace(F.replace(F.lower(lang), F.lit("_"), F.lit("-")), "^ai-", "")
    zh = name.startswith("zh")
    return F.when(zh & (kind == "manual"), 0).when(zh & (kind == "auto"), 1).when(~zh & (kind == "manual"), 2).when(~zh & (kind == "auto"), 3).otherwise(4)


def best_track(tracks: DataFrame) -> DataFrame:
    """The track of each media with the best rank, the first of equal ones.  tracks: media_id, track_no, lang, kind."""
    rank = language_rank(F.col("lang"), F.col("kind"))
    return tracks.groupBy("media_id").agg(F.min(F.struct(rank.alias("rank"), "track_no", "lang", "kind")).alias("b")).select("media_id", "b.track_no", "b.lang", "b.kind", "b.rank")


def track_quality(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """How well a track covers its media: one row per (media_id, track_no).

    ``cues``: media_id, track_no, cue_no, cue_start, cue_end, cue_text.
    ``durations``: media_id, duration (null or not above 0 for unknown).  Cues
    count in the order of cue_no, as they came; they are not sorted by time.
    A track has at most the cues of one recording, so a window over it is
    bounded.
    """
    key = ["media_id", "track_no"]
    d = F.when(F.col("duration") > 0, F.col("duration"))
    rows = cues.join(durations, "media_id", "left").withColumn("d", d)
    order = W.partitionBy(*key).orderBy("cue_no", "row_id")
    rows = rows.withColumn("says", F.length(F.regexp_replace(F.coalesce("cue_text", F.lit("")), r"\s", "")))
    rows = rows.withColumn("unordered", (F.col("cue_end") < F.col("cue_start")) | (F.col("cue_start") < F.lag("cue_start").over(order)))
    clip = lambda c: F.greatest(F.when(F.col("d").isNotNull(), F.least(F.col(c), F.col("d"))).otherwise(F.col(c)), F.lit(0.0))
    rows = rows.withColumns({"a": clip("cue_start"), "b": clip("cue_end")})
    facts = rows.groupBy(*key).agg(
        F.max("d").alias("d"), F.sum("says").alias("characters"), F.coalesce(F.bool_or("unordered"), F.lit(False)).alias("unordered"),
        F.coalesce(F.bool_or((F.col("says") > 0) & ((F.col("cue_start") < -TOLERANCE) | (F.col("cue_end") > F.col("d") + TOLERANCE))), F.lit(False)).alias("beyond"),
    )
    used = rows.where("says > 0 and b > a")
    top = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    # An island begins where a cue, in the order of arrival, starts after the end of the island before it.
    marked = used.withColumn("top", top).withColumn("starts", (F.col("top").isNull() | (F.col("a") > F.col("top"))).cast("int"))
    marked = marked.withColumn("island", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    islands = marked.groupBy(*key, "island").agg(F.max("d").alias("d"), F.min_by("a", F.struct("cue_no", "row_id")).alias("a"), F.max("b").alias("b"))
    before = F.lag("b").over(W.partitionBy(*key).orderBy("island"))
    gap = F.col("a") - F.when(before.isNotNull(), before).when(F.col("d").isNotNull(), F.lit(0.0))
    gaps = islands.withColumn("gap", gap).groupBy(*key).agg(
        F.count("*").alias("islands"), F.round(F.sum(F.col("b") - F.col("a")), 3).alias("covered"), F.max("gap").alias("widest"), F.max_by("b", "island").alias("last_end")
    )
    out = facts.join(gaps, key, "left")
    limit = F.when(F.col("d").isNotNull(), F.greatest(F.lit(MAX_GAP), F.col("d") * 0.1)).otherwise(MAX_GAP)
    least = F.when(F.col("d").isNotNull(), F.greatest(F.lit(MIN_TEXT), F.ceil(F.col("d") / SECONDS_PER_CHARACTER))).otherwise(MIN_TEXT)
    tail = F.col("d") - F.coalesce("last_end", F.lit(0.0))
    flags = {
        "empty": F.col("characters") == 0, "too_short": F.col("characters") < least, "low_coverage": F.coalesce(F.coalesce("covered", F.lit(0.0)) / F.col("d") < MIN_COVERAGE, F.lit(False)),
        "wide_gap": F.coalesce(F.col("widest") > limit, F.lit(False)), "wide_tail": F.coalesce(tail > limit, F.lit(False)),
    }
    out = out.withColumns(flags)
    reliable = ~(F.col("empty") | F.col("unordered") | F.col("too_short") | F.col("beyond") | F.col("low_coverage") | F.col("wide_gap") | F.col("wide_tail"))
    return out.select(*key, "characters", F.coalesce("islands", F.lit(0)).alias("islands"), F.coalesce("covered", F.lit(0.0)).alias("covered"), "unordered", "beyond", *flags, reliable.alias("reliable"))


def joined_text(parts: Column) -> Column:
    """An array of texts as one: a blank only between two ASCII letters or digits."""
    return F.aggregate(
        parts, F.lit(""), lambda a, x: F.concat(a, F.when(a.rlike("[0-9A-Za-z]$") & x.rlike("^[0-9A-Za-z]"), F.lit(" ")).otherwise(F.lit("")), x)
    )


def transcripts(cues: DataFrame) -> DataFrame:
    """One continuous text for each track.  cues: media_id, track_no, cue_no, row_id, cue_text; blank cues are left out."""
    text = F.btrim(F.regexp_replace("cue_text", r"\s*\n\s*", "\n"), F.lit(" \t\r\n"))
    rows = cues.select("media_id", "track_no", "cue_no", "row_id", text.alias("t")).where("t <> ''")
    # The cues of one recording; ordered by their numbers.
    held = rows.groupBy("media_id", "track_no").agg(F.array_sort(F.collect_list(F.struct("cue_no", "row_id", "t"))).alias("c"))
    return held.select("media_id", "track_no", F.size("c").alias("cues"), joined_text(F.transform("c", lambda x: x["t"])).alias("transcript"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def frame_positions(start: Column, end: Column) -> Column:
    """Where to look at a cue: its middle, and the quarters of one longer than four seconds."""
    at = lambda p: F.round(start + (end - start) * p, 3)
    return F.when(end - start > 4, F.array(at(0.25), at(0.5), at(0.75))).otherwise(F.array(at(0.5)))


def single_title(title: Column) -> Column:
    """A title that is written twice, once."""
    t = F.btrim(title)
    half = F.floor(F.length(t) / 2).cast("int")
    doubled = (F.length(t) % 2 == 0) & (half >= 4) & (F.substring(t, F.lit(1), half) == F.substring(t, half + 1, half))
    apart = F.regexp_extract(t, r"(?s)^(.{4,}?)\s+\1$", 1)
    return F.when(doubled, F.btrim(F.substring(t, F.lit(1), half))).when(apart != "", F.btrim(apart)).otherwise(title)


def corrected(cues: DataFrame, corrections: DataFrame, key: str, text: str) -> DataFrame:
    """``cues`` with the texts of ``corrections`` (key, new_text) in place of theirs, and whether a row was corrected."""
    fix = corrections.select(F.col(key), F.col("new_text"), F.lit(True).alias("__fixed")).dropDuplicates([key])
    return cues.join(fix, key, "left").withColumn(text, F.coalesce("new_text", text)).withColumn("corrected", F.coalesce("__fixed", F.lit(False))).drop("new_text", "__fixed")


def unmatched_corrections(cues: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Corrections without a cue, and repeated ones, by ``problem``."""
    lost = corrections.join(cues.select(key).distinct(), key, "left_anti").select(key, F.lit("no cue").alias("problem")).distinct()
    twice = corrections.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated").alias("problem"))
    return lost.unionByName(twice)


def redacted(c: Column) -> Column:
    """An identifier with only its ends shown; short ones are hidden."""
    return F.when(c.isNull() | (c == ""), "").when(F.length(c) <= 8, "***").otherwise(F.concat(F.substring(c, 1, 4), F.lit("***"), F.substring(c, -4, 4)))
