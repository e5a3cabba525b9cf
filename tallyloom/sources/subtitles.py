"""WebVTT and SRT texts as cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds(stamp: Column) -> Column:
    """Seconds of a clock such as 01:02:03,450 or 02:03.450."""
    parts = F.split(F.replace(F.btrim(stamp), F.lit(","), F.lit(".")), ":")
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + F.coalesce(p.try_cast("double"), F.lit(0.0)))


def parse_subtitles(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The cues of WebVTT or SRT texts: ``keep``, cue_no (from 1), cue_start, cue_end, cue_text.

    A cue is a block of lines between blank ones that holds a line with an
    arrow between two clocks; what stands below that line is its text.  Blocks
    without text, notes and headers give nothing; null texts give nothing.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "﻿", "")
    blocks = F.split(clean, r"\n[ \t]*\n\s*")
    rows = df.select(*keep, F.posexplode(blocks).alias("at", "block"))
    times = r"(\d[\d:.,]+)\s*-->\s*(\d[\d:.,]+)"
    rows = rows.select(*keep, "at", F.regexp_extract("block", times, 1).alias("a"), F.regexp_extract("block", times, 2).alias("b"), F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1).alias("t"))
    rows = rows.withColumn("t", F.btrim(F.regexp_replace("t", r"\s*\n\s*", " "))).where("a <> '' and b <> '' and t <> ''")
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy(*keep).orderBy("at"))
    return rows.select(*keep, number.alias("cue_no"), seconds(F.col("a")).alias("cue_start"), seconds(F.col("b")).alias("cue_end"), F.col("t").alias("cue_text"))


def srt_stamp(at: Column) -> Column:
    ms = F.round(at * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_texts(cues: DataFrame, by: list[str]) -> DataFrame:
    """The SRT text of each track.  cues: ``by``, cue_no, row_id, cue_start, cue_end, cue_text; cues without ends or text are left out."""
    block = F.concat_ws("\n", F.col("cue_no").cast("string"), F.concat(srt_stamp(F.col("cue_start")), F.lit(" --> "), srt_stamp(F.col("cue_end"))), F.btrim("cue_text"))
    rows = cues.where("cue_start is not null and cue_end is not null and btrim(cue_text) <> '' and cue_start >= 0 and cue_end >= 0").select(*by, "cue_no", "row_id", block.alias("block"))
    # The cues of one recording.
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cue_no", "row_id", "block"))).alias("c"))
    return held.select(*by, F.array_join(F.transform("c", lambda x: x["block"]), "\n\n").alias("srt"))
