"""Texts for people: escaping, flags, numbering and documents of media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import media, metering

#: Words that switch something on and off.
ON, OFF = ["1", "true", "yes", "on"], ["0", "false", "no", "off"]


def escaped(c: Column) -> Column:
    """A text in which no sign has a meaning in Markdown."""
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+\-!|<>])", r"\\$1")


def flag(c: Column) -> Column:
    """A switch from its words, whatever their case; null for anything else."""
    low = F.lower(F.btrim(c))
    return F.when(low.isin(ON), F.lit(True)).when(low.isin(OFF), F.lit(False))


def numbered_from(df: DataFrame, by: list[str], order: list[str], count: str) -> DataFrame:
    """Adds ``starts_at``: the number of the first item of each row when the items of a key are counted through, from 1.

    Keys with very many rows are cut into range chunks; what stands before a
    chunk is carried into it.
    """
    rows = metering.chunked(df, by, order)
    before = W.partitionBy(*by).orderBy(metering.CHUNK).rowsBetween(W.unboundedPreceding, -1)
    rows = metering._carried(rows, by, [F.sum(count).alias("__n")], {"__before": F.coalesce(F.sum("__n").over(before), F.lit(0))})
    local = F.coalesce(F.sum(count).over(W.partitionBy(*by, metering.CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("starts_at", local + F.col("__before") + 1).drop("__before", metering.CHUNK)


def media_documents(manifest: DataFrame, cues: DataFrame) -> DataFrame:
    """A Markdown document for each media: media_id, text; without a transcript it is the head alone.

    ``manifest``: media_id, title, author.  Repeated rows count once, the
    smallest title first; of several tracks the best one is taken.
    """
    tracks = cues.groupBy("media_id", "track_no").agg(F.min("lang").alias("lang"), F.min("kind").alias("kind"))
    best = media.best_track(tracks).select("media_id", "track_no")
    spoken = media.transcripts(cues.where("cue_text is not null")).join(best, ["media_id", "track_no"])
    one = manifest.where("media_id is not null").groupBy("media_id").agg(F.min(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"))).alias("m"))
    head = F.concat(F.lit("# "), escaped(F.col("m.title")), F.when(F.col("m.author") != "", F.concat(F.lit("\n\n"), F.col("m.author"))).otherwise(F.lit("")))
    body = F.when(F.col("transcript").isNotNull(), F.concat(F.lit("\n\n"), F.col("transcript"))).otherwise(F.lit(""))
    return one.join(spoken, "media_id", "left").select("media_id", F.concat(head, body).alias("text"))
