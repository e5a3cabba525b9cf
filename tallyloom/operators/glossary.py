"""Glossaries: consolidation of variants, merging of candidates, selection for a text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _folded(values: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        text = unicodedata.normalize("NFKC", text).strip()
        if len(text) > 1 and text[0] == text[-1] == "`":
            text = text[1:-1]
        return " ".join(text.split()).casefold()

    return values.map(one)


def term_key(c: Column) -> Column:
    """What two spellings of a term share.  Plain ASCII terms stay in the JVM; others go through NFKC and case folding."""
    plain = F.lower(F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(c), "^`(.+)`$", "$1"), r"\s+", " ")))
    return F.when(c.rlike(r"^[\x20-\x7E]*$"), plain).otherwise(_folded(c))


def consolidate(terms: DataFrame) -> DataFrame:
    """One target for each term and context: key, context, target, status.

    ``terms``: english, context, target, baseline (boolean).  Equal variants
    fall together.  The only variant wins (``single``); of several the only
    one of the baseline (``baseline``); else every variant is a ``conflict``,
    and so are the variants that a baseline overrules.  Null contexts count as
    empty; terms without english or target are left out.
    """
    rows = terms.where("english is not null and btrim(english) <> '' and target is not null").select(
        term_key(F.col("english")).alias("key"), F.coalesce("context", F.lit("")).alias("context"), F.btrim("target").alias("target"), F.coalesce("baseline", F.lit(False)).alias("baseline")
    )
    variants = rows.groupBy("key", "context", "target").agg(F.bool_or("baseline").alias("baseline"))
    w = W.partitionBy("key", "context")
    counted = variants.withColumns({"n": F.count("*").over(w), "b": F.count(F.when(F.col("baseline"), 1)).over(w)})
    status = F.when(F.col("n") == 1, "single").when((F.col("b") == 1) & F.col("baseline"), "baseline").otherwise("conflict")
    return counted.select("key", "context", "target", status.alias("status"))


def merge(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """What becomes of each candidate: ord, english, target, outcome (same, conflict, added, pending).

    ``existing``: english, target.  ``candidates``: ord, english, target,
    approved.  A candidate whose term exists is the same or a conflict; a new
    approved one is added and counts as existing for later candidates of its
    term; other new ones wait.
    """
    have = existing.select(term_key(F.col("english")).alias("key"), F.col("target").alias("have")).groupBy("key").agg(F.min("have").alias("have"))
    rows = candidates.withColumn("key", term_key(F.col("english"))).join(have, "key", "left")
    before = W.partitionBy("key").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("have", F.coalesce("have", F.first(F.when(F.col("approved"), F.col("target")), ignorenulls=True).over(before)))
    outcome = F.when(F.col("have") == F.col("target"), "same").when(F.col("have").isNotNull(), "conflict").when(F.col("approved"), "added").otherwise("pending")
    return rows.select("ord", "english", "target", outcome.alias("outcome"))


def select_terms(library: DataFrame, text: DataFrame) -> DataFrame:
    """The terms that stand in each text as whole words: doc_id, key, target.

    ``library``: english, target, priority (the smallest wins).  ``text``:
    doc_id, text.  Terms and texts meet by their first word, so that no text
    is compared with the whole library.
    """
    w = W.partitionBy("key").orderBy("priority", "target")
    terms = library.where("english is not null").withColumn("key", term_key(F.col("english"))).withColumn("k", F.row_number().over(w)).where("k = 1")
    terms = terms.select("key", "target", F.regexp_extract("key", "[a-z0-9]+", 0).alias("word"))
    words = text.where("text is not null").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("word")).where("word <> ''")
    near = words.join(terms, "word").join(text.select("doc_id", F.lower("text").alias("__text")), "doc_id")
    padded = F.concat(F.lit(" "), F.regexp_replace("__text", "[^a-z0-9]", " "), F.lit(" "))
    spaced = F.regexp_replace("key", "[^a-z0-9]", " ")
    return near.where(padded.contains(F.concat(F.lit(" "), spaced, F.lit(" "))) & F.col("__text").contains(F.col("key"))).select("doc_id", "key", "target").distinct()
