"""Comparison of ordered streams, multisets and keyed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stream_diff(left: DataFrame, right: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Places at which two streams differ: key, pos (from 1), left_value, right_value, kind (changed, missing, added).

    Places are counted inside each key, so that a stream may be cut into
    sections by adding one to the key.
    """
    w = W.partitionBy(*key).orderBy(*order)
    a = left.select(*key, F.row_number().over(w).alias("pos"), F.struct(F.col(value).alias("v")).alias("l"))
    b = right.select(*key, F.row_number().over(w).alias("pos"), F.struct(F.col(value).alias("v")).alias("r"))
    both = a.join(b, [*key, "pos"], "full")
    differs = F.col("l").isNull() | F.col("r").isNull() | ~F.col("l.v").eqNullSafe(F.col("r.v"))
    kind = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "missing").otherwise("changed")
    return both.where(differs).select(*key, "pos", F.col("l.v").alias("left_value"), F.col("r.v").alias("right_value"), kind.alias("kind"))


def first_difference(diff: DataFrame, key: list[str]) -> DataFrame:
    """For each key the first differing place and how many differ."""
    return diff.groupBy(*key).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.min_by("kind", "pos").alias("kind"))


def multiset_diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one side has more often: columns, missing (more on the left), added (more on the right)."""
    both = left.select(*columns, F.lit(1).alias("d")).unionByName(right.select(*columns, F.lit(-1).alias("d")))
    out = both.groupBy(*columns).agg(F.sum("d").alias("d")).where("d <> 0")
    return out.select(*columns, F.greatest(F.col("d"), F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("added"))


def keyed_diff(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that were added, removed or changed: key, kind."""
    a = left.select(*key, F.struct(F.col(value).alias("v")).alias("l"))
    b = right.select(*key, F.struct(F.col(value).alias("v")).alias("r"))
    kind = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(~F.col("l.v").eqNullSafe(F.col("r.v")), "changed")
    return a.join(b, key, "full").select(*key, kind.alias("kind")).where("kind is not null")


def json_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """The leaves of flat JSON objects: key, path, value; nested parts stay as text, broken JSON gives nothing."""
    entries = F.explode(F.from_json(F.col(column), "map<string,string>"))
    return df.where(F.col(column).isNotNull()).select(key, entries.alias("path", "value"))
