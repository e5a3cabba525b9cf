"""Mixing sources to target shares of the total size.

Each text gets a random key by hash.  The key's leading bits cut a source into
ranges; the sizes of the ranges, summed in order, give each range the tokens
before it, and a running sum inside a range gives each text its own.  A source
ends exactly where its budget does, after as many whole epochs as fit into it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts of one range; the number of ranges follows the data.
RANGE_TEXTS = 50_000


def _budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Budget, whole epochs and rest of each source of each mix.

    The total of a mix is the largest at which no source needs more than its
    repeats.  Sources without any token are left out and the other shares
    scaled up to 1.
    """
    wanted = targets.where("mix_name is not null and source is not null and target_share > 0 and max_repeats > 0")
    have = wanted.join(sizes, "source").withColumn("share", F.col("target_share") / F.sum("target_share").over(W.partitionBy("mix_name")))
    total = F.min(F.floor(F.col("max_repeats") * F.col("size") / F.col("share"))).over(W.partitionBy("mix_name"))
    budget = F.least(F.floor(F.col("share") * F.col("total")), F.col("max_repeats") * F.col("size")).cast("long")
    out = have.withColumn("total", total).withColumn("budget", budget)
    epochs = F.floor(F.col("budget") / F.col("size"))
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size")).select(
        "mix_name", "source", "target_share", "max_repeats", "size", "total", "budget", "epochs", "rest"
    )


def mix(items: DataFrame, targets: DataFrame, seed: int = 20260101) -> DataFrame:
    """The texts of every mix: mix_name, source, doc_id, n_tokens, uses.

    ``items``: doc_id, source, n_tokens.  ``targets``: mix_name, source,
    target_share, max_repeats (a small table of parameters).  A text is used
    ``uses`` times, at most max_repeats.  The last text of a source is taken
    if that brings the source nearer to its budget.  Texts without tokens and
    sources that no mix names are left out; an empty input gives no rows.
    """
    named = targets.select("source").where("source is not null").distinct()
    sized = items.where("n_tokens > 0").select("doc_id", "source", "n_tokens").join(F.broadcast(named), "source")
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("texts"))
    most = per_source.agg(F.max("texts").alias("m")).first().m or 1
    bits = min(24, max(2, math.ceil(math.log2(max(1, most / RANGE_TEXTS))) + 1))
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    keyed = sized.select("source", "doc_id", "n_tokens", key.alias("key")).withColumn("range", F.shiftright("key", 64 - bits))
    ranges = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("source", "range", before.alias("before"))
    inside = F.sum("n_tokens").over(W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = keyed.withColumn("inside", inside).join(ranges, ["source", "range"]).withColumn("start", F.col("before") + F.col("inside"))
    plan = F.broadcast(_budgets(per_source.select("source", "size"), targets).select("mix_name", "source", "epochs", "rest", "max_repeats"))
    uses = F.col("epochs") + F.when(F.col("start") * 2 + F.col("n_tokens") <= F.col("rest") * 2, 1).otherwise(0)
    out = placed.join(plan, "source").withColumn("uses", F.least(uses, F.col("max_repeats")).cast("int"))
    return out.where("uses > 0").select("mix_name", "source", "doc_id", "n_tokens", "uses")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached in fact: mix_name, source, target_share, actual_share, tokens, texts, most_uses."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    all_ = targets.where("mix_name is not null and source is not null").join(got, ["mix_name", "source"], "left").fillna({"tokens": 0, "texts": 0, "most_uses": 0})
    share = F.col("tokens") / F.sum("tokens").over(W.partitionBy("mix_name"))
    return all_.select("mix_name", "source", "target_share", F.coalesce(share, F.lit(0.0)).alias("actual_share"), "tokens", "texts", "most_uses")
