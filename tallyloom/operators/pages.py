"""Blocks of pages: boxes, reading order, captions, continuations, table grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A block at least this part of the page wide parts the columns above it from those below.
WIDE = 0.55


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a box in shares of the page lies on it and has an area."""
    return F.coalesce((x0 >= 0) & (y0 >= 0) & (x1 <= 1) & (y1 <= 1) & (x0 < x1) & (y0 < y1), F.lit(False))


def placed_boxes(df: DataFrame, width: str, height: str) -> DataFrame:
    """Boxes in points from boxes in shares; null where a box is not valid."""
    good = valid_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    at = lambda c, size: F.when(good, F.round(F.col(c) * F.col(size), 2))
    return df.withColumns({"px0": at("x0", width), "py0": at("y0", height), "px1": at("x1", width), "py1": at("y1", height), "valid": good})


def reading_order(df: DataFrame) -> DataFrame:
    """Adds ``reading``, the place of a block on its page.

    ``df``: doc, page, block, x0, y0, x1, y1 in shares of the page.  Wide
    blocks part the page; between two of them the left column comes before the
    right one.
    """
    wide = (F.col("x1") - F.col("x0")) >= WIDE
    page = W.partitionBy("doc", "page")
    above = F.coalesce(F.sum(F.when(wide, 1).otherwise(0)).over(page.orderBy("y0", "x0", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("__epoch", above).withColumn("__column", F.when(wide, 2).when((F.col("x0") + F.col("x1")) / 2 < 0.5, 0).otherwise(1))
    return rows.withColumn("reading", F.row_number().over(page.orderBy("__epoch", "__column", "y0", "x0", "block"))).drop("__epoch", "__column")


def captions(figures: DataFrame, texts: DataFrame, gap: float) -> DataFrame:
    """The nearest caption of each figure on its page: figure, caption, distance.

    Candidates overlap the figure sideways and stand within three gaps of it.
    """
    f = figures.select("doc", "page", F.col("block").alias("figure"), "x0", "y0", "x1", "y1")
    c = texts.select("doc", "page", F.col("block").alias("caption"), *[F.col(k).alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")])
    distance = F.greatest(F.col("cy0") - F.col("y1"), F.col("y0") - F.col("cy1"), F.lit(0.0))
    near = f.join(c, ["doc", "page"]).where((F.col("cx0") < F.col("x1")) & (F.col("cx1") > F.col("x0"))).withColumn("distance", F.round(distance, 6)).where(F.col("distance") <= 3 * gap)
    best = near.groupBy("doc", "page", "figure").agg(F.min(F.struct("distance", "caption")).alias("b"))
    return best.select("doc", "page", "figure", "b.caption", "b.distance")


def continued(df: DataFrame) -> DataFrame:
    """The block that a continuing block goes on from: block, previous.

    ``df``: doc, ord, block, type, continues.  Going back from a block marked
    as continuing, headers, footers and numbers are passed over; the next block
    counts if it has the same type, any other breaks the chain.
    """
    passes = F.col("type").isin("header", "footer", "page_number")
    w = W.partitionBy("doc").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(~passes, F.struct("block", "type")), ignorenulls=True).over(w)
    rows = df.withColumn("p", last).where("continues")
    return rows.select("doc", "block", F.when(F.col("p.type") == F.col("type"), F.col("p.block")).alias("previous"))


def table_grid(cells: DataFrame) -> DataFrame:
    """Every grid place that a cell covers: table, row, col, cell, and ``problem`` where two cells overlap.

    ``cells``: table, cell, row, col, rowspan, colspan.
    """
    spread = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    n = F.count("*").over(W.partitionBy("table", "r", "c"))
    return spread.select("table", F.col("r").alias("row"), F.col("c").alias("col"), "cell", F.when(n > 1, "overlap").alias("problem"))


def grid_holes(grid: DataFrame) -> DataFrame:
    """Places inside the outline of a table that no cell covers: table, row, col."""
    edge = grid.groupBy("table").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    all_ = edge.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    return all_.select("table", "row", "col").join(grid.select("table", "row", "col").distinct(), ["table", "row", "col"], "left_anti")


def verdicts(df: DataFrame, by: str, pending: str, failed: str) -> DataFrame:
    """The quality of each work from its counts: failed before degraded before passed."""
    out = df.groupBy(by).agg(F.sum(pending).alias("pending"), F.sum(failed).alias("failed"))
    return out.withColumn("verdict", F.when(F.col("failed") > 0, "failed").when(F.col("pending") > 0, "degraded").otherwise("passed"))
