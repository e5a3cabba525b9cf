"""Checks and transformations that keep documents and their parts whole."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def balance(facts: DataFrame) -> DataFrame:
    """Footnote labels whose references and definitions do not agree: doc_id, label, refs, defs, problem."""
    rows = facts.where("kind in ('note_ref', 'note_def')").groupBy("doc_id", F.col("value").alias("label")).agg(
        F.count(F.when(F.col("kind") == "note_ref", 1)).alias("refs"), F.count(F.when(F.col("kind") == "note_def", 1)).alias("defs")
    )
    problem = F.when(F.col("defs") == 0, "no definition").when(F.col("refs") == 0, "no reference").when(F.col("defs") > 1, "repeated definition")
    return rows.withColumn("problem", problem).where("problem is not null")


def merged_packages(expected: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """What became of each package: key, state (ok, missing, extra, repeated, changed).

    ``expected`` and ``given``: key and digest.  A key given more than once is
    repeated, whatever its digests are.
    """
    got = given.groupBy(*key).agg(F.count("*").alias("n"), F.min("digest").alias("d"))
    want = expected.select(*key, F.col("digest").alias("w"), F.lit(True).alias("wanted"))
    both = want.join(got, key, "full")
    state = (
        F.when(F.col("wanted").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
        .when(F.col("w").eqNullSafe(F.col("d")), "ok").otherwise("changed")
    )
    return both.select(*key, state.alias("state"))


def untiled(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """Documents whose ranges do not tile their lines: doc_id, problem.

    ``ranges``: doc_id, first_line, last_line.  ``totals``: doc_id, lines.
    """
    w = W.partitionBy("doc_id").orderBy("first_line")
    rows = ranges.withColumn("before", F.coalesce(F.lag("last_line").over(w), F.lit(0)))
    bad = rows.where(F.col("first_line") != F.col("before") + 1).select("doc_id", F.when(F.col("first_line") > F.col("before") + 1, "hole").otherwise("overlap").alias("problem"))
    ends = rows.groupBy("doc_id").agg(F.max("last_line").alias("last")).join(totals, "doc_id", "right")
    short = ends.where(~F.col("last").eqNullSafe(F.col("lines"))).select("doc_id", F.lit("end").alias("problem"))
    return bad.unionByName(short).distinct()


def ambiguous(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with several values: key, n."""
    return df.groupBy(*key, F.col(value).alias("__v")).agg(F.lit(1).alias("__one")).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def numbered_repeats(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``occurrence``: the how-many-th row of its key, in order, from 1."""
    return df.withColumn("occurrence", F.row_number().over(W.partitionBy(*by).orderBy(order)))


def demoted(text: str | None, by: int = 1) -> str | None:
    """A Markdown text with its headings ``by`` levels lower; lines inside fences stay."""
    if text is None:
        return None
    out, fence = [], None
    for line in text.split("\n"):
        mark = re.match(r"^ {0,3}(`{3,}|~{3,})", line)
        if mark and (fence is None or mark[1][0] == fence[0] and len(mark[1]) >= len(fence)):
            fence = mark[1] if fence is None else None
        elif fence is None and re.match(r"^#{1,8}\s", line):
            line = "#" * by + line
        out.append(line)
    return "\n".join(out)


@F.pandas_udf(StringType())
def demoted_column(texts: pd.Series) -> pd.Series:
    return texts.map(demoted)


def with_placeholders(text: str | None) -> tuple[str, list[str]]:
    """A text with a placeholder line for each closed fence, and the fences."""
    kept, held, open_, out = [], [], None, []
    for line in (text or "").split("\n"):
        mark = re.match(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$", line)
        if open_ is None:
            if mark:
                open_, held = mark[1], [line]
            else:
                out.append(line)
            continue
        held.append(line)
        if mark and mark[1][0] == open_[0] and len(mark[1]) >= len(open_) and not mark[2].strip():
            out.append(f"[[FENCE:{len(kept)}]]")
            kept.append("\n".join(held))
            open_ = None
    return "\n".join(out + (held if open_ is not None else [])), kept


def spliced(text: str, fences: list[str]) -> str:
    """Puts fences back; every placeholder must stand once, alone on its line, in order."""
    found = re.findall(r"(?m)^\[\[FENCE:(\d+)\]\]$", text)
    if found != [str(k) for k in range(len(fences))]:
        raise ValueError("the placeholders do not match the fences")
    return re.sub(r"(?m)^\[\[FENCE:(\d+)\]\]$", lambda m: fences[int(m[1])], text)


def line_kinds(line: Column) -> Column:
    """What a line of a page looks like: chapter, caption, note, formula or text."""
    return (
        F.when(line.rlike(r"^\s*(?:第\s*[0-9]+\s*[章节]|[0-9]+(?:\.[0-9]+)+\s+\S|Chapter\s+[0-9]+)"), "chapter").when(line.rlike(r"^\s*(?:Figure|Fig\.|Table|图|表)\s*[0-9]+"), "caption")
        .when(line.rlike(r"^\s*(?:\[[0-9]{1,3}\]|[0-9]{1,2}\))\s*\S"), "note").when(line.rlike(r"[=<>]\s*[0-9A-Za-z(]") & line.rlike(r"[-+*/^]"), "formula").otherwise("text")
    )


def page_numbers(spec: Column) -> Column:
    """``1-3,5,3`` as the array 1, 2, 3, 5: each page once, in the order of its first mention; null if a part is malformed."""
    parts = F.split(F.regexp_replace(spec, r"\s", ""), ",")
    good = F.forall(parts, lambda p: p.rlike(r"^[0-9]{1,9}(?:-[0-9]{1,9})?$"))
    low = lambda p: F.split(p, "-")[0].try_cast("int")
    high = lambda p: F.element_at(F.split(p, "-"), -1).try_cast("int")
    return F.when(good & F.forall(parts, lambda p: low(p) <= high(p)), F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))))


def shown_width(css: Column, attribute: Column, height: Column, ratio: Column, reference: Column) -> tuple[Column, Column]:
    """Width in pixels at which an image is shown, and what it rests on.

    A width in px counts before one in percent of the reference width, that
    before the attribute, that before a height times the image's ratio.
    """
    px = F.regexp_extract(css, r"^\s*([0-9]+(?:\.[0-9]+)?)px\s*$", 1).try_cast("double")
    percent = F.regexp_extract(css, r"^\s*([0-9]+(?:\.[0-9]+)?)%\s*$", 1).try_cast("double") / 100 * reference
    attr = F.regexp_extract(attribute, r"^\s*([0-9]+)(?:px)?\s*$", 1).try_cast("double")
    tall = F.regexp_extract(height, r"^\s*([0-9]+)(?:px)?\s*$", 1).try_cast("double") * ratio
    basis = F.when(px.isNotNull(), "px").when(percent.isNotNull(), "percent").when(attr.isNotNull(), "attribute").when(tall.isNotNull(), "height").otherwise("undetermined")
    return F.round(F.coalesce(px, percent, attr, tall), 2), basis


def decode_budget(images: DataFrame) -> DataFrame:
    """Bytes that images take when decoded, each file once and each use: files, uses, bytes_once, bytes_all, largest."""
    size = F.col("width").cast("long") * F.col("height") * 4
    files = images.where("digest is not null").groupBy("digest").agg(F.count("*").alias("uses"), F.max(size).alias("bytes"))
    return files.agg(F.count("*").alias("files"), F.sum("uses").alias("uses"), F.sum("bytes").alias("bytes_once"), F.sum(F.col("bytes") * F.col("uses")).alias("bytes_all"), F.max("bytes").alias("largest"))


def joined_with_dispositions(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """A full join of two channels that should tell the same: key and disposition (both, left only, right only)."""
    a = left.select(*key).distinct().withColumn("__l", F.lit(True))
    b = right.select(*key).distinct().withColumn("__r", F.lit(True))
    where = F.when(F.col("__l").isNull(), "right only").when(F.col("__r").isNull(), "left only").otherwise("both")
    return a.join(b, key, "full").select(*key, where.alias("disposition"))


def contents(heads: DataFrame) -> DataFrame:
    """A table of contents for each document: doc_id, entries, toc.  ``heads``: doc_id, ord, level, title, anchor."""
    entry = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), F.col("title"), F.lit("](#"), F.col("anchor"), F.lit(")"))
    held = heads.select("doc_id", "ord", entry.alias("e")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "e"))).alias("c"))  # the headings of one document
    return held.select("doc_id", F.size("c").alias("entries"), F.array_join(F.transform("c", lambda x: x["e"]), "\n").alias("toc"))


def page_markdown(parsed: DataFrame) -> DataFrame:
    """Parsed HTML blocks as Markdown, one text for each page: page_id, text."""
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).when(F.col("kind") == "item", F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), F.lit("- "), F.col("text")))
        .when(F.col("kind") == "code_block", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).when(F.col("kind") == "quote", F.concat(F.lit("> "), F.col("text"))).when(F.col("kind").isin("paragraph", "text", "caption"), F.col("text"))
    )
    rows = parsed.withColumn("line", line).where("line is not null")
    held = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("c"))  # the blocks of one page
    return held.select("page_id", F.array_join(F.transform("c", lambda x: x["line"]), "\n\n").alias("text"))
