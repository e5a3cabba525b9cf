"""Facts of documents as rows, and what is counted on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import markdown


def scan_facts(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, ord (from 0), kind, line_no, level, value of every fact of every text."""
    source = df.where(F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def scan(batches):
        for batch in batches:
            rows = [(d, k, *fact) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for k, fact in enumerate(markdown.facts(t))]
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "ord", "kind", "line_no", "level", "value"])

    return source.mapInArrow(scan, "doc_id long, ord int, kind string, line_no int, level int, value string")


def lines_of(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, line_no (from 1) and line of every line of every text."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("k", "line"))
    return rows.select("doc_id", (F.col("k") + 1).alias("line_no"), "line")


def line_offsets(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, line_no (from 1), offset (where the line begins) and length, in characters; one pass over each text."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = [np.fromiter(map(len, t.split("\n")), np.int64) for t in texts]
            count = np.array([len(x) for x in sizes], np.int64)
            offsets = [np.cumsum(x + 1) - x - 1 for x in sizes]
            joined = lambda parts: pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32))
            docs = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(texts)), count)))
            yield pa.RecordBatch.from_arrays([docs, joined([np.arange(1, n + 1) for n in count]), joined(offsets), joined(sizes)], names=["doc_id", "line_no", "offset", "length"])

    source = df.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, line_no int, offset int, length int")


def sections(facts: DataFrame) -> DataFrame:
    """Adds ``section``: the last heading at or before each fact of its document; null before the first."""
    w = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return facts.withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("value")), ignorenulls=True).over(w))


def slugs(facts: DataFrame) -> DataFrame:
    """Anchors of headings, numbered where a document repeats one: doc_id, ord, level, title, anchor."""
    heads = facts.where("kind = 'heading'")
    base = F.replace(F.regexp_replace(F.lower(F.btrim("value")), r"[^\p{L}\p{N}_\- ]", ""), F.lit(" "), F.lit("-"))
    heads = heads.withColumn("base", base)
    k = F.row_number().over(W.partitionBy("doc_id", "base").orderBy("ord")) - 1
    return heads.select("doc_id", "ord", "level", F.col("value").alias("title"), F.when(k == 0, F.col("base")).otherwise(F.concat_ws("-", "base", k.cast("string"))).alias("anchor"))


#: Units that may stand directly behind a number.
UNITS = "%|[munµ]?s|min|h|[kMG]?Hz|[KMGT]?i?B|[cmk]?m|[mk]?g|m?V|[mk]?A|[mkM]?W|K"


def number_tokens(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Tokens with a digit: doc_id, at (from 0), token, kind (number, quantity, identifier), amount, unit."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z0-9_.,%]*[0-9][A-Za-z0-9_.,%]*"), F.lit(0))
    rows = df.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.posexplode(found).alias("at", "raw"))
    rows = rows.withColumn("token", F.regexp_replace(F.regexp_replace("raw", r"^[.,]+", ""), r"[.,]+$", ""))
    number = F.col("token").rlike(r"^[0-9]+(?:[.,][0-9]+)*$")
    quantity = F.col("token").rlike(rf"^[0-9]+(?:[.,][0-9]+)*(?:{UNITS})$")
    kind = F.when(number, "number").when(quantity, "quantity").otherwise("identifier")
    amount = F.when(kind != "identifier", F.regexp_extract("token", r"^[0-9.,]*[0-9]", 0))
    return rows.select("doc_id", "at", "token", kind.alias("kind"), amount.alias("amount"), F.when(kind == "quantity", F.regexp_extract("token", r"[^0-9]+$", 0)).alias("unit"))


def templates(rows: DataFrame, text: str) -> DataFrame:
    """Messages that differ only in numbers, most frequent first: template, n, sample."""
    out = rows.where(F.col(text).isNotNull()).groupBy(F.regexp_replace(text, "[0-9]+", "N").alias("template")).agg(F.count("*").alias("n"), F.min(text).alias("sample"))
    return out.orderBy(F.desc("n"), "template")


def term_counts(df: DataFrame, doc: str, text: str, terms: DataFrame) -> DataFrame:
    """How often each term stands as a whole word in each document: doc_id, term, n; only where it does.

    ``terms``: one column, term (lower case, one word); documents and terms
    meet by word, not pair by pair.
    """
    words = df.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.explode(F.split(F.lower(text), "[^a-z0-9_]+")).alias("term"))
    counted = words.where("term <> ''").groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return counted.join(terms.select("term").distinct(), "term").select("doc_id", "term", "n")


def readable(c: Column) -> Column:
    """The share of letters and digits among a text's characters that are no blanks."""
    dense = F.regexp_replace(c, r"\s", "")
    return F.when(F.length(dense) > 0, F.length(F.regexp_replace(dense, r"[^\p{L}\p{N}]", "")) / F.length(dense)).otherwise(0.0)


def usable(c: Column) -> Column:
    """Whether a page's text can be used: at least 20 characters, 60 % of them readable."""
    return F.coalesce((F.length(F.regexp_replace(c, r"\s", "")) >= 20) & (readable(c) >= 0.6), F.lit(False))


def character_defects(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Characters that betray a bad text layer: keys, kind, n."""
    #: Classes of code points.
    classes = {"replacement": r"\x{FFFD}", "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "private": r"[\x{E000}-\x{F8FF}]", "ligature": r"[\x{FB00}-\x{FB06}]", "soft_hyphen": r"\x{00AD}", "not_sign": r"\x{00AC}"}
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("n")) for k, p in classes.items()])
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.explode(counts).alias("c"))
    return rows.select(*keys, "c.kind", "c.n").where("n > 0")


def classify_pages(pages: DataFrame, by: str, text: str) -> DataFrame:
    """Whether a work's pages are text, scans without text, or both: by, pages, usable_pages, kind."""
    out = pages.groupBy(by).agg(F.count("*").alias("pages"), F.count(F.when(usable(F.col(text)), 1)).alias("usable_pages"))
    kind = F.when(F.col("usable_pages") == F.col("pages"), "text").when(F.col("usable_pages") == 0, "scanned").otherwise("mixed")
    return out.withColumn("kind", kind)


def packed_lines(df: DataFrame, doc: str, text: str, limit: int) -> DataFrame:
    """Lines put together to chunks of at most ``limit`` characters, in order; a longer line is a chunk of its own.

    doc_id, chunk (from 1), first_line, last_line, characters (line ends
    between the lines included).
    """

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                chunk, first, size = 1, 1, -1
                for no, line in enumerate(t.split("\n"), 1):
                    if size >= 0 and size + 1 + len(line) > limit:
                        rows.append((d, chunk, first, no - 1, size))
                        chunk, first, size = chunk + 1, no, -1
                    size += 1 + len(line)
                rows.append((d, chunk, first, no, size))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.column("doc_id").type, *[pa.int32()] * 4])], names=["doc_id", "chunk", "first_line", "last_line", "characters"])

    source = df.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, chunk int, first_line int, last_line int, characters int")
