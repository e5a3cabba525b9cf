"""The queries of this package and the SQL that gives equal results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import mixing, packing, scanned, subjects, tokens
from tallyloom.session import cut, read_table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repairs(read_table(spark, sf_dir, "image_item"))


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous text of every scanned work."""
    return scanned.paragraphs(read_table(spark, sf_dir, "image_item"))


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, cluster (equal for copies of one text) and n_tokens of all documents."""
    docs = read_table(spark, sf_dir, "documents").withColumn("cluster", F.xxhash64("text"))
    return cut(tokens.count_tokens(docs, "text", ["doc_id", "source", "cluster"]), "sized")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(sized_documents(spark, sf_dir), read_table(spark, sf_dir, "pack_limit"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, sf_dir), read_table(spark, sf_dir, "pack_limit"))


#: Sources whose texts must not stand in one container, as one tells of the other.
APART = [("agent_turn", "session_report"), ("glossary_note", "manual_translation")]


def p7_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers in which the sources of APART never meet."""
    return packing.pack(sized_documents(spark, sf_dir), read_table(spark, sf_dir, "pack_limit"), APART)


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each limit: texts in containers, texts in parts, containers that hold too much, and that hold copies of one text or sources to keep apart."""
    packed = cut(p7_apart(spark, sf_dir), "apart")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("cluster"))
    rows = packed.join(docs, "doc_id").join(read_table(spark, sf_dir, "pack_limit"), "limit_name")
    held = rows.groupBy("limit_name", "container_id").agg(
        (F.sum("n_tokens") > F.max("capacity_tokens")).alias("over"), (F.count("*") > F.countDistinct("cluster")).alias("twice"),
        *[(F.bool_or(F.coalesce(F.col("source") == a, F.lit(False))) & F.bool_or(F.coalesce(F.col("source") == b, F.lit(False)))).alias(f"met{k}") for k, (a, b) in enumerate(APART)],
    )
    bad = held.groupBy("limit_name").agg(F.count(F.when(F.col("over"), 1)).alias("overfull"), F.count(F.when(F.col("twice"), 1)).alias("with_copies"), F.count(F.when(F.col("met0") | F.col("met1"), 1)).alias("met"))
    return packed.groupBy("limit_name").agg(F.countDistinct("doc_id").alias("texts")).join(bad, "limit_name")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(sized_documents(spark, sf_dir), read_table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(p8_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_target"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "subject_example"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents and their characters of each area, areas without any included."""
    found = p9_found(spark, sf_dir).join(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    sums = found.groupBy("area").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    return read_table(spark, sf_dir, "subject_area").select("area").join(sums, "area", "left").fillna(0, ["documents", "characters"])


def p9_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the corpus the model of p9 leaves out for being too rare."""
    return subjects.vocabulary(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_text, p7_pack, p7_report, p7_apart, p7_whole, p8_mix, p8_shares, p9_found, p9_composition, p9_terms)}


def oracle_sql() -> dict[str, str]:
    return {
        # Every text that has a character has a token, so it stands in containers of each limit, which are all sound.
        "p7_whole": "SELECT limit_name, (SELECT count(*) FROM documents WHERE length(text) > 0) AS texts, 0 AS overfull, 0 AS with_copies, 0 AS met FROM pack_limit WHERE capacity_tokens >= 1",
    }
