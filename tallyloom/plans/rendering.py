"""Queries on texts made for people."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import rendering
from tallyloom.plans.fixtures import _t, _values
from tallyloom.plans.media import ORACLES as _MEDIA
from tallyloom.plans.media import _cues
from tallyloom.session import read_table

FLAGS = [("Yes",), (" on ",), ("0",), ("FALSE",), ("maybe",), ("",), (None,)]


def titles_escaped(spark, sf_dir):
    return read_table(spark, sf_dir, "media_manifest").where("title is not null").select("title").distinct().select("title", rendering.escaped(F.col("title")).alias("escaped"))


def flags_read(spark, sf_dir):
    return _t(spark, FLAGS, "word string").select("word", rendering.flag(F.col("word")).alias("flag"))


def page_starts(spark, sf_dir):
    """The number of each page's first line when the lines of a work are counted through."""
    rows = read_table(spark, sf_dir, "image_item").where("media_id is not null").select("media_id", "item_index", "image_id", F.coalesce(F.size(F.split("ocr_text", "\n")), F.lit(0)).alias("n"))
    rows = rows.withColumn("n", F.greatest("n", F.lit(0)))
    return rendering.numbered_from(rows, ["media_id"], ["item_index", "image_id"], "n").select("image_id", "n", "starts_at")


def media_documents(spark, sf_dir):
    return rendering.media_documents(read_table(spark, sf_dir, "media_manifest"), _cues(spark, sf_dir))


QUERIES = {f.__name__: f for f in (titles_escaped, flags_read, page_starts, media_documents)}

_ESC = "regexp_replace({0}, '([\\\\`*_{{}}\\[\\]()#+\\-!|<>])', '\\\\\\1', 'g')"
ORACLES = {
    "titles_escaped": f"SELECT DISTINCT title, {_ESC.format('title')} AS escaped FROM media_manifest WHERE title IS NOT NULL",
    "flags_read": "WITH " + _values("f", FLAGS, "word") + " SELECT word, CASE WHEN lower(trim(word)) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(trim(word)) IN ('0', 'false', 'no', 'off') THEN false END AS flag FROM f",
    "page_starts": "WITH n AS (SELECT media_id, item_index, image_id, CAST(coalesce(len(string_split(ocr_text, chr(10))), 0) AS INTEGER) AS n FROM image_item WHERE media_id IS NOT NULL) SELECT image_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY media_id ORDER BY item_index, image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS starts_at FROM n",
    "media_documents": f"WITH sp AS ({_MEDIA['transcripts']}), b AS (SELECT media_id, track_no FROM ({_MEDIA['track_choice']})), m AS (SELECT media_id, min((coalesce(title, ''), coalesce(author, ''))) AS m FROM media_manifest WHERE media_id IS NOT NULL GROUP BY 1) SELECT m.media_id, '# ' || {_ESC.format('m.m[1]')} || CASE WHEN m.m[2] <> '' THEN chr(10) || chr(10) || m.m[2] ELSE '' END || coalesce(chr(10) || chr(10) || transcript, '') AS text FROM m LEFT JOIN b ON b.media_id = m.media_id LEFT JOIN sp ON sp.media_id = b.media_id AND sp.track_no = b.track_no",
}
