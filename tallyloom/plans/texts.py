"""Queries on the texts of documents and pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import marks
from tallyloom.operators import compare, glossary, textfacts
from tallyloom.plans.fixtures import LIBRARY
from tallyloom.session import read_table
from tallyloom.sources import facts


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _facts(spark, sf_dir):
    return textfacts.scan_facts(_docs(spark, sf_dir), "doc_id", "text")


def block_counts(spark, sf_dir):
    kinds = ["heading", "fence", "table", "item", "paragraph", "code"]
    return _facts(spark, sf_dir).groupBy("doc_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])


def code_fences(spark, sf_dir):
    return _facts(spark, sf_dir).where("kind = 'fence'").select("doc_id", "line_no", F.col("level").alias("lines"), "value", F.sha2("value", 256).alias("digest"))


def headings(spark, sf_dir):
    return textfacts.slugs(_facts(spark, sf_dir)).select("doc_id", "level", "title", "anchor")


def section_sizes(spark, sf_dir):
    """Blocks of each section of each document."""
    rows = textfacts.sections(_facts(spark, sf_dir)).where("kind in ('item', 'paragraph')")
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n"))


def table_cells(spark, sf_dir):
    """The cells of table rows in long form."""
    rows = _facts(spark, sf_dir).where("kind = 'table'")
    inner = F.regexp_replace(F.regexp_replace("value", r"^\|", ""), r"(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(F.btrim(c), F.lit("\\|"), F.lit("|")))
    return rows.select("doc_id", "line_no", "level", F.posexplode(cells).alias("col", "cell")).withColumnRenamed("level", "row")


def line_offsets(spark, sf_dir):
    return textfacts.line_offsets(_docs(spark, sf_dir), "doc_id", "text")


def number_tokens(spark, sf_dir):
    return textfacts.number_tokens(_docs(spark, sf_dir), "doc_id", "text").groupBy("doc_id", "token", "kind", "amount", "unit").agg(F.count("*").alias("n"))


def message_templates(spark, sf_dir):
    return textfacts.templates(textfacts.lines_of(_docs(spark, sf_dir), "doc_id", "text").where("line <> ''"), "line")


def term_counts(spark, sf_dir):
    terms = spark.createDataFrame([("cell",), ("bar",), ("pitch",), ("port",), ("the",)], "term string")
    return textfacts.term_counts(_docs(spark, sf_dir), "doc_id", "text", terms)


def texts_glossary(spark, sf_dir):
    """The library's terms that stand in each document; the library is a parameter."""
    return glossary.select_terms(spark.createDataFrame(LIBRARY, "english string, target string, priority int"), _docs(spark, sf_dir).select("doc_id", "text"))


def equal_texts(spark, sf_dir):
    """Groups of documents with equal texts, by digest."""
    rows = _docs(spark, sf_dir).where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return rows.where("n > 1")


def packed_lines(spark, sf_dir):
    return textfacts.packed_lines(_docs(spark, sf_dir), "doc_id", "text", 500)


def page_kinds(spark, sf_dir):
    return textfacts.classify_pages(read_table(spark, sf_dir, "image_item").where("media_id is not null"), "media_id", "ocr_text")


def page_defects(spark, sf_dir):
    return textfacts.character_defects(read_table(spark, sf_dir, "image_item"), ["image_id"], "ocr_text")


# --- comparisons of each document with the first one of its work -------------------


def _pairs(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("text is not null and origin_key is not null").select("doc_id", "origin_key", "text")
    first = docs.groupBy("origin_key").agg(F.min("doc_id").alias("first_doc"))
    return docs, docs.join(first, "origin_key").where("doc_id <> first_doc").select("doc_id", "first_doc", "text")


def _both_sides(spark, sf_dir):
    docs, pairs = _pairs(spark, sf_dir)
    now = textfacts.lines_of(pairs, "doc_id", "text").select("doc_id", "line_no", "line")
    before = textfacts.lines_of(docs, "doc_id", "text").select(F.col("doc_id").alias("first_doc"), "line_no", "line")
    return pairs.select("doc_id", "first_doc").join(before, "first_doc").select("doc_id", "line_no", "line"), now


def line_differences(spark, sf_dir):
    """Where each document first differs from the first document of its work, line by line."""
    before, now = _both_sides(spark, sf_dir)
    return compare.first_difference(compare.stream_diff(before, now, ["doc_id"], ["line_no"], "line"), ["doc_id"])


def line_multisets(spark, sf_dir):
    """How many lines each document misses and adds against the first of its work, whatever their order."""
    before, now = _both_sides(spark, sf_dir)
    diff = compare.multiset_diff(before, now, ["doc_id", "line"])
    return diff.groupBy("doc_id").agg(F.sum("missing").alias("missing"), F.sum("added").alias("added"))


def heading_differences(spark, sf_dir):
    _, pairs = _pairs(spark, sf_dir)
    heads = _facts(spark, sf_dir).where("kind = 'heading'").select("doc_id", "ord", F.concat_ws(" ", F.col("level").cast("string"), "value").alias("h"))
    now = pairs.select("doc_id").join(heads, "doc_id")
    before = pairs.select(F.col("doc_id").alias("d"), "first_doc").join(heads, F.col("first_doc") == F.col("doc_id")).select(F.col("d").alias("doc_id"), "ord", "h")
    return compare.stream_diff(before, now, ["doc_id"], ["ord"], "h")


def usage_json_changes(spark, sf_dir):
    """Fields in which the copies of a message differ from its first row."""
    rows = read_table(spark, sf_dir, "model_usage").where("session_id is not null and attempt_index is not null and btrim(logical_request_id) <> ''")
    rows = rows.withColumn("call", F.lower(F.btrim("logical_request_id"))).select("session_id", "call", "attempt_index", "row_id", "raw_usage_json")
    first = rows.groupBy("session_id", "call", "attempt_index").agg(F.min("row_id").alias("first_row"), F.min_by("raw_usage_json", "row_id").alias("first_json"))
    pairs = rows.join(first, ["session_id", "call", "attempt_index"]).where("row_id <> first_row")
    now = compare.json_paths(pairs, "row_id", "raw_usage_json")
    before = compare.json_paths(pairs, "row_id", "first_json")
    return compare.keyed_diff(before, now, ["row_id", "path"], "value")


def page_streams(spark, sf_dir):
    """Every text as an HTML page, read again: how many facts of each stream."""
    pages = _docs(spark, sf_dir).select("doc_id", "text").where("text is not null")
    found = facts.scanned(pages, "doc_id", "text", lambda t: facts.page_facts(facts.html_of(t)))
    return found.where("stream in ('heading', 'code', 'item', 'cell')").groupBy("doc_id", "stream").agg(F.count("*").alias("n"))


def page_differences(spark, sf_dir):
    """Every text as an HTML page against the Markdown of the first text of its work, stream by stream: the first place that differs and how many do."""
    docs, pairs = _pairs(spark, sf_dir)
    keep = "stream in ('heading', 'code', 'cell')"
    now = facts.scanned(pairs, "doc_id", "text", lambda t: facts.page_facts(facts.html_of(t))).where(keep)
    first = facts.scanned(docs, "doc_id", "text", facts.text_facts).where(keep).withColumnRenamed("doc_id", "first_doc")
    before = pairs.select("doc_id", "first_doc").join(first, "first_doc").drop("first_doc")
    return compare.first_difference(compare.stream_diff(before, now, ["doc_id", "stream"], ["ord"], "value"), ["doc_id", "stream"])


def number_contexts(spark, sf_dir):
    """Tokens with a digit by what they stand in."""
    found = facts.numbers_of(_docs(spark, sf_dir), "doc_id", "text")
    return found.groupBy("doc_id", "context").agg(F.count("*").alias("n"), F.count("unit").alias("with_unit"))


def math_found(spark, sf_dir):
    """Formulas and dollars that open none."""
    found = facts.scanned(_docs(spark, sf_dir), "doc_id", "text", lambda t: [(kind, a, value) for kind, a, _, value in marks.scan_math(t)])
    return found.groupBy("doc_id", F.col("stream").alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        page_streams, page_differences, number_contexts, math_found, block_counts, code_fences, headings, section_sizes, table_cells, line_offsets, number_tokens, message_templates, term_counts, texts_glossary, equal_texts, packed_lines, page_kinds, page_defects,
        line_differences, line_multisets, heading_differences, usage_json_changes,
    )
}

_LINES = """
WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, regexp_matches(line, '^ {0,3}```') AS f, coalesce(sum(regexp_matches(line, '^ {0,3}```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l0),
o AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM l WHERE NOT f AND before % 2 = 0),
k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^ {0,3}#{1,8}\\s+') THEN 'heading' WHEN regexp_matches(line, '^\\s*\\|') THEN CASE WHEN regexp_matches(line, '^\\s*\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?\\s*$') THEN 'rule' ELSE 'table' END
  WHEN regexp_matches(line, '^\\s*([-*+]|\\d{1,9}[.)])\\s+') THEN 'item' ELSE 'text' END AS t FROM o),
p AS (SELECT *, CASE WHEN t = 'text' AND coalesce(lag(t) OVER w, 'blank') <> 'text' OR t = 'text' AND lag(line_no) OVER w < line_no - 1 THEN 'paragraph' ELSE t END AS kind FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
"""
_TITLE = "regexp_replace(regexp_replace(line, '^ {0,3}#{1,8}\\s+', ''), '\\s*#*\\s*$', '')"
_PAIRS = "pr AS (SELECT d.doc_id, f.first_doc FROM documents d JOIN (SELECT origin_key, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL AND origin_key IS NOT NULL GROUP BY 1) f ON f.origin_key = d.origin_key WHERE d.text IS NOT NULL AND d.doc_id <> f.first_doc)"
_FENCES = "SELECT doc_id, count(*) // 2 AS n FROM l WHERE f GROUP BY 1"

_FENCED = "fb AS (SELECT doc_id, before, string_agg(line, chr(10) ORDER BY line_no) AS value FROM l WHERE NOT f AND before % 2 = 1 GROUP BY 1, 2), fs AS (SELECT doc_id, before + 1 AS before, line_no FROM l WHERE f AND before % 2 = 0), fe AS (SELECT doc_id, before FROM l WHERE f AND before % 2 = 1), fz AS (SELECT fs.doc_id, fs.line_no, coalesce(value, '') AS value FROM fs JOIN fe ON fe.doc_id = fs.doc_id AND fe.before = fs.before LEFT JOIN fb ON fb.doc_id = fs.doc_id AND fb.before = fs.before)"
_STREAMS = _LINES + f""", {_FENCED}, tc AS (SELECT doc_id, line_no, string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|') AS c FROM p WHERE kind = 'table'),
st AS (SELECT doc_id, 'heading' AS stream, line_no, 0 AS k, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS v FROM p WHERE kind = 'heading' UNION ALL SELECT doc_id, 'code', line_no, 0, trim(value, chr(10)) FROM fz
  UNION ALL SELECT doc_id, 'item', line_no, 0, line FROM p WHERE kind = 'item' UNION ALL SELECT doc_id, 'cell', line_no, unnest(range(0, len(c))), trim(regexp_replace(unnest(c), '\\s+', ' ', 'g')) FROM tc)"""

ORACLES = {
    "page_streams": _STREAMS + " SELECT doc_id, stream, count(*) AS n FROM st GROUP BY 1, 2",
    "page_differences": _STREAMS + f""", {_PAIRS}, a AS (SELECT pr.doc_id, stream, row_number() OVER (PARTITION BY pr.doc_id, stream ORDER BY line_no, k) AS pos, v FROM pr JOIN st ON st.doc_id = pr.first_doc WHERE stream <> 'item'),
      b AS (SELECT pr.doc_id, stream, row_number() OVER (PARTITION BY pr.doc_id, stream ORDER BY line_no, k) AS pos, v FROM pr JOIN st ON st.doc_id = pr.doc_id WHERE stream <> 'item'),
      d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.stream, b.stream) AS stream, coalesce(a.pos, b.pos) AS pos, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.stream = b.stream AND a.pos = b.pos WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.v <> b.v)
      SELECT doc_id, stream, CAST(min(pos) AS INTEGER) AS first_pos, count(*) AS n, arg_min(kind, pos) AS kind FROM d GROUP BY 1, 2""",
    "texts_glossary": "WITH l AS (SELECT unnest([" + ", ".join(f"{{'english': '{e}', 'target': '{t}', 'priority': {p}}}" for e, t, p in LIBRARY) + "]) AS r), b AS (SELECT lower(r.english) AS key, arg_min(r.target, r.priority) AS target FROM l GROUP BY 1) SELECT DISTINCT doc_id, key, target FROM documents JOIN b ON regexp_matches(lower(text), '(^|[^a-z0-9])' || key || '([^a-z0-9]|$)')",
    "block_counts": _LINES + f""", c AS (SELECT doc_id, count(*) FILTER (kind = 'heading') AS heading, count(*) FILTER (kind = 'table') AS "table", count(*) FILTER (kind = 'item') AS item, count(*) FILTER (kind = 'paragraph') AS paragraph, CAST(sum(CASE WHEN kind IN ('table', 'rule', 'blank') THEN 0 ELSE len(regexp_extract_all(line, '`[^`]+`')) END) AS BIGINT) AS code FROM p GROUP BY 1)
      SELECT c.doc_id, heading, coalesce(n, 0) AS fence, "table", item, paragraph, code FROM c LEFT JOIN ({_FENCES}) x ON x.doc_id = c.doc_id WHERE heading + "table" + item + paragraph + code + coalesce(n, 0) > 0""",
    "code_fences": _LINES + ", b AS (SELECT doc_id, before, string_agg(line, chr(10) ORDER BY line_no) AS value, count(*) AS lines FROM l WHERE NOT f AND before % 2 = 1 GROUP BY 1, 2), s AS (SELECT doc_id, before + 1 AS before, line_no FROM l WHERE f AND before % 2 = 0) SELECT s.doc_id, s.line_no, coalesce(lines, 0) AS lines, coalesce(value, '') AS value, sha256(coalesce(value, '')) AS digest FROM s LEFT JOIN b ON b.doc_id = s.doc_id AND b.before = s.before",
    "headings": _LINES + f", h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^ {{0,3}}(#{{1,8}})', 1)) AS level, {_TITLE} AS title FROM p WHERE kind = 'heading'), a AS (SELECT *, replace(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}_\\- ]', '', 'g'), ' ', '-') AS base FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY line_no) - 1 AS k FROM a) SELECT doc_id, level, title, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS anchor FROM n",
    "section_sizes": _LINES + f", s AS (SELECT doc_id, kind, last_value(CASE WHEN kind = 'heading' THEN {_TITLE} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM p) SELECT doc_id, section, count(*) AS n FROM s WHERE kind IN ('item', 'paragraph') GROUP BY 1, 2",
    "table_cells": _LINES + ", t AS (SELECT doc_id, line_no, trim(line) AS v, row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no) - 1 AS r FROM (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM p WHERE kind IN ('table', 'rule')) WHERE kind = 'table' ), u AS (SELECT doc_id, line_no, r, string_split(regexp_replace(regexp_replace(v, '^\\|', ''), '\\|$', ''), '|') AS c FROM t) SELECT doc_id, line_no, CAST(r AS INTEGER) AS row, unnest(range(0, len(c))) AS col, trim(unnest(c)) AS cell FROM u",
    "line_offsets": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL) SELECT doc_id, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", length(line) AS length FROM l",
    "number_tokens": f"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z0-9_.,%]*[0-9][A-Za-z0-9_.,%]*')), '^[.,]+', ''), '[.,]+$', '') AS token FROM documents WHERE text IS NOT NULL),
      k AS (SELECT *, CASE WHEN regexp_full_match(token, '[0-9]+([.,][0-9]+)*') THEN 'number' WHEN regexp_full_match(token, '[0-9]+([.,][0-9]+)*({textfacts.UNITS})') THEN 'quantity' ELSE 'identifier' END AS kind FROM r)
      SELECT doc_id, token, kind, CASE WHEN kind <> 'identifier' THEN regexp_extract(token, '^[0-9.,]*[0-9]') END AS amount, CASE WHEN kind = 'quantity' THEN regexp_extract(token, '[^0-9]+$') END AS unit, count(*) AS n FROM k GROUP BY ALL""",
    "message_templates": "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT regexp_replace(line, '[0-9]+', 'N', 'g') AS template, count(*) AS n, min(line) AS sample FROM l WHERE line <> '' GROUP BY 1",
    "term_counts": "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS term FROM documents WHERE text IS NOT NULL) SELECT doc_id, term, count(*) AS n FROM w WHERE term IN ('cell', 'bar', 'pitch', 'port', 'the') GROUP BY 1, 2",
    "equal_texts": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "page_kinds": "WITH u AS (SELECT media_id, regexp_replace(ocr_text, '\\s', '', 'g') AS d FROM image_item WHERE media_id IS NOT NULL), x AS (SELECT media_id, coalesce(length(d) >= 20 AND length(regexp_replace(d, '[^\\p{L}\\p{N}]', '', 'g')) / length(d) >= 0.6, false) AS ok FROM u) SELECT media_id, count(*) AS pages, count(*) FILTER (ok) AS usable_pages, CASE WHEN count(*) FILTER (ok) = count(*) THEN 'text' WHEN count(*) FILTER (ok) = 0 THEN 'scanned' ELSE 'mixed' END AS kind FROM x GROUP BY 1",
    "page_defects": "WITH k AS (SELECT image_id, 'soft_hyphen' AS kind, length(ocr_text) - length(replace(ocr_text, chr(173), '')) AS n FROM image_item UNION ALL SELECT image_id, 'not_sign', length(ocr_text) - length(replace(ocr_text, '¬', '')) FROM image_item UNION ALL SELECT image_id, 'replacement', length(ocr_text) - length(replace(ocr_text, chr(65533), '')) FROM image_item UNION ALL SELECT image_id, 'ligature', len(regexp_extract_all(ocr_text, '[\ufb00-\ufb06]')) FROM image_item) SELECT image_id, kind, n FROM k WHERE n > 0",
    "line_differences": _LINES + f""", {_PAIRS}, a AS (SELECT pr.doc_id, l0.line_no, l0.line FROM pr JOIN l0 ON l0.doc_id = pr.first_doc), b AS (SELECT pr.doc_id, l0.line_no, l0.line FROM pr JOIN l0 ON l0.doc_id = pr.doc_id),
      d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.line_no, b.line_no) AS pos, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.line_no = b.line_no WHERE a.line IS DISTINCT FROM b.line)
      SELECT doc_id, min(pos) AS first_pos, count(*) AS n, arg_min(kind, pos) AS kind FROM d GROUP BY 1""",
    "line_multisets": _LINES + f""", {_PAIRS}, x AS (SELECT pr.doc_id, l0.line, 1 AS d FROM pr JOIN l0 ON l0.doc_id = pr.first_doc UNION ALL SELECT pr.doc_id, l0.line, -1 FROM pr JOIN l0 ON l0.doc_id = pr.doc_id), y AS (SELECT doc_id, line, sum(d) AS d FROM x GROUP BY 1, 2 HAVING sum(d) <> 0)
      SELECT doc_id, CAST(sum(greatest(d, 0)) AS BIGINT) AS missing, CAST(sum(greatest(-d, 0)) AS BIGINT) AS added FROM y GROUP BY 1""",
    "heading_differences": _LINES + f""", {_PAIRS}, h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^ {{0,3}}(#{{1,8}})', 1)) || ' ' || {_TITLE} AS h FROM p WHERE kind = 'heading'),
      a AS (SELECT pr.doc_id, row_number() OVER (PARTITION BY pr.doc_id ORDER BY line_no) AS pos, h FROM pr JOIN h ON h.doc_id = pr.first_doc), b AS (SELECT pr.doc_id, row_number() OVER (PARTITION BY pr.doc_id ORDER BY line_no) AS pos, h FROM pr JOIN h ON h.doc_id = pr.doc_id)
      SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.pos, b.pos) AS pos, a.h AS left_value, b.h AS right_value, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos WHERE a.h IS DISTINCT FROM b.h""",
    "usage_json_changes": """WITH m AS (SELECT row_id, session_id AS s, lower(trim(logical_request_id)) AS c, attempt_index AS a, CASE WHEN json_valid(raw_usage_json) THEN CAST(raw_usage_json AS JSON) END AS j FROM model_usage WHERE session_id IS NOT NULL AND attempt_index IS NOT NULL AND trim(logical_request_id) <> ''),
      f AS (SELECT s, c, a, min(row_id) AS fr FROM m GROUP BY 1, 2, 3), p AS (SELECT m.row_id, m.j AS now, o.j AS old FROM m JOIN f ON f.s = m.s AND f.c = m.c AND f.a = m.a AND m.row_id <> fr JOIN m o ON o.row_id = fr),
      b AS (SELECT row_id, unnest(json_keys(old)) AS path, old FROM p WHERE old IS NOT NULL), n AS (SELECT row_id, unnest(json_keys(now)) AS path, now FROM p WHERE now IS NOT NULL)
      SELECT coalesce(b.row_id, n.row_id) AS row_id, coalesce(b.path, n.path) AS path, CASE WHEN b.row_id IS NULL THEN 'added' WHEN n.row_id IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM b FULL JOIN n ON b.row_id = n.row_id AND b.path = n.path WHERE (old->>('$.' || b.path)) IS DISTINCT FROM (now->>('$.' || n.path)) OR b.row_id IS NULL OR n.row_id IS NULL""",
}
