"""Queries on the integrity of documents, packages and channels."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.operators import compare, integrity, textfacts
from tallyloom.plans import texts, usage
from tallyloom.plans.fixtures import PAGE, _t, _values
from tallyloom.plans.texts import _LINES, _PAIRS, _TITLE
from tallyloom.session import read_table
from tallyloom.sources import html

NOTES = [(1, "a[^1] b[^2]\n\n[^1]: one\n[^3]: three"), (2, "c[^x] d[^x]\n[^x]: once\n[^x]: twice"), (3, "none"), (4, None)]
EXPECTED = [("s1", 0, "d1"), ("s1", 1, "d2"), ("s2", 0, "d3"), ("s3", 0, None)]
GIVEN = [("s1", 0, "d1"), ("s2", 0, "other"), ("s3", 0, "d4"), ("s3", 0, "d4"), ("s9", 0, "d9")]
RANGES = [("1-3,5,3",), ("7",), ("2-1",), ("a",), (" 4 , 2-2 ",), (None,)]
WIDTHS = [("120px", None, None, None), ("50%", "90", None, None), (None, "90", "10", 2.0), (None, None, "10px", 1.5), ("auto", None, None, 2.0)]
IMAGES = [("a", 10, 20), ("a", 10, 20), ("b", 100, 50), (None, 9, 9)]
SITE = [
    ("a.html", "<h1 id='top'>A</h1><a href='b.html#x'>1</a><a href='b.html#y'>2</a><a href='#top'>3</a><a href='./c.html'>4</a><a href='https://x.example/'>5</a><table><tr><th rowspan=2>k</th><th colspan='2'>v</th></tr><tr><td>1<td>2</table>"),
    ("b.html", "<p id=x>b<a href='a.html?q=1'>6</a></p>"),
]
MARKDOWN = "# One & two\n\nText link on.\n\n- items\n\n```\nx = 1\ny = 2\n```\n\nouttail"


def footnotes_unbalanced(spark, sf_dir):
    return integrity.balance(textfacts.scan_facts(_t(spark, NOTES, "d int, t string"), "d", "t"))


def number_changes(spark, sf_dir):
    """Numbers and quantities that a document misses or adds against the first one of its work."""
    docs, pairs = texts._pairs(spark, sf_dir)
    keep = "kind in ('number', 'quantity')"
    now = textfacts.number_tokens(pairs, "doc_id", "text").where(keep).select("doc_id", "kind", "token")
    first = textfacts.number_tokens(docs, "doc_id", "text").where(keep).select(F.col("doc_id").alias("first_doc"), "kind", "token")
    before = pairs.select("doc_id", "first_doc").join(first, "first_doc").select("doc_id", "kind", "token")
    return compare.multiset_diff(before, now, ["doc_id", "kind", "token"]).groupBy("doc_id", "kind").agg(F.sum("missing").alias("missing"), F.sum("added").alias("added"))


def packages_merged(spark, sf_dir):
    return integrity.merged_packages(_t(spark, EXPECTED, "section string, part int, digest string"), _t(spark, GIVEN, "section string, part int, digest string"), ["section", "part"])


def chunks_untiled(spark, sf_dir):
    """Packed chunks always tile their document; the last chunk of each is left out here to show that this is seen."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    chunks = textfacts.packed_lines(docs, "doc_id", "text", 500)
    lines = docs.select("doc_id", F.size(F.split("text", "\n")).alias("lines"))
    last = chunks.groupBy("doc_id").agg(F.max("chunk").alias("top"))
    cut_off = chunks.join(last, "doc_id").where("chunk < top")
    whole = integrity.untiled(chunks, lines).withColumn("side", F.lit("whole"))
    return whole.unionByName(integrity.untiled(cut_off, lines).withColumn("side", F.lit("cut"))).groupBy("side", "problem").agg(F.count("*").alias("n"))


def cues_ambiguous(spark, sf_dir):
    rows = read_table(spark, sf_dir, "subtitle_cue").where("media_id is not null and cue_text is not null")
    return integrity.ambiguous(rows, ["media_id", "track_no", "cue_no"], "cue_text")


def lines_repeated(spark, sf_dir):
    """Lines that a document holds more than once, each with its number."""
    lines = textfacts.lines_of(read_table(spark, sf_dir, "documents"), "doc_id", "text").where("line <> ''")
    return integrity.numbered_repeats(lines, ["doc_id", "line"], "line_no").where("occurrence > 1").select("doc_id", "line_no", "occurrence")


def page_medians(spark, sf_dir):
    rows = read_table(spark, sf_dir, "image_item").where("ocr_text is not null").select("image_id", F.explode(F.split("ocr_text", "\n")).alias("line")).where("btrim(line) <> ''")
    return rows.groupBy("image_id").agg(F.median(F.length("line")).alias("median_length"), F.count("*").alias("lines"))


def code_tokens(spark, sf_dir):
    """Options and words of the code in fences, over all documents."""
    code = textfacts.scan_facts(read_table(spark, sf_dir, "documents"), "doc_id", "text").where("kind = 'fence'")
    return code.select(F.explode(F.regexp_extract_all("value", F.lit("-{0,2}[A-Za-z][A-Za-z0-9_]*"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def headings_demoted(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(integrity.demoted_column("text"), 256).alias("digest"))


def fences_spliced(spark, sf_dir):
    """Fences taken out of each text and put back: how many, and whether the text is the same."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                bare, fences = integrity.with_placeholders(text)
                rows.append((doc, len(fences), integrity.spliced(bare, fences) == text))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.bool_()])], names=["doc_id", "fences", "same"])

    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, fences long, same boolean")


def page_line_kinds(spark, sf_dir):
    rows = read_table(spark, sf_dir, "image_item").where("ocr_text is not null").select(F.explode(F.split("ocr_text", "\n")).alias("line")).where("btrim(line) <> ''")
    return rows.groupBy(integrity.line_kinds(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


def page_ranges(spark, sf_dir):
    rows = _t(spark, RANGES, "spec string")
    return rows.select("spec", F.array_join(integrity.page_numbers(F.col("spec")).cast("array<string>"), " ").alias("pages"))


def contents(spark, sf_dir):
    return integrity.contents(textfacts.slugs(textfacts.scan_facts(read_table(spark, sf_dir, "documents"), "doc_id", "text")))


def channels_joined(spark, sf_dir):
    """Turns as the turn table and as the usage records tell them."""
    turns = read_table(spark, sf_dir, "turn_usage").where("session_id is not null and turn_id is not null")
    used = read_table(spark, sf_dir, "model_usage").where("session_id is not null and turn_id is not null")
    return integrity.joined_with_dispositions(turns, used, ["session_id", "turn_id"])


def image_widths(spark, sf_dir):
    rows = _t(spark, WIDTHS, "css string, attribute string, height string, ratio double")
    width, basis = integrity.shown_width(F.col("css"), F.col("attribute"), F.col("height"), F.col("ratio"), F.lit(600.0))
    return rows.select("css", "attribute", "height", width.alias("width"), basis.alias("basis"))


def image_budget(spark, sf_dir):
    return integrity.decode_budget(_t(spark, IMAGES, "digest string, width int, height int"))


def anchors_encoded(spark, sf_dir):
    """Anchors as reversible names, and whether they come back."""
    heads = textfacts.slugs(textfacts.scan_facts(read_table(spark, sf_dir, "documents"), "doc_id", "text")).select("anchor").distinct()
    name = F.concat(F.lit("n"), F.lower(F.hex(F.encode("anchor", "UTF-8"))))
    return heads.select("anchor", name.alias("name")).withColumn("back", F.decode(F.unhex(F.expr("substr(name, 2)")), "UTF-8") == F.col("anchor"))


def report_mismatches(spark, sf_dir):
    """A saved report against its recomputation; one number of it was changed."""
    now = usage.usage_by_group(spark, sf_dir).select("grp", F.to_json(F.struct("records", "input", "output")).alias("v"))
    saved = usage.usage_by_group(spark, sf_dir).withColumn("records", F.when(F.col("grp") == "child", F.col("records") + 1).otherwise(F.col("records"))).select("grp", F.to_json(F.struct("records", "input", "output")).alias("v"))
    return compare.keyed_diff(saved, now, ["grp"], "v")


def html_grid(spark, sf_dir):
    """The grid places that the cells of HTML tables cover."""
    cells = html.parse_tables(_t(spark, SITE, "page string, html string"), "page", "html")
    grid = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    return grid.select("page_id", "table", F.col("r").alias("row"), F.col("c").alias("col"), "header", "text")


def links_broken(spark, sf_dir):
    return html.broken_links(html.parse_pages(_t(spark, SITE, "page string, html string"), "page", "html"))


def page_reconciled(spark, sf_dir):
    """A page rendered as Markdown against a Markdown text of it, block by block; one item was changed."""
    parsed = html.parse_pages(_t(spark, [("1", PAGE)], "page string, html string"), "page", "html")
    facts = lambda df, doc: textfacts.scan_facts(df, doc, "text").select("doc_id", "ord", F.concat_ws(": ", "kind", "value").alias("v"))
    return compare.stream_diff(facts(integrity.page_markdown(parsed), "page_id"), facts(_t(spark, [(1, MARKDOWN)], "page_id int, text string"), "page_id"), ["doc_id"], ["ord"], "v")


QUERIES = {
    f.__name__: f
    for f in (
        footnotes_unbalanced, number_changes, packages_merged, chunks_untiled, cues_ambiguous, lines_repeated, page_medians, code_tokens, headings_demoted, fences_spliced, page_line_kinds, page_ranges,
        contents, channels_joined, html_grid, links_broken, image_widths, image_budget, anchors_encoded, report_mismatches, page_reconciled,
    )
}

_HEADS = _LINES + f", h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^ {{0,3}}(#{{1,8}})', 1)) AS level, {_TITLE} AS title FROM p WHERE kind = 'heading'), a AS (SELECT *, replace(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}_\\- ]', '', 'g'), ' ', '-') AS base FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY line_no) - 1 AS k FROM a), hd AS (SELECT doc_id, line_no, level, title, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS anchor FROM n)"
_TOKENS = f"""tk AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z0-9_.,%]*[0-9][A-Za-z0-9_.,%]*')), '^[.,]+', ''), '[.,]+$', '') AS token FROM documents WHERE text IS NOT NULL),
kd AS (SELECT *, CASE WHEN regexp_full_match(token, '[0-9]+([.,][0-9]+)*') THEN 'number' WHEN regexp_full_match(token, '[0-9]+([.,][0-9]+)*({textfacts.UNITS})') THEN 'quantity' END AS kind FROM tk)"""

ORACLES = {
    "footnotes_unbalanced": "WITH " + _values("d", NOTES, "doc_id, t") + ", l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), f AS (SELECT doc_id, regexp_extract(line, '^\\[\\^([^\\]]+)\\]:', 1) AS label, 0 AS refs, 1 AS defs FROM l WHERE regexp_matches(line, '^\\[\\^([^\\]]+)\\]:') UNION ALL SELECT doc_id, regexp_replace(unnest(regexp_extract_all(line, '\\[\\^[^\\]]+\\]')), '[\\[\\]^]', '', 'g'), 1, 0 FROM l WHERE NOT regexp_matches(line, '^\\[\\^([^\\]]+)\\]:')), g AS (SELECT doc_id, label, sum(refs)::BIGINT AS refs, sum(defs)::BIGINT AS defs FROM f GROUP BY 1, 2), p AS (SELECT *, CASE WHEN defs = 0 THEN 'no definition' WHEN refs = 0 THEN 'no reference' WHEN defs > 1 THEN 'repeated definition' END AS problem FROM g) SELECT * FROM p WHERE problem IS NOT NULL",
    "number_changes": f"WITH {_PAIRS}, {_TOKENS}, x AS (SELECT pr.doc_id, kind, token, 1 AS d FROM pr JOIN kd ON kd.doc_id = pr.first_doc WHERE kind IS NOT NULL UNION ALL SELECT pr.doc_id, kind, token, -1 FROM pr JOIN kd ON kd.doc_id = pr.doc_id WHERE kind IS NOT NULL), y AS (SELECT doc_id, kind, token, sum(d) AS d FROM x GROUP BY 1, 2, 3 HAVING sum(d) <> 0) SELECT doc_id, kind, CAST(sum(greatest(d, 0)) AS BIGINT) AS missing, CAST(sum(greatest(-d, 0)) AS BIGINT) AS added FROM y GROUP BY 1, 2",
    "packages_merged": "WITH " + _values("e", EXPECTED, "section, part, digest") + ", " + _values("g", GIVEN, "section, part, digest") + ", n AS (SELECT section, part, count(*) AS n, min(digest) AS d FROM g GROUP BY 1, 2) SELECT coalesce(e.section, n.section) AS section, coalesce(e.part, n.part) AS part, CASE WHEN e.section IS NULL THEN 'extra' WHEN n IS NULL THEN 'missing' WHEN n.n > 1 THEN 'repeated' WHEN e.digest IS NOT DISTINCT FROM n.d THEN 'ok' ELSE 'changed' END AS state FROM e FULL JOIN n ON e.section = n.section AND e.part = n.part",
    "chunks_untiled": "SELECT 'cut' AS side, 'end' AS problem, count(*) AS n FROM documents WHERE text IS NOT NULL",
    "cues_ambiguous": "SELECT media_id, track_no, cue_no, count(DISTINCT cue_text) AS n FROM subtitle_cue WHERE media_id IS NOT NULL AND cue_text IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT cue_text) > 1",
    "lines_repeated": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS occurrence FROM l WHERE line <> '') SELECT doc_id, line_no, occurrence FROM r WHERE occurrence > 1",
    "page_medians": "WITH l AS (SELECT image_id, unnest(string_split(ocr_text, chr(10))) AS line FROM image_item WHERE ocr_text IS NOT NULL) SELECT image_id, CAST(median(length(line)) AS DOUBLE) AS median_length, count(*) AS lines FROM l WHERE trim(line) <> '' GROUP BY 1",
    "code_tokens": _LINES + ", c AS (SELECT unnest(regexp_extract_all(line, '-{0,2}[A-Za-z][A-Za-z0-9_]*')) AS token FROM l WHERE NOT f AND before % 2 = 1) SELECT token, count(*) AS n FROM c GROUP BY 1",
    "headings_demoted": _LINES + ", d AS (SELECT doc_id, string_agg(CASE WHEN NOT f AND before % 2 = 0 AND regexp_matches(line, '^#{1,8}\\s') THEN '#' || line ELSE line END, chr(10) ORDER BY line_no) AS t FROM l GROUP BY 1) SELECT d.doc_id, sha256(t) AS digest FROM d",
    "fences_spliced": _LINES + ", c AS (SELECT doc_id, count(*) // 2 AS n FROM l WHERE f GROUP BY 1) SELECT d.doc_id, coalesce(n, 0) AS fences, true AS same FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id WHERE text IS NOT NULL",
    "page_line_kinds": "WITH l AS (SELECT unnest(string_split(ocr_text, chr(10))) AS line FROM image_item WHERE ocr_text IS NOT NULL) SELECT CASE WHEN regexp_matches(line, '^\\s*(第\\s*[0-9]+\\s*[章节]|[0-9]+(\\.[0-9]+)+\\s+\\S|Chapter\\s+[0-9]+)') THEN 'chapter' WHEN regexp_matches(line, '^\\s*(Figure|Fig\\.|Table|图|表)\\s*[0-9]+') THEN 'caption' WHEN regexp_matches(line, '^\\s*(\\[[0-9]{1,3}\\]|[0-9]{1,2}\\))\\s*\\S') THEN 'note' WHEN regexp_matches(line, '[=<>]\\s*[0-9A-Za-z(]') AND regexp_matches(line, '[-+*/^]') THEN 'formula' ELSE 'text' END AS kind, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1",
    "page_ranges": "WITH " + _values("r", [(a, b) for (a,), b in zip(RANGES, ["1 2 3 5", "7", None, None, "4 2", None])], "spec, pages") + " SELECT spec, pages FROM r",
    "contents": _HEADS + " SELECT doc_id, count(*) AS entries, string_agg(repeat('  ', level - 1) || '- [' || title || '](#' || anchor || ')', chr(10) ORDER BY line_no) AS toc FROM hd GROUP BY 1",
    "channels_joined": "WITH t AS (SELECT DISTINCT session_id, turn_id FROM turn_usage WHERE session_id IS NOT NULL AND turn_id IS NOT NULL), u AS (SELECT DISTINCT session_id, turn_id FROM model_usage WHERE session_id IS NOT NULL AND turn_id IS NOT NULL) SELECT coalesce(t.session_id, u.session_id) AS session_id, coalesce(t.turn_id, u.turn_id) AS turn_id, CASE WHEN t.session_id IS NULL THEN 'right only' WHEN u.session_id IS NULL THEN 'left only' ELSE 'both' END AS disposition FROM t FULL JOIN u ON t.session_id = u.session_id AND t.turn_id = u.turn_id",
    "image_widths": "WITH " + _values("w", [(c, a, h, w, b) for (c, a, h, _), (w, b) in zip(WIDTHS, [(120.0, "px"), (300.0, "percent"), (90.0, "attribute"), (15.0, "height"), (None, "undetermined")])], "css, attribute, height, width, basis") + " SELECT css, attribute, height, width::DOUBLE AS width, basis FROM w",
    "image_budget": "WITH " + _values("i", IMAGES, "digest, width, height") + ", f AS (SELECT digest, count(*) AS uses, max(width * height * 4) AS b FROM i WHERE digest IS NOT NULL GROUP BY 1) SELECT count(*) AS files, sum(uses)::BIGINT AS uses, sum(b)::BIGINT AS bytes_once, sum(b * uses)::BIGINT AS bytes_all, max(b)::BIGINT AS largest FROM f",
    "anchors_encoded": _HEADS + " SELECT DISTINCT anchor, 'n' || lower(hex(anchor)) AS name, true AS back FROM hd",
    "report_mismatches": "SELECT 'child' AS grp, 'changed' AS kind WHERE EXISTS (SELECT 1 FROM model_usage WHERE query_source IN ('subagent', 'workflow_child'))",
    "html_grid": "SELECT 'a.html' AS page_id, 1 AS \"table\", * FROM (VALUES (0, 0, true, 'k'), (1, 0, true, 'k'), (0, 1, true, 'v'), (0, 2, true, 'v'), (1, 1, false, '1'), (1, 2, false, '2')) t (row, col, header, text)",
    "links_broken": "SELECT 'a.html' AS src, * FROM (VALUES ('b.html#y', 'no anchor'), ('./c.html', 'no page')) t (target, problem)",
    "page_reconciled": "SELECT 1::BIGINT AS doc_id, 3 AS pos, 'item: item' AS left_value, 'item: items' AS right_value, 'changed' AS kind",
}
