"""Queries whose inputs are small literal tables, the same for Spark and SQL; snapshot_changes runs over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import compare, glossary, graphs, pages
from tallyloom.session import read_table
from tallyloom.sources import html, stores

# Literal inputs; null is None.
TERMS = [("CUDA", "", "CUDA", True), ("cuda", "", "统一计算", False), ("kernel", "", "内核", False), ("kernel ", "", "内核", False), ("stream", "", "流", False), ("Stream", "", "码流", False), ("SM", "gpu", "流多处理器", False), (None, "", "x", False)]
EXISTING = [("kernel", "内核"), ("warp", "线程束")]
CANDIDATES = [(1, "Kernel", "内核", False), (2, "warp", "经线", True), (3, "lane", "通道", True), (4, "lane", "车道", True), (5, "tile", "块", False)]
LIBRARY = [("heat sink", "散热片", 1), ("Heat Sink", "散热器", 0), ("lane", "通道", 0), ("clock tree", "时钟树", 0), ("sink", "汇", 0)]
NOTES = [(1, "The heat sink and the lane."), (2, "No clock, no tree."), (3, "A clock tree; a heat-sink."), (4, None), (5, "")]
BOXES = [("d", 1, 1, 0.1, 0.05, 0.9, 0.1), ("d", 1, 2, 0.1, 0.2, 0.45, 0.3), ("d", 1, 3, 0.55, 0.15, 0.9, 0.3), ("d", 1, 4, 0.1, 0.35, 0.45, 0.5), ("d", 1, 5, 0.1, 0.6, 0.9, 0.7), ("d", 1, 6, 0.55, 0.75, 0.9, 0.8), ("d", 1, 7, 0.1, 0.8, 0.45, 0.9), ("d", 2, 8, 0.2, 0.2, 0.1, 0.4)]
FIGURES = [("d", 1, 10, 0.1, 0.1, 0.4, 0.3), ("d", 1, 11, 0.6, 0.1, 0.9, 0.3)]
CAPTIONS = [("d", 1, 20, 0.1, 0.32, 0.4, 0.34), ("d", 1, 21, 0.1, 0.06, 0.4, 0.08), ("d", 1, 22, 0.6, 0.5, 0.9, 0.52), ("d", 2, 23, 0.6, 0.31, 0.9, 0.33)]
FLOW = [("d", 1, 1, "list", False), ("d", 2, 2, "header", False), ("d", 3, 3, "list", True), ("d", 4, 4, "text", False), ("d", 5, 5, "list", True), ("e", 1, 6, "table", True)]
GRID = [("t", 1, 0, 0, 1, 2), ("t", 2, 1, 0, 2, 1), ("t", 3, 1, 1, 1, 1), ("t", 4, 2, 0, 1, 1), ("u", 5, 0, 0, 2, 1), ("u", 6, 0, 1, 1, 2)]
LAYERS = [(1, "global", "host", "a"), (2, "project", "host", "b"), (3, "environment", "host", ""), (0, "default", "port", "80"), (2, "project", "color", None)]
REPLIES = [(200, 0), (200, 7), (429, 0), (503, None), (404, 0), (204, None)]
EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("e", "e")]
PAGE = "<html><head><title>t</title></head><body><h1>One &amp; two</h1><p>Text <a href='b.html'>link</a> on.</p><ul><li>item</li></ul><table><tr><th>k</th><td>v</td></tr></table><pre>x = 1\ny = 2</pre><a href='https://else.example/'>out</a><img src='i.png' alt='pic'>tail</body></html>"


def _t(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_BOX = "doc string, page int, block int, x0 double, y0 double, x1 double, y1 double"


def glossary_consolidated(spark, sf_dir):
    return glossary.consolidate(_t(spark, TERMS, "english string, context string, target string, baseline boolean"))


def glossary_merged(spark, sf_dir):
    return glossary.merge(_t(spark, EXISTING, "english string, target string"), _t(spark, CANDIDATES, "ord int, english string, target string, approved boolean"))


def glossary_selected(spark, sf_dir):
    return glossary.select_terms(_t(spark, LIBRARY, "english string, target string, priority int"), _t(spark, NOTES, "doc_id int, text string"))


def boxes_placed(spark, sf_dir):
    rows = _t(spark, BOXES, _BOX).withColumns({"w": F.lit(595.0), "h": F.lit(842.0)})
    return pages.placed_boxes(rows, "w", "h").select("block", "px0", "py0", "px1", "py1", "valid")


def blocks_in_order(spark, sf_dir):
    return pages.reading_order(_t(spark, BOXES, _BOX)).select("doc", "page", "block", "reading")


def captions_nearest(spark, sf_dir):
    return pages.captions(_t(spark, FIGURES, _BOX), _t(spark, CAPTIONS, _BOX), 0.02).select("figure", "caption", "distance")


def blocks_continued(spark, sf_dir):
    return pages.continued(_t(spark, FLOW, "doc string, ord int, block int, type string, continues boolean"))


def table_grid(spark, sf_dir):
    return pages.table_grid(_t(spark, GRID, "table string, cell int, row int, col int, rowspan int, colspan int"))


def table_holes(spark, sf_dir):
    return pages.grid_holes(table_grid(spark, sf_dir))


def settings_effective(spark, sf_dir):
    return stores.effective_settings(_t(spark, LAYERS, "rank int, source string, key string, value string"))


def replies_classified(spark, sf_dir):
    rows = _t(spark, REPLIES, "status int, code int")
    return rows.select("status", "code", stores.response_class(F.col("status"), F.col("code")).alias("what"))


def links_reachable(spark, sf_dir):
    return graphs.reachable(_t(spark, EDGES, "src string, dst string"), _t(spark, [("a",), ("x",)], "node string"))


def dependency_groups(spark, sf_dir):
    nodes = _t(spark, [(n,) for n in "abcdexyz"], "node string")
    return graphs.components(_t(spark, EDGES, "src string, dst string"), nodes)


def page_blocks(spark, sf_dir):
    return html.parse_pages(_t(spark, [("p", PAGE)], "page string, html string"), "page", "html")


SNAPSHOT = "2026-06-01 00:00:00"


def snapshot_changes(spark, sf_dir):
    """Sessions that are new or changed since a day: the state of each from the rows that had come in by then, and from all rows."""
    rows = read_table(spark, sf_dir, "agent_session").where("id is not null")
    state = lambda df: df.groupBy("id").agg(F.concat_ws("/", F.max(F.coalesce("cli_version", F.lit("-"))), F.count("*").cast("string")).alias("v"))
    return compare.keyed_diff(state(rows.where(F.col("ingested_at") < F.lit(SNAPSHOT).cast("timestamp"))), state(rows), ["id"], "v")


QUERIES = {
    f.__name__: f
    for f in (
        glossary_consolidated, glossary_merged, glossary_selected, boxes_placed, blocks_in_order, captions_nearest, blocks_continued, table_grid, table_holes, settings_effective, replies_classified,
        links_reachable, dependency_groups, page_blocks, snapshot_changes,
    )
}


def _values(name: str, rows, columns: str) -> str:
    def lit(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"{name} ({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


_BOX_COLUMNS = "doc, page, block, x0, y0, x1, y1"
_KEY = "lower(trim(regexp_replace(english, '\\s+', ' ', 'g')))"
_GRID_SQL = "WITH " + _values("g", GRID, "\"table\", cell, row, col, rs, cs") + ", s AS (SELECT \"table\", cell, unnest(range(row, row + rs)) AS row, col, cs FROM g), p AS (SELECT \"table\", cell, row, unnest(range(col, col + cs)) AS col FROM s)"

ORACLES = {
    "glossary_consolidated": "WITH " + _values("t", TERMS, "english, context, target, baseline") + f", v AS (SELECT {_KEY} AS key, context, trim(target) AS target, bool_or(baseline) AS baseline FROM t WHERE english IS NOT NULL GROUP BY 1, 2, 3), c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (baseline) OVER w AS b FROM v WINDOW w AS (PARTITION BY key, context)) SELECT key, context, target, CASE WHEN n = 1 THEN 'single' WHEN b = 1 AND baseline THEN 'baseline' ELSE 'conflict' END AS status FROM c",
    "glossary_merged": "WITH " + _values("e", EXISTING, "english, target") + ", " + _values("c", CANDIDATES, "ord, english, target, approved") + ", j AS (SELECT c.*, lower(c.english) AS key, e.target AS h FROM c LEFT JOIN e ON lower(e.english) = lower(c.english)), k AS (SELECT *, coalesce(h, first_value(CASE WHEN approved THEN target END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS have FROM j) SELECT ord, english, target, CASE WHEN have = target THEN 'same' WHEN have IS NOT NULL THEN 'conflict' WHEN approved THEN 'added' ELSE 'pending' END AS outcome FROM k",
    "glossary_selected": "WITH " + _values("l", LIBRARY, "english, target, priority") + ", " + _values("d", NOTES, "doc_id, text") + ", b AS (SELECT lower(english) AS key, arg_min(target, priority) AS target FROM l GROUP BY 1) SELECT DISTINCT doc_id, key, target FROM d JOIN b ON regexp_matches(lower(text), '(^|[^a-z0-9])' || key || '([^a-z0-9]|$)')",
    "boxes_placed": "WITH " + _values("b", BOXES, _BOX_COLUMNS) + ", v AS (SELECT *, x0 >= 0 AND y0 >= 0 AND x1 <= 1 AND y1 <= 1 AND x0 < x1 AND y0 < y1 AS valid FROM (SELECT doc, page, block, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM b)) SELECT block, CASE WHEN valid THEN round(x0 * 595.0::DOUBLE, 2) END AS px0, CASE WHEN valid THEN round(y0 * 842.0::DOUBLE, 2) END AS py0, CASE WHEN valid THEN round(x1 * 595.0::DOUBLE, 2) END AS px1, CASE WHEN valid THEN round(y1 * 842.0::DOUBLE, 2) END AS py1, valid FROM v",
    "blocks_in_order": "WITH " + _values("b", BOXES, _BOX_COLUMNS) + ", e AS (SELECT *, coalesce(sum(CASE WHEN x1 - x0 >= 0.55 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY y0, x0, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep, CASE WHEN x1 - x0 >= 0.55 THEN 2 WHEN (x0 + x1) / 2 < 0.5 THEN 0 ELSE 1 END AS c FROM b) SELECT doc, page, block, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY ep, c, y0, x0, block) AS INTEGER) AS reading FROM e",
    "captions_nearest": "WITH " + _values("f", FIGURES, _BOX_COLUMNS) + ", " + _values("c", CAPTIONS, _BOX_COLUMNS) + ", n AS (SELECT f.block AS figure, c.block AS caption, round(greatest(c.y0 - f.y1, f.y0 - c.y1, 0), 6)::DOUBLE AS distance FROM f JOIN c ON c.doc = f.doc AND c.page = f.page AND c.x0 < f.x1 AND c.x1 > f.x0), k AS (SELECT *, row_number() OVER (PARTITION BY figure ORDER BY distance, caption) AS k FROM n WHERE distance <= 0.06) SELECT figure, caption, distance FROM k WHERE k = 1",
    "blocks_continued": "WITH " + _values("f", FLOW, "doc, ord, block, type, continues") + ", p AS (SELECT *, last_value(CASE WHEN type NOT IN ('header', 'footer', 'page_number') THEN {'b': block, 't': type} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM f) SELECT doc, block, CASE WHEN p.t = type THEN p.b END AS previous FROM p WHERE continues",
    "table_grid": _GRID_SQL + " SELECT \"table\", row, col, cell, CASE WHEN count(*) OVER (PARTITION BY \"table\", row, col) > 1 THEN 'overlap' END AS problem FROM p",
    "table_holes": _GRID_SQL + ", e AS (SELECT \"table\", min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM p GROUP BY 1), a AS (SELECT \"table\", unnest(range(r0, r1 + 1)) AS row, c0, c1 FROM e), b AS (SELECT \"table\", row, unnest(range(c0, c1 + 1)) AS col FROM a) SELECT \"table\", row, col FROM b EXCEPT SELECT \"table\", row, col FROM p",
    "settings_effective": "WITH " + _values("l", LAYERS, "rank, source, key, value") + " SELECT key, arg_max(value, rank) AS value, arg_max(source, rank) AS source FROM l WHERE value <> '' GROUP BY 1",
    "replies_classified": "WITH " + _values("r", REPLIES, "status, code") + " SELECT status, code, CASE WHEN status = 429 OR status >= 500 THEN 'retry' WHEN status BETWEEN 200 AND 299 AND coalesce(code, 0) = 0 THEN 'ok' ELSE 'error' END AS what FROM r",
    "links_reachable": "WITH RECURSIVE " + _values("e", EDGES, "src, dst") + ", w AS (SELECT 'a' AS node, 0 AS steps UNION SELECT 'x', 0 UNION SELECT dst, steps + 1 FROM w JOIN e ON e.src = w.node WHERE steps < 10) SELECT node, min(steps) AS steps FROM w GROUP BY 1",
    "dependency_groups": "WITH RECURSIVE " + _values("e", EDGES, "src, dst") + ", n AS (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'x', 'y', 'z']) AS node), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT node, node AS r FROM n UNION SELECT w.node, b.dst FROM w JOIN b ON b.src = w.r) SELECT node, min(r) AS grp FROM w GROUP BY 1",
    "snapshot_changes": f"WITH s AS (SELECT id, coalesce(cli_version, '-') AS c, ingested_at < TIMESTAMPTZ '{SNAPSHOT}+00' AS early FROM agent_session WHERE id IS NOT NULL), o AS (SELECT id, max(c) || '/' || count(*) AS v FROM s WHERE early GROUP BY 1), n AS (SELECT id, max(c) || '/' || count(*) AS v FROM s GROUP BY 1) SELECT n.id, CASE WHEN o.id IS NULL THEN 'added' ELSE 'changed' END AS kind FROM n LEFT JOIN o ON o.id = n.id WHERE o.v IS DISTINCT FROM n.v",
}
