"""HTML pages as ordered blocks, links and table cells, with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin a block, and those without an end tag.
BLOCKS = {"p": "paragraph", "li": "item", "dt": "term", "dd": "definition", "blockquote": "quote", "figcaption": "caption", "summary": "summary", "td": "cell", "th": "header_cell", "pre": "code_block"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "template", "noscript", "head"}


#: Elements whose start or end closes what is left open inside.
LISTS, ROWS = {"ul", "ol", "dl"}, {"table", "tr", "thead", "tbody"}
ITEMS = {"li", "dt", "dd"}


class _Blocks(HTMLParser):
    """Collects blocks in the order in which they begin; open paragraphs, items and cells end where the next one begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[int, tuple[str, int, str, str]]] = []
        self.open: list[dict] = []
        self.lists = self.begun = self.skip = 0
        self.preformatted = 0
        self.code: list[str] | None = None

    def _begin(self, kind, level, tag):
        self.begun += 1
        self.open.append({"kind": kind, "level": level, "tag": tag, "at": self.begun, "pieces": []})

    def _end(self, k):
        """Ends the open blocks from ``k`` on."""
        for block in self.open[k:]:
            raw = "".join(block["pieces"])
            text = raw.strip("\n") if block["kind"] == "code_block" else " ".join(raw.split())
            if text or block["kind"] in ("cell", "header_cell"):
                self.out.append((block["at"], (block["kind"], block["level"], text, "")))
        del self.open[k:]

    def _innermost(self, tags, until=()):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] in tags:
                return k
            if self.open[k]["tag"] in until:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if name := attrs.get("id") or (attrs.get("name") if tag == "a" else None):
            self.begun += 1
            self.out.append((self.begun, ("anchor", 0, "", name)))
        if tag == "code" and not self.preformatted:
            self.code = []
        if tag == "img" or tag == "a" and attrs.get("href"):
            self.begun += 1
            self.out.append((self.begun, ("image", 0, attrs.get("alt") or "", attrs.get("src") or "") if tag == "img" else ("link", 0, "", attrs["href"])))
        elif tag == "br":
            self.handle_data("\n" if self.preformatted else " ")
        kind = BLOCKS.get(tag) or ("heading" if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else None)
        if kind or tag in LISTS or tag in ROWS:
            if (k := self._innermost({"p", ""})) is not None:
                self._end(k)
        if tag in ITEMS and (k := self._innermost(ITEMS, LISTS)) is not None:
            self._end(k)
        if tag in ("td", "th", "tr") and (k := self._innermost({"td", "th"}, {"table"})) is not None:
            self._end(k)
        if tag in LISTS or tag == "table":
            self.lists += tag in LISTS
            self._begin("container", 0, tag)
        elif kind:
            self.preformatted += tag == "pre"
            self._begin(kind, int(tag[1]) if kind == "heading" else self.lists, tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skip:
            self.skip -= 1
            return
        if tag == "code" and self.code is not None:
            self.begun += 1
            self.out.append((self.begun, ("code", 0, "".join(self.code), "")))
            self.code = None
        if (k := self._innermost({tag})) is not None:
            self.lists -= sum(b["tag"] in LISTS for b in self.open[k:])
            self.preformatted -= sum(b["tag"] == "pre" for b in self.open[k:])
            self._end(k)

    def handle_data(self, data):
        if self.skip:
            return
        if self.code is not None:
            self.code.append(data)
        if not self.open or self.open[-1]["kind"] == "container":
            if not data.strip():
                return
            self._begin("text", 0, "")
        self.open[-1]["pieces"].append(data)

    def finish(self):
        self.close()
        self._end(0)
        return [block for _, block in sorted(self.out) if block[0] != "container"]


def blocks(page: str | None) -> list[tuple[str, int, str, str]]:
    """(kind, level, text, target) of a page in order; null and empty pages have none."""
    parser = _Blocks()
    parser.feed(page or "")
    return parser.finish()


class _Tables(HTMLParser):
    """Collects the cells of tables with the places that row and column spans leave them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[int, int, int, int, int, int, bool, str]] = []
        self.tables = 0
        self.stack: list[dict] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.tables += 1
            self.stack.append({"no": self.tables, "row": -1, "taken": [], "cell": None, "cells": 0})
        elif self.stack and tag == "tr":
            self._close()
            self.stack[-1]["row"] += 1
        elif self.stack and tag in ("td", "th"):
            self._close()
            table = self.stack[-1]
            table["row"] = max(table["row"], 0)
            rows, cols = (max(1, int(attrs[k])) if (attrs.get(k) or "").strip().isdigit() else 1 for k in ("rowspan", "colspan"))
            col = 0
            below = [(left, right) for top, bottom, left, right in table["taken"] if top <= table["row"] < bottom]
            while over := [right for left, right in below if left <= col < right]:
                col = max(over)
            # Held as rectangles, so that a span of any length costs nothing.
            table["taken"].append((table["row"], table["row"] + rows, col, col + cols))
            table["cells"] += 1
            table["cell"] = [table["no"], table["cells"], table["row"], col, rows, cols, tag == "th", []]

    def _close(self):
        if self.stack and (cell := self.stack[-1]["cell"]):
            self.out.append((*cell[:7], " ".join("".join(cell[7]).split())))
            self.stack[-1]["cell"] = None

    def handle_endtag(self, tag):
        if self.stack and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"]:
            self.stack[-1]["cell"][7].append(data)


def tables(page: str | None) -> list[tuple[int, int, int, int, int, int, bool, str]]:
    """(table, cell, row, col, rowspan, colspan, is a header, text) of every cell; a nested table is one of its own."""
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    while parser.stack:
        parser.handle_endtag("table")
    return sorted(parser.out)


def parse_tables(df: DataFrame, page: str, html: str) -> DataFrame:
    """The cells of all tables of all pages: page_id, table, cell, row, col, rowspan, colspan, header, text."""
    source = df.where(F.col(html).isNotNull()).select(F.col(page).cast("string").alias("page_id"), F.col(html).alias("html"))
    names = ["page_id", "table", "cell", "row", "col", "rowspan", "colspan", "header", "text"]
    types = [pa.string(), *[pa.int32()] * 6, pa.bool_(), pa.string()]

    def scan(batches):
        for batch in batches:
            rows = [(p, *c) for p, h in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()) for c in tables(h)]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return source.mapInArrow(scan, "page_id string, table int, cell int, row int, col int, rowspan int, colspan int, header boolean, text string")


def broken_links(parsed: DataFrame) -> DataFrame:
    """Links inside a site whose page or anchor does not exist: src, target, problem."""
    links = parsed.where("kind = 'link'").where(~F.col("target").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|//)")).select(F.col("page_id").alias("src"), "target").distinct()
    dst = F.regexp_replace(F.regexp_replace("target", r"[?#].*$", ""), r"^\./", "")
    links = links.withColumns({"dst": F.when(dst == "", F.col("src")).otherwise(dst), "anchor": F.nullif(F.regexp_extract("target", r"#(.*)$", 1), F.lit(""))})
    there = parsed.select(F.col("page_id").alias("p")).distinct()
    anchors = parsed.where("kind = 'anchor'").select(F.col("page_id").alias("ap"), F.col("target").alias("a")).distinct()
    out = links.join(there, F.col("dst") == F.col("p"), "left").join(anchors, (F.col("dst") == F.col("ap")) & (F.col("anchor") == F.col("a")), "left")
    problem = F.when(F.col("p").isNull(), "no page").when(F.col("anchor").isNotNull() & F.col("a").isNull(), "no anchor")
    return out.select("src", "target", problem.alias("problem")).where("problem is not null")


def parse_pages(df: DataFrame, page: str, html: str) -> DataFrame:
    """page_id, ord, kind, level, text, target of every block, link and image of every page."""
    source = df.where(F.col(html).isNotNull()).select(F.col(page).cast("string").alias("page_id"), F.col(html).alias("html"))

    def scan(batches):
        for batch in batches:
            rows = [(p, k, *b) for p, h in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()) for k, b in enumerate(blocks(h))]
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "ord", "kind", "level", "text", "target"])

    return source.mapInArrow(scan, "page_id string, ord int, kind string, level int, text string, target string")


def internal_links(parsed: DataFrame) -> DataFrame:
    """src, dst of links inside a site: relative addresses without query and fragment."""
    links = parsed.where("kind = 'link'").select(F.col("page_id").alias("src"), F.regexp_replace("target", r"[?#].*$", "").alias("dst"))
    return links.where((F.col("dst") != "") & ~F.col("dst").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|//)")).select("src", F.regexp_replace("dst", r"^\./", "").alias("dst")).distinct()
