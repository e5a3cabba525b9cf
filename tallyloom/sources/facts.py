"""HTML pages as streams of facts that can be laid beside those of their Markdown."""

from __future__ import annotations

import html as escapes
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import markdown, marks

_NOTE = re.compile(r"^(?:fn|footnote|note)[-_:]?(.+)$")
#: What a box beside the text is called by its class.
BOXES = ("note", "warning", "tip", "important", "caution", "danger", "attention", "hint", "seealso")
SKIPPED = {"script", "style", "template", "noscript", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Facts(HTMLParser):
    """Collects facts in the order in which their elements begin."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[str, list | None, list[str]]] = []
        self.runs: list[int] = []
        self.skip = 0
        self.cell = [0, -1, -1]

    def _inside(self, *tags):
        return any(t in tags for t, _, _ in self.open)

    def handle_starttag(self, tag, attrs):
        attrs, row = dict(attrs), None
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        kinds = (attrs.get("class") or "").split()
        if re.fullmatch("h[1-8]", tag):
            row = ["heading", int(tag[1]), ""]
        elif tag == "pre":
            row = ["code", 0, ""]
        elif tag == "code" and not self._inside("pre"):
            row = ["inline-code", 0, ""]
        elif tag in ("math", "tex") or "math" in kinds:
            row = ["math", 2 if tag == "div" or "block" in kinds or attrs.get("display") == "block" else 1, ""]
        elif tag == "img":
            # The dark form of a picture is the same picture.
            if not any("dark" in k for k in kinds):
                self.rows.append(["image", 0, attrs.get("src") or ""])
        elif tag == "a" and attrs.get("href"):
            note = _NOTE.match(attrs["href"].lstrip("#")) if attrs["href"].startswith("#") else None
            self.rows.append(["note-ref", 0, note[1]] if note else ["link", 0, attrs["href"]])
        elif tag in ("ul", "ol", "dl"):
            self.runs.append(0)
        elif tag == "li":
            if note := _NOTE.match(attrs.get("id") or ""):
                row = ["note-def", 0, note[1]]
            else:
                row = ["item", sum(t in ("li", "dd", "dt") for t, _, _ in self.open), ""]
        elif tag == "dt":
            row = ["term", 0, ""]
        elif tag == "table":
            self.cell = [self.cell[0] + 1, -1, -1]
        elif tag == "tr":
            self.cell[1:] = [self.cell[1] + 1, -1]
        elif tag in ("td", "th"):
            self.cell[2] += 1
            row = ["cell", max(self.cell[1], 0), ""]
        elif found := next((b for b in BOXES if b in kinds), None):
            self.rows.append(["box", 0, found])
        if row:
            self.rows.append(row)
        if tag not in VOID:
            self.open.append((tag, row, []))

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skip:
            self.skip -= 1
            return
        if self.skip or not self._inside(tag):
            return
        while self.open:
            name, row, pieces = self.open.pop()
            text = "".join(pieces)
            if row is not None and row[0] != "note-def":
                row[2] = text.strip("\n") if row[0] == "code" else " ".join(text.split())
            if self.open and not (row is not None and row[0] in ("cell", "heading")) and name not in ("ul", "ol", "dl", "table"):
                self.open[-1][2].append(text)
            if name == tag:
                break

    def handle_data(self, data):
        if self.skip:
            return
        if self.open:
            self.open[-1][2].append(data)
        if not self._inside("pre", "code") and "math" not in [r[0] for _, r, _ in self.open if r]:
            # Formulas that are written out in the text.
            self.rows += [["math", 2 if kind == "block" else 1, value] for kind, _, _, value in marks.scan_math(data) if kind != "unclosed"]


def page_facts(page: str | None) -> list[tuple[str, int, str]]:
    """(stream, level, value) of a page in order; null and empty pages have none."""
    parser = _Facts()
    parser.feed(page or "")
    parser.close()
    while parser.open:
        parser.handle_endtag(parser.open[-1][0])
    return [tuple(r) for r in parser.rows]


_STREAM = {"heading": "heading", "fence": "code", "code": "inline-code", "image": "image", "link": "link", "note_ref": "note-ref", "note_def": "note-def", "item": "item", "math": "math"}


def text_facts(text: str | None) -> list[tuple[str, int, str]]:
    """The same streams of a Markdown text."""
    out = []
    for kind, _, level, value in markdown.facts(text):
        if kind == "table":
            out += [("cell", level, " ".join(c.split())) for c in markdown.cells(value)]
        elif kind in _STREAM:
            out.append((_STREAM[kind], level if kind in ("heading", "math") else 0, value if kind == "fence" else " ".join(value.split())))
    return out


def html_of(text: str | None) -> str:
    """A Markdown text as a plain page: headings, fences, tables, list items and paragraphs, without marks inside them."""
    out: list[str] = []
    for kind, _, level, value in markdown.facts(text):
        safe = escapes.escape(value)
        if kind == "heading":
            out.append(f"<h{level}>{safe}</h{level}>")
        elif kind == "fence":
            out.append(f"<pre><code>{safe}</code></pre>")
        elif kind == "item":
            out.append(f"<ul><li>{safe}</li></ul>")
        elif kind == "table":
            cells = "".join(f"<td>{escapes.escape(c)}</td>" for c in markdown.cells(value))
            out.append(("<table>" if level == 0 else "") + f"<tr>{cells}</tr>")
        elif kind == "paragraph":
            out.append(f"<p>{safe}</p>")
    return "\n".join(out)


def scanned(df: DataFrame, key: str, text: str, of) -> DataFrame:
    """key, ord (from 0), stream, level and value of every fact that ``of`` finds in each text."""
    source = df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__text"))
    kind = source.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, n, *fact) for k, (key_, t) in enumerate(zip(batch.column(key).to_pylist(), batch.column("__text").to_pylist())) for n, fact in enumerate(of(t))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            keys = batch.column(key).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns[1:], [pa.int32(), pa.string(), pa.int32(), pa.string()])]], names=[key, "ord", "stream", "level", "value"])

    return source.mapInArrow(run, f"`{key}` {kind}, ord int, stream string, level int, value string")


def numbers_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, raw, value, unit, context, line, before, after and occurrence of every token with a digit."""
    source = df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__text"))
    kind = source.schema[key].dataType.simpleString()
    names = ["raw", "value", "unit", "context", "line", "before", "after", "occurrence"]
    types = [pa.string()] * 4 + [pa.int32()] + [pa.string()] * 2 + [pa.int32()]

    def run(batches):
        for batch in batches:
            rows = [(k, n) for k, t in enumerate(batch.column("__text").to_pylist()) for n in marks.numbers(t)]
            keys = batch.column(key).take(pa.array([k for k, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([n[f] for _, n in rows], t) for f, t in zip(names, types)]], names=[key, *names])

    return source.mapInArrow(run, f"`{key}` {kind}, raw string, value string, unit string, context string, line int, before string, after string, occurrence int")
