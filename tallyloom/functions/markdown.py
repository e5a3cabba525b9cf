"""One pass over a Markdown text that yields its facts in order.

A practical subset of CommonMark: fences by sign and length, ATX headings with
up to eight signs, pipe tables, list items, inline code by equal runs of
backticks, links, images, footnotes and dollar mathematics.
"""

from __future__ import annotations

import re

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,8})\s+(.*?)\s*#*\s*$")
_LIST = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+(.*)$")
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)")
_LINK = re.compile(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)[^)]*\)")
_NOTE_DEF = re.compile(r"^\[\^([^\]]+)\]:\s*(.*)$")
_NOTE_REF = re.compile(r"\[\^([^\]]+)\](?!:)")
_BLOCK_MATH = re.compile(r"\$\$(.+?)\$\$", re.S)
_INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?![\s\d]*\s)([^$\n]*?[^\s\\$])\$(?![\w$])")


def cells(row: str) -> list[str]:
    """The cells of a table row: only the outermost pipes are dropped, empty edge cells stay."""
    text = row.strip()
    text = text[1:] if text.startswith("|") else text
    text = text[:-1] if text.endswith("|") and not text.endswith("\\|") else text
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", text)]


def inline_code(line: str) -> list[tuple[int, int, str]]:
    """Code spans of a line: begin, end, code; a run of backticks closes with the next run of equal length."""
    runs = [(m.start(), m.end()) for m in re.finditer(r"`+", line)]
    out, k = [], 0
    while k < len(runs):
        a, b = runs[k]
        close = next((j for j in range(k + 1, len(runs)) if runs[j][1] - runs[j][0] == b - a), None)
        if close is None:
            k += 1
            continue
        code = line[b : runs[close][0]]
        if len(code) > 2 and code[0] == code[-1] == " " and code.strip():
            code = code[1:-1]
        out.append((a, runs[close][1], code))
        k = close + 1
    return out


def _mask(line: str, spans: list[tuple[int, int, str]]) -> str:
    for a, b, _ in spans:
        line = line[:a] + " " * (b - a) + line[b:]
    return line


def facts(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, line from 1, level, value) in the order of the text.

    Kinds: heading, fence (value is the code), open_fence (never closed), table
    (level is the row in its table, value the row), item (level is the
    indentation), paragraph (first line of one), code, link, image, note_ref,
    note_def, math.  Null and empty texts have none.
    """
    out: list[tuple[str, int, int, str]] = []
    lines = (text or "").split("\n")
    fence, body, began, info = None, [], 0, ""
    table_row, in_paragraph = 0, False
    for no, line in enumerate(lines, 1):
        match = _FENCE.match(line)
        if fence is not None:
            if match and match[1][0] == fence[0] and len(match[1]) >= len(fence) and not match[2].strip():
                out.append(("fence", began, len(body), "\n".join(body)))
                fence = None
            else:
                body.append(line)
            continue
        if match:
            fence, body, began, info = match[1], [], no, match[2].strip()
            table_row, in_paragraph = 0, False
            continue
        if not line.strip():
            table_row, in_paragraph = 0, False
            continue
        if heading := _HEADING.match(line):
            out.append(("heading", no, len(heading[1]), heading[2]))
            table_row, in_paragraph = 0, False
        elif line.lstrip().startswith("|"):
            if not _TABLE_RULE.match(line):
                out.append(("table", no, table_row, line.strip()))
                table_row += 1
            in_paragraph = False
            continue
        elif note := _NOTE_DEF.match(line):
            out.append(("note_def", no, 0, note[1]))
            in_paragraph = False
        elif item := _LIST.match(line):
            out.append(("item", no, len(item[1]), item[2]))
            in_paragraph = False
        elif not in_paragraph:
            out.append(("paragraph", no, 0, line.strip()))
            in_paragraph = True
        spans = inline_code(line)
        out += [("code", no, a, code) for a, _, code in spans]
        plain = _mask(line, spans)
        out += [("image", no, m.start(), m[2]) for m in _IMAGE.finditer(plain)]
        out += [("link", no, m.start(), m[2]) for m in _LINK.finditer(plain)]
        out += [("note_ref", no, m.start(), m[1]) for m in _NOTE_REF.finditer(plain)]
        block = [(m.start(), m.end(), m[1]) for m in _BLOCK_MATH.finditer(plain)]
        out += [("math", no, 2, m.strip()) for _, _, m in block]
        out += [("math", no, 1, m[1]) for m in _INLINE_MATH.finditer(_mask(plain, block))]
    if fence is not None:
        out.append(("open_fence", began, len(body), "\n".join(body)))
    return out


def slug(title: str) -> str:
    """The anchor of a heading."""
    return re.sub(r"[^\w\- ]", "", title.strip().lower()).replace(" ", "-")
