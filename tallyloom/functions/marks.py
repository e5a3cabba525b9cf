"""Mathematics, numbers with their surroundings, escapes and source lists of Markdown texts."""

from __future__ import annotations

import re
from collections import Counter

from tallyloom.functions.markdown import inline_code

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
#: Signs that a backslash makes plain.
ESCAPABLE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ESCAPE = re.compile(r"\\([" + re.escape(ESCAPABLE) + "])")
_MATH = re.compile(r"\$\$|\$|\\\[")
_INLINE = re.compile(r"([^\s$](?:[^$\n]*[^\s$])?)\$")
_AMOUNT = re.compile(r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?")
_FORMULA = re.compile(r"[+\-*/=<>^_\\|]|(?<![A-Za-z])[A-Za-z](?![A-Za-z])")


def masked_code(text: str) -> str:
    """A text of equal length with blanks in place of fences and inline code."""
    out, fence = [], None
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence is not None or mark:
            out.append(" " * len(line))
            if fence is None:
                fence = mark[1]
            elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = None
            continue
        for a, b, _ in inline_code(line):
            line = line[:a] + " " * (b - a) + line[b:]
        out.append(line)
    return "\n".join(out)


def scan_math(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, content) in order; kind is inline, block or unclosed.

    Two dollars, or a backslash and a bracket, open a block that may go over
    lines; one dollar opens a formula of its line, whose content has no blank
    at its ends.  A closing dollar is taken first, so ``$x$$y$`` are two
    formulas.  An amount of money without anything of a formula behind it on
    its line is none.  Code and escaped dollars are left out.
    """
    plain = masked_code(text or "").replace("\\$", "  ")
    out, at = [], 0
    while mark := _MATH.search(plain, at):
        at = mark.end()
        if mark[0] != "$":
            close = plain.find("$$" if mark[0] == "$$" else "\\]", at)
            if close >= 0:
                out.append(("block", mark.start(), close + 2, text[at:close].strip()))
                at = close + 2
                continue
        elif span := _INLINE.match(plain, at):
            out.append(("inline", mark.start(), span.end(), text[at : span.end() - 1]))
            at = span.end()
            continue
        end = plain.find("\n", at)
        tail = plain[at : end if end >= 0 else len(plain)]
        amount = _AMOUNT.match(tail)
        if not amount or _FORMULA.search(tail, amount.end()):
            out.append(("unclosed", mark.start(), at, mark[0]))
    return out


def resolved_escapes(text: str | None) -> str | None:
    """A text as it reads: a backslash before a sign stands for the sign, but not in code and formulas."""
    if text is None or "\\" not in text:
        return text
    keep = [(a, b) for kind, a, b, _ in scan_math(text) if kind != "unclosed" and text[a] == "$"]
    at = 0
    for line in text.split("\n"):
        keep += [(at + a, at + b) for a, b, _ in inline_code(line)]
        at += len(line) + 1
    out, at = [], 0
    for a, b in sorted(keep):
        if a >= at:
            out += [_ESCAPE.sub(r"\1", text[at:a]), text[a:b]]
            at = b
    return "".join([*out, _ESCAPE.sub(r"\1", text[at:])])


_URL = re.compile(r"(?:https?|ftp)://[^\s<>()\"'\]]+|\]\([^)\s]*\)")
_TAG = re.compile(r"<[A-Za-z/!][^<>]*>")
_TOKEN = re.compile(r"[A-Za-z0-9_]*[0-9][A-Za-z0-9_]*(?:[.,][A-Za-z0-9_]+)*%?")
_NUMBER = re.compile(r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?")
#: Units behind a number, joined to it or after one blank.
UNIT = re.compile(r" ?(%|[mnuµ]?s|min|h|[kMG]?Hz|[KMGT]?i?B|[cmk]?m|[mk]?g|m?V|[mk]?A|[mkM]?W|K|thousand|million|billion)(?![A-Za-z0-9_])")


def flat(text: str) -> str:
    """A text without tags, with one blank for each run of blanks."""
    return re.sub(r"\s+", " ", _TAG.sub("", text))


def numbers(text: str | None) -> list[dict]:
    """Every token with a digit: raw, value, unit, context, line, before, after, occurrence.

    Contexts: code, math, url, identifier (letters at the number, or several
    points) and body.  ``before`` and ``after`` are six characters of the flat
    text; ``occurrence`` counts equal tokens with equal surroundings, from 1.
    """
    text = text or ""
    bare = masked_code(text)
    maths = [(a, b) for kind, a, b, _ in scan_math(text) if kind != "unclosed"]
    urls = [m.span() for m in _URL.finditer(bare)]
    inside = lambda spans, a: any(x <= a < y for x, y in spans)
    out, seen = [], Counter()
    for token in _TOKEN.finditer(text):
        a, b, raw = token.start(), token.end(), token[0]
        number = _NUMBER.match(raw)
        unit = UNIT.fullmatch(raw, number.end()) if number else None
        if bare[a:b] != text[a:b]:
            context = "code"
        elif inside(maths, a):
            context = "math"
        elif inside(urls, a):
            context = "url"
        elif number and (number.end() == len(raw) or unit):
            context = "body"
        else:
            context = "identifier"
        if context == "body" and not unit and (unit := UNIT.match(text, b)):
            b = unit.end()
            raw = text[a:b]
        before, after = flat(text[max(0, a - 40) : a])[-6:], flat(text[b : b + 40])[:6]
        seen[raw, before, after] += 1
        out.append({
            "raw": raw, "value": number[0].replace(",", "") if number and context == "body" else None, "unit": unit[1] if unit and context == "body" else None, "context": context,
            "line": text.count("\n", 0, a) + 1, "before": before, "after": after, "occurrence": seen[raw, before, after],
        })
    return out


def split_sources(value: str | None) -> list[str]:
    """The parts of a list between semicolons that stand outside square brackets; empty ones are left out."""
    depth, parts = 0, [""]
    for sign in value or "":
        depth = depth + 1 if sign == "[" else max(0, depth - 1) if sign == "]" else depth
        if sign == ";" and not depth:
            parts.append("")
        else:
            parts[-1] += sign
    return [p for p in (" ".join(x.split()) for x in parts) if p]


def joined_sources(sources: list[str]) -> str:
    """Sources as one list: of those of one place the one with a remark, then the longest, then the last in order."""
    best: dict[str, str] = {}
    for source in sources:
        place = source.partition(" [")[0]
        best[place] = max(best.get(place, source), source, key=lambda s: (" [" in s, len(s), s))
    return "; ".join(best[p] for p in sorted(best, key=best.get))


def subsequence_end(needle: str, text: str, begin: int, end: int) -> int | None:
    """Where ``needle`` has stood in ``text``, sign after sign in order, within five times its length and 60 signs."""
    at, limit = begin, min(end, begin + 5 * len(needle) + 60)
    for sign in needle:
        at = text.find(sign, at, limit) + 1
        if not at:
            return None
    return at
