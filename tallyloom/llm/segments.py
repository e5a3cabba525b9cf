"""Sentences and terms of many texts at once, as arrays of code points.

Texts are put one behind the other as one array of code points, and what
``subjects.sentences`` and ``subjects.terms`` say of one text is read off
classes of neighbouring characters.  A unit is a clause: a sentence is one
unit, or several between which nothing speaks for a new sentence.  Terms are
numbers: a pair of Chinese characters is the pair itself, a word is a
polynomial hash of 62 bits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: Characters that are worked on at once; a longer text is cut at line ends.
BLOCK_CHARS = 1 << 18

#: What can stand before a line's text.
LEAD = re.compile(r"\s*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]|\d{1,2}:\d{2}(?::\d{2})?\s|(?:[-*+•]|\d{1,3}[.)、])\s|>\s?|(?:User|Assistant|System|Tool|用户|助手|系统|工具)\s*[:：])\s*")
_LEAD_FIRST = "0123456789-*+•>["
_LEAD_PAIRS = ["Us", "As", "Sy", "To", "用户", "助手", "系统", "工具"]
#: Chinese particles; a pair with one of them is no part of a word.
PARTICLES = "的了"

_SPACE, _LOWER, _UPPER, _DIGIT, _HAN, _STOP, _ZH_STOP, _CLOSE, _ZH_CLOSE, _WORDLIKE, _RULE, _JOIN, _PARTICLE, _COMMA = (1 << k for k in range(14))


def _classes() -> np.ndarray:
    """The classes of each code point of the basic plane as bits."""
    table = np.zeros(1 << 16, np.uint16)
    chars = [chr(k) for k in range(1 << 16)]
    table[[k for k, c in enumerate(chars) if c.isspace()]] |= _SPACE
    table[[k for k, c in enumerate(chars) if c.isalnum() or c == "_"]] |= _WORDLIKE
    for bit, text in ((_STOP, ".!?"), (_ZH_STOP, "。！？"), (_CLOSE, "\"')]"), (_ZH_CLOSE, "”’」』）"), (_RULE, "-=*_"), (_JOIN, "-'’"), (_PARTICLE, PARTICLES), (_COMMA, "，,")):
        table[[ord(c) for c in text]] |= bit
    table[ord("a") : ord("z") + 1] |= _LOWER
    table[ord("A") : ord("Z") + 1] |= _UPPER
    table[ord("0") : ord("9") + 1] |= _DIGIT
    table[0x3400 : 0x9FFF + 1] |= _HAN
    return table


_CLASS = _classes()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
LETTER_PAIR = re.compile("[㐀-鿿]{2}")
#: Terms from here on are words, below it pairs of Chinese characters.
WORDS_FROM = 1 << 62


class Units:
    """The clauses of some documents, in order.

    ``doc``: the document's number; ``size``: how many terms; ``han``: whether
    it has Chinese characters; ``opens``: whether a new sentence begins for
    sure; ``closed``: whether the piece that it belongs to ends with a closing
    Chinese sign; ``bare``: whether that piece begins with a comma; ``head``
    and ``tail``: its first three and last two characters, 0 for other scripts.
    """

    FIELDS = ("doc", "size", "han", "opens", "closed", "bare", "head", "tail")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def joined(cls, parts: list[Units]) -> Units:
        kinds = {"doc": np.int64, "size": np.int32, "han": bool, "opens": bool, "closed": bool, "bare": bool, "head": np.int64, "tail": np.int64, "terms": np.int64}
        return cls(**{f: np.concatenate([getattr(p, f) for p in parts]) if parts else np.zeros(0, k) for f, k in kinds.items()})


def _next(mask: np.ndarray) -> np.ndarray:
    """For each place the first place from it on where ``mask`` is true; its length if there is none."""
    at = np.flatnonzero(mask)
    return np.append(at, len(mask))[np.cumsum(mask) - mask]


def units(texts: list[str | None]) -> Units:
    """The units of all texts; null texts have none."""
    parts: list[Units] = []
    held: list[tuple[int, str]] = []
    chars, odd = 0, {}

    def flush():
        nonlocal held, chars
        if held:
            parts.append(_units(held, odd))
        held, chars = [], 0

    for doc, text in enumerate(texts):
        rest = text or ""
        while len(rest) > BLOCK_CHARS and (end := rest.rfind("\n", 0, BLOCK_CHARS)) >= 0:
            flush()
            held, rest = [(doc, rest[:end])], rest[end + 1 :]
            flush()
        if rest:
            held.append((doc, rest))
            chars += len(rest)
            if chars > BLOCK_CHARS:
                flush()
    flush()
    return Units.joined(parts)


def _units(held: list[tuple[int, str]], odd: dict[int, int]) -> Units:
    """The units of some texts; ``odd`` keeps which documents are inside a fence at the end of a block."""
    whole = "\n".join(t for _, t in held) + "\n"
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    k = np.where(c < 1 << 16, _CLASS[c & 0xFFFF], 0).astype(np.uint16)
    if len(beyond := np.flatnonzero(c >= 1 << 16)):
        signs, which = np.unique(c[beyond], return_inverse=True)
        k[beyond] = np.array([_WORDLIKE if chr(x).isalnum() else 0 for x in signs], np.uint16)[which]
    is_ = lambda bit: (k & bit) != 0
    newline = c == 10
    space = is_(_SPACE) & ~newline
    # Lines, their document, first and last sign.
    end = np.flatnonzero(newline)
    begin = np.append(0, end[:-1] + 1)
    length = np.array([len(t) for _, t in held], np.int64)
    text_end = np.cumsum(length + 1) - 1
    line_text = np.searchsorted(text_end, end)
    solid = _next(~(space | newline) | newline)
    first = solid[begin]
    full = first < end
    at = lambda p, d=0: c[np.minimum(p + d, n - 1)]
    # Fences: lines of three backticks or tildes switch code on and off, document by document.
    f0 = at(first)
    fence = full & ((f0 == 96) | (f0 == 126)) & (at(first, 1) == f0) & (at(first, 2) == f0)
    count = np.cumsum(fence)
    starts = np.searchsorted(line_text, np.arange(len(held)))
    before = np.append(0, count)[starts]
    docs = np.array([d for d, _ in held], np.int64)
    carried = np.array([odd.get(d, 0) for d, _ in held[:1]] + [0] * (len(held) - 1), np.int64)
    inside = (count - before[line_text] + carried[line_text]) % 2 == 1
    odd.clear()
    odd[held[-1][0]] = int(inside[-1])
    # Tables, headings, rules, comments and block mathematics are no running text.
    hashes = _next(c != 35)[np.minimum(first, n - 1)] - first
    heading = (hashes >= 1) & (hashes <= 8) & space[np.minimum(first + hashes, n - 1)]
    last = np.append(-1, np.flatnonzero(~(space | newline)))[np.cumsum(~(space | newline))[end]]
    ruled = np.append(0, np.cumsum(is_(_RULE)))
    rule = (last - first >= 2) & (ruled[np.maximum(last, -1) + 1] - ruled[first] == last - first + 1)
    comment = (f0 == 60) & (at(first, 1) == 33) & (at(first, 2) == 45) & (at(first, 3) == 45)
    maths = (f0 == 36) & (at(first, 1) == 36)
    keep = full & ~fence & ~inside & (f0 != 124) & ~heading & ~rule & ~comment & ~maths
    begin, end, line_text, first, f0 = begin[keep], end[keep], line_text[keep], first[keep], f0[keep]
    # Marks before a line's text; few lines can have one.
    second = at(first, 1)
    led = np.isin(f0, [ord(x) for x in _LEAD_FIRST])
    for a, b in _LEAD_PAIRS:
        led |= (f0 == ord(a)) & (second == ord(b))
    for j in np.flatnonzero(led):
        place, stop = int(begin[j]), int(end[j])
        while (lead := LEAD.match(whole, place, stop)) and lead.end() > place:
            place = lead.end()
        begin[j] = place
    return _clauses(c, k, begin, end, docs[line_text])


def _clauses(c: np.ndarray, k: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> Units:
    """The units between ``begin`` and ``end`` of each line."""
    n = len(c)
    is_ = lambda bit: (k & bit) != 0
    newline = c == 10
    han, lower, upper = is_(_HAN), is_(_LOWER), is_(_UPPER)
    space = is_(_SPACE) & ~newline
    pad = lambda m, d: np.append(m[d:], np.zeros(d, bool))  # noqa: E731  (the sign d places on)
    past = lambda m, d=1: np.append(np.zeros(d, bool), m[:-d])
    starts, stops = np.zeros(n + 1, bool), np.arange(n + 1)  # where pieces begin, and where the piece before each begin ends
    # Runs of blanks: what stands before and after them.
    run = np.flatnonzero(space & ~past(space))
    after = _next(~space)[run]
    inner = (run > 0) & (after < n)
    run, after = run[inner], after[inner]
    prev, name = run - 1, upper & pad(lower, 1)
    closers = is_(_CLOSE)
    back = np.maximum.accumulate(np.where(~closers, np.arange(n), -1))[prev]  # the last sign before closing quotes
    opener = np.isin(c[after], [ord(x) for x in "\"'(["]).astype(np.int64)
    said = is_(_UPPER | _DIGIT | _HAN)
    one = (back >= 0) & is_(_STOP)[np.maximum(back, 0)] & (said[after] | (opener.astype(bool) & said[np.minimum(after + 1, n - 1)]))
    four = han[prev] & name[after]
    five = lower[prev] & han[after]
    word_end = _next(~lower)[np.minimum(after + 1, n - 1)]
    run_on = (lower | is_(_DIGIT))[prev] & name[after] & ~is_(_WORDLIKE)[np.minimum(word_end, n - 1)]
    starts[after[one | four | five | run_on]] = True
    stops[after[one]] = back[one] + 1
    # Signs without a blank behind them.
    stop = is_(_STOP)
    starts[:-1] |= past(stop) & past(lower, 2) & (name | han)
    closed_at = np.flatnonzero(is_(_ZH_STOP)) + 1
    behind = _next(~is_(_ZH_CLOSE))[np.minimum(closed_at, n - 1)]
    starts[behind], stops[behind] = True, closed_at
    by_sign = np.zeros(n + 1, bool)
    by_sign[behind] = True
    # Pieces: from a start, or the line's begin, to the next one, or the line's end.
    marks = np.flatnonzero(starts)
    lo, hi = np.searchsorted(marks, begin, side="right"), np.searchsorted(marks, end, side="left")
    count = np.maximum(hi - lo, 0) + 1
    line = np.repeat(np.arange(len(begin)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    padded = np.append(marks, [n, n])
    a = np.where(nth == 0, begin[line], padded[np.minimum(lo[line] + nth - 1, len(marks))])
    b = np.where(nth == count[line] - 1, end[line], padded[np.minimum(lo[line] + nth, len(marks))])
    sums = lambda m: np.append(0, np.cumsum(m))
    letters, hans = sums(lower | upper | han), sums(han)
    good = letters[b] > letters[a]
    a, b, line = a[good], b[good], line[good]
    solid = _next(~space)
    closed, b = by_sign[b], stops[b]
    good = letters[b] > letters[a]
    a, b, line, closed = a[good], b[good], line[good], closed[good]
    a = np.minimum(solid[np.minimum(a, n - 1)], b)
    b = np.maximum.accumulate(np.where(~space, np.arange(n), -1))[b - 1] + 1
    zh = hans[b] > hans[a]
    bare = is_(_COMMA)[np.minimum(a, n - 1)]
    # Clauses of Chinese pieces.
    comma = np.flatnonzero(is_(_COMMA))
    lo, hi = np.searchsorted(comma, a), np.searchsorted(comma, b)
    parts = np.where(zh, hi - lo, 0) + 1
    piece = np.repeat(np.arange(len(a)), parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    padded = np.append(comma, [n, n])
    u = np.where(nth == 0, a[piece], padded[np.minimum(lo[piece] + nth - 1, len(comma))] + 1)
    v = np.where(nth == parts[piece] - 1, b[piece], padded[np.minimum(lo[piece] + nth, len(comma))])
    body = ~((c == 32) | is_(_ZH_STOP))
    bodies = sums(body)
    good = bodies[v] > bodies[u]
    u, v, piece, nth = u[good], v[good], piece[good], nth[good]
    opens = np.append(True, piece[1:] != piece[:-1]) if len(piece) else np.zeros(0, bool)
    place = np.append(np.flatnonzero(body), n)
    head_at, tail_at = place[bodies[u]], place[bodies[v] - 1]
    wide = c.astype(np.int64)
    get = lambda p, ok: np.where(ok, wide[np.clip(p, 0, n - 1)], 0)
    span = tail_at - head_at + 1
    ones = np.ones(len(u), bool)
    head = get(head_at, ones) | get(head_at + 1, span > 1) << 21 | get(head_at + 2, span > 2) << 42
    tail = get(tail_at, ones) | get(tail_at - 1, span > 1) << 21
    in_zh = zh[piece]
    # Terms.
    letter = lower | upper
    word = letter | (is_(_JOIN) & past(letter) & pad(letter, 1))
    begins, ends = np.flatnonzero(word & ~past(word)), np.flatnonzero(word & ~pad(word, 1)) + 1
    long = ends - begins > 1
    begins, ends = begins[long], ends[long]
    small = np.where(upper, c + 32, c).astype(np.uint64)
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, _BASE, np.uint64)))
    summed = np.append(np.uint64(0), np.cumsum(small * power, dtype=np.uint64))
    inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, _BACK, np.uint64)))
    hashed = (summed[ends] - summed[begins]) * inverse[begins]
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    words = ((hashed >> np.uint64(2)) | np.uint64(WORDS_FROM)).astype(np.int64)
    plain = han & ~is_(_PARTICLE)
    pair = np.flatnonzero(plain & pad(plain, 1))
    pairs = wide[pair] << 21 | wide[pair + 1]
    where, keys = np.append(begins, pair), np.append(words, pairs)
    owner = np.searchsorted(u, where, side="right") - 1
    fits = (owner >= 0) & (where < v[np.maximum(owner, 0)]) if len(u) else np.zeros(len(where), bool)
    owner, keys = owner[fits], keys[fits]
    order = np.argsort(owner, kind="stable")
    return Units(
        doc=doc[line[piece]], size=np.bincount(owner, minlength=len(u)).astype(np.int32), han=hans[v] > hans[u], opens=opens, closed=closed[piece], bare=bare[piece],
        head=np.where(in_zh, head, 0), tail=np.where(in_zh, tail, 0), terms=keys[order],
    )


SCHEMA = "doc_id long, terms array<long>, sizes array<int>, marks array<byte>, heads array<long>, tails array<long>"
HAN, OPENS, CLOSED, BARE = 1, 2, 4, 8


def encode(batches):
    """Each document with its units; documents without one are left out."""
    for batch in batches:
        u = units(batch.column("text").to_pylist())
        per_doc = np.bincount(u.doc, minlength=batch.num_rows)
        have = np.flatnonzero(per_doc)
        ends = np.append(0, np.cumsum(per_doc[have])).astype(np.int32)
        term_ends = np.append(0, np.cumsum(u.size.astype(np.int64)))[ends].astype(np.int32)
        marks = (u.han * HAN | u.opens * OPENS | u.closed * CLOSED | u.bare * BARE).astype(np.int8)
        lists = lambda values, at=ends: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(have)), lists(u.terms, term_ends), lists(u.size), lists(marks), lists(u.head), lists(u.tail)],
            names=["doc_id", "terms", "sizes", "marks", "heads", "tails"],
        )
