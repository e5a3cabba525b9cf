"""Repair of text read from scanned pages.

Three repairs per work (pages of one media): lines that are furniture of the
page, words broken at a line's end, and words with wrongly recognised
characters.  What a work repeats at its pages' edges is counted in SQL; a page
is only ever handled by itself, so a work of any length spreads over tasks.

Misread words are found by anagram values: the value of a word is the sum of
its characters' values, so a confusion of characters changes it by a fixed
difference.  Rare words plus each difference are joined with frequent words of
that value, and the pair is kept if the confusion really turns one into the
other.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import Written, cut, write_cut

#: Signs that end a line in the middle of a word.
HYPHENS = "-‐‑­¬"
#: What a reader of scans writes (left) for what stands there (right).
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("+", "t"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"),
    ("b", "h"), ("h", "b"), ("f", "e"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("tl", "d"),
    ("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"),
]
#: A word is a misreading if its right form is this many times as frequent ...
RATIO = 12
#: ... or, if it holds a sign that no word holds among letters, just as frequent.
#: Windows of characters need less, as many windows must agree.
WINDOW_RATIO = 2
#: A right form stands at least this often in the corpus.
LEAST = 3
#: Lines behind a page's edge that are looked at besides.
LOOK_AHEAD = 2
#: Misread words up to this number are sent to all tasks, more are joined by shuffle.
BROADCAST_WORDS = 200_000
#: Pages between two entries of the look-up of the next page.
PAGE_BLOCK = 1024

_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_NUM = r"(?P<n>\d{1,9}|[ivxlcdm]{1,15})"
_FORMS = [
    re.compile(x)
    for x in (
        rf"[-—–·•~*=_]+ ?{_NUM} ?[-—–·•~*=_]+", rf"[\[(（【] ?{_NUM} ?[\])）】]", rf"(?:page|pag|pg|p)\.? ?{_NUM}(?: ?(?:[o0]f|/) ?\d+)?", rf"{_NUM} ?(?:/|\||[o0]f|／) ?\d+",
        rf"第 ?{_NUM} ?[页頁](?: ?[/,，]? ?共 ?\d+ ?[页頁])?", rf"{_NUM} ?[页頁]",
    )
]
_BARE = re.compile(_NUM)
_FOLD_DIGITS = str.maketrans("lIoOsSB|", "11005581")
_HAN = re.compile(r"[㐀-鿿]")
_END = re.compile(r"[.?!;:,。？！；：，、…]$")


def _roman(text: str) -> int | None:
    if not text or not _ROMAN.fullmatch(text):
        return None
    value, last = 0, 0
    for sign in reversed(text):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[sign]
        value, last = (value - v, last) if v < last else (value + v, v)
    return value


def page_number(text: str) -> tuple[int, bool] | None:
    """The page number that a text states, and whether signs or words mark it as one."""
    low = text.strip().casefold()
    for marked, forms in ((True, _FORMS), (False, [_BARE])):
        for form in forms:
            if match := form.fullmatch(low):
                n = match["n"]
                value = int(n) if n.isdigit() else _roman(n)
                if value is not None:
                    return value, marked
    folded = text.strip().translate(_FOLD_DIGITS).casefold()
    if folded != low and re.search(r"\d", text):
        return page_number(folded) if folded != text else None
    return None


def edge_parts(line: str) -> tuple[int | None, bool, str]:
    """Number, whether it is marked as a page number, and the text beside it."""
    text = line.strip()
    if found := page_number(text):
        return found[0], found[1], ""
    pieces = re.split(r"\s{2,}|\t", text)
    if len(pieces) == 2:
        for number, rest in (pieces, pieces[::-1]):
            if found := page_number(number):
                return found[0], True, rest
    return None, False, text


_CLOSED = re.compile(r"[.?!。？！]$")
#: A line that is no sentence and no part of one.
_SHORT = re.compile(r"[^.,;:!?。，；：！？]{1,60}")
#: What is misread for what, folded together in a line's key.
_KEY_PAIRS = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u")]
_KEY_CHARS = str.maketrans({
    "0": "o",
    "1": "i",
    "5": "s",
    "9": "g",
    "+": "t",
    "6": "b",
    "c": "e",
    "f": "e",
    "l": "i",
    "|": "i",
    "h": "b",
})


def text_key(text: str) -> str:
    """What stays of a line whatever is misread in it: confusable characters fall together."""
    low = text.casefold()
    for a, b in _KEY_PAIRS:
        low = low.replace(a, b)
    return "".join(c for c in low.translate(_KEY_CHARS) if c.isalnum())


def in_capitals(text: str) -> bool:
    """Mostly capital letters; a misread one may look small."""
    letters = [c for c in text if c.isalpha()]
    return len(letters) > 3 and sum(c.isupper() for c in letters) >= 0.8 * len(letters)


def looks_like_title(text: str, width: int) -> bool:
    """A short line without closing sign, in capitals or with a capital second word, or a short Chinese line."""
    if not text or _END.search(text) or text[-1] in HYPHENS or len(text) > 0.9 * max(width, 20):
        return False
    if _HAN.search(text):
        return len(text) <= 24 and not re.search(r"[，。；：？！、]", text) and len(text) < 0.8 * width
    words = text.split()
    if len(words) > 12 or not words[0][:1].isalnum():
        return False
    if in_capitals(text):
        return True
    return len(words) > 1 and words[0][:1].isupper() and any(w[:1].isupper() for w in words[1:]) and not words[1][:1].islower() or (
        len(words) > 2 and words[0][:1].isupper() and sum(w[:1].isupper() for w in words) >= 2 and text.istitle() is False and sum(w[:1].isupper() for w in words[-2:]) > 0
    )


def _kept(df: DataFrame, label: str, scrap: list[Written] | None) -> DataFrame:
    table = write_cut(df, label)
    if scrap is not None:
        scrap.append(table)
    return table.read()


# --- furniture ---------------------------------------------------------------

_EDGE_SCHEMA = "media_id string, image_id string, page long, line_no int, edge string, rank int, number long, marked boolean, key string, title boolean, caps boolean, next_title boolean, alone boolean, closed boolean"


def _edge(lines: list[str], order: list[int], width: int):
    """The lines from a page's edge on that can be furniture, some more lines behind them, and their parts.

    Lines can be furniture as long as page numbers, titles and short lines
    without signs stand between them and the edge.
    """
    parts, titles, open_ = [], [], LOOK_AHEAD
    for i in order:
        part = edge_parts(lines[i])
        parts.append(part)
        titles.append(looks_like_title(part[2], width))
        if part[2] and not titles[-1] and not _SHORT.fullmatch(part[2]) or open_ < LOOK_AHEAD:
            open_ -= 1
        if not open_:
            break
    return order[: len(parts)], parts, titles


def _edges(batches):
    for batch in batches:
        rows = []
        for media, image, page, text in zip(*(batch.column(c).to_pylist() for c in ("media_id", "image_id", "page", "text"))):
            lines = text.split("\n")
            full = [i for i, line in enumerate(lines) if line.strip()]
            width = max((len(lines[i].strip()) for i in full), default=0)
            for edge, order in (("top", full), ("end", full[::-1])):
                order, parts, titles = _edge(lines, order, width)
                for rank, i in enumerate(order):
                    number, marked, rest = parts[rank]
                    # What follows a title, page numbers left out.
                    after = next((titles[k] and not (parts[k][0] is not None and not parts[k][2]) for k in range(rank + 1, len(order)) if parts[k][2]), False)
                    # Whether only page numbers stand between this line and the edge; for a number also titles and footers may.
                    alone = all(not p[2] or (number is not None and not rest and (titles[k] or _SHORT.fullmatch(p[2]))) for k, p in enumerate(parts[:rank]))
                    caps = in_capitals(rest)
                    rows.append((media, image, page, i + 1, edge, rank, number, marked, text_key(rest), titles[rank], caps, after, alone, bool(_CLOSED.search(rest))))
            for i in full[1:]:
                if looks_like_title(lines[i].strip(), width):
                    rows.append((media, image, page, i + 1, "body", 0, None, False, text_key(lines[i]), True, False, False, False, False))
        yield from _records(rows, _EDGE_SCHEMA)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def _records(rows, schema):
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def furniture(pages: DataFrame, scrap: list[Written] | None = None) -> DataFrame:
    """The running headers and footers and page numbers: image_id, line_no.

    ``pages``: media_id, image_id, page (order in the media), first_page, text.  ``scrap`` gets the tables
    written on the way, to be dropped once the result is written.
    """
    edges = _kept(pages.mapInArrow(_edges, _EDGE_SCHEMA), "edges", scrap)
    first = pages.groupBy("media_id").agg(F.min("first_page").alias("first_page"), F.countDistinct("page").alias("n_pages"))
    # The offset between stated number and page that most pages of a work agree on.
    offsets = edges.where("number is not null and alone").groupBy("media_id", (F.col("number") - F.col("page")).alias("offset")).agg(
        F.countDistinct("page").alias("n"), F.max(F.col("marked").cast("int")).alias("m")
    )
    # Of equal ones the one nearest to the page's own place: a stray number in the text is seldom that.
    near = F.struct("n", "m", (-F.abs("offset")).alias("near"), "offset")
    best = offsets.groupBy("media_id").agg(F.max(near).alias("b")).select("media_id", F.col("b.offset").alias("offset"), F.col("b.n").alias("agree"))
    # The title a work's pages carry on top, and what its even pages carry instead.
    tops = edges.where("edge = 'top' and alone and title and key <> ''").join(first, "media_id").where("page > first_page")
    titles = tops.groupBy("media_id", "key").agg(F.countDistinct("page").alias("n"), F.count(F.when(F.col("page") % 2 == 1, 1)).alias("odd"), F.count(F.when(F.col("page") % 2 == 0, 1)).alias("even"))
    style = titles.groupBy("media_id").agg(F.max(F.struct("odd", "n", "key", "even")).alias("t"), F.sum("even").alias("evens")).select(
        "media_id", F.col("t.key").alias("title_key"), F.col("t.even").alias("title_evens"), (F.col("evens") - F.col("t.even")).alias("chapter_evens")
    )
    # A heading in the text of an earlier page, or of this one, makes its repetition on top a running header.
    heads = edges.where("edge = 'body' and key <> ''").groupBy("media_id", "key").agg(F.min("page").alias("head_page"))
    caps = tops.groupBy("media_id").agg(F.avg(F.col("caps").cast("double")).alias("caps_share"))
    known = titles.where("n > 1").select("media_id", "key", F.lit(True).alias("repeated"))
    # Footers: the same text at the end of several pages of the work, or of most works that hold it.
    ends = edges.where("edge = 'end' and alone and key <> '' and not closed").groupBy("media_id", "key").agg(F.countDistinct("page").alias("n"))
    everywhere = ends.groupBy("key").agg(F.sum("n").alias("pages"), F.count("*").alias("works")).where("pages >= 2 * works and works > 2").select("key", F.lit(True).alias("foot_anywhere"))
    feet = ends.join(first, "media_id").where("n > 1 and n >= 0.3 * n_pages").select("media_id", "key", F.lit(True).alias("foot"))

    judged = edges.where("edge <> 'body'").join(first, "media_id").join(best, "media_id", "left").join(style, "media_id", "left").join(caps, "media_id", "left")
    judged = judged.join(heads, ["media_id", "key"], "left").join(known, ["media_id", "key"], "left").join(feet, ["media_id", "key"], "left").join(everywhere, "key", "left")
    right = F.col("number").isNotNull() & (F.col("number") - F.col("page") == F.col("offset")) & ((F.col("agree") > 1) | F.col("marked") | (F.col("offset") == 0) | ((F.col("n_pages") == 1) & (F.col("number") < 1000)))
    number = right & F.col("alone")
    on_top = (F.col("edge") == "top") & F.col("alone") & F.col("title") & (F.col("key") != "")
    has_caps = F.coalesce(F.col("caps_share") >= 0.5, F.lit(False))
    is_title = F.coalesce(F.col("key") == F.col("title_key"), F.lit(False))
    per_chapter = F.col("title_key").isNull() | (F.coalesce(F.col("chapter_evens") * 2 >= F.col("title_evens"), F.lit(False)))
    seen = F.coalesce(F.col("head_page") <= F.col("page"), F.lit(False))
    later = (
        F.when(has_caps, F.col("caps"))
        .when(is_title | F.coalesce(F.col("repeated"), F.lit(False)) | F.col("next_title") | seen, F.lit(True))
        .otherwise(per_chapter & (F.col("page") % 2 == 0))
    )
    header = on_top & F.when(F.col("page") == F.col("first_page"), F.when(has_caps, F.col("caps")).otherwise(F.col("next_title"))).otherwise(later)
    footer = (F.col("edge") == "end") & F.col("alone") & (F.col("key") != "") & ~F.col("closed") & (F.coalesce("foot", F.lit(False)) | F.coalesce("foot_anywhere", F.lit(False)))
    return judged.where(number | header | footer).select("image_id", "line_no").distinct()


# --- running text ------------------------------------------------------------

_BODY_SCHEMA = "media_id string, image_id string, page long, line_no int, line string, next string"
_PUNCT = r"""[\s.,;:!?"'()\[\]{}<>«»“”‘’„。，；：！？、（）《》【】…]+"""
_STRIP = re.compile(rf"^{_PUNCT}|{_PUNCT}$")


def strip_word(word: str) -> str:
    return _STRIP.sub("", word)


def _text_lines(text: str, out) -> list[tuple[int, str]]:
    """The numbered lines of a page that are neither blank nor furniture, without blanks around them."""
    gone = set(out or ())
    return [(i, line.strip()) for i, line in enumerate(text.split("\n"), 1) if line.strip() and i not in gone]


def _body(batches):
    """The lines of running text, each with the first word of the next one of its page."""
    for batch in batches:
        rows = []
        for media, image, page, text, out in zip(*(batch.column(c).to_pylist() for c in ("media_id", "image_id", "page", "text", "out"))):
            lines = _text_lines(text, out)
            nxt = None
            for i, line in reversed(lines):
                rows.append((media, image, page, i, line, nxt))
                nxt = nxt if line.isdigit() else line.split(None, 1)[0]
        yield from _records(rows, _BODY_SCHEMA)


def marked_pages(pages: DataFrame, out: DataFrame) -> DataFrame:
    """The pages with the numbers of the lines that are furniture."""
    listed = out.groupBy("image_id").agg(F.collect_list("line_no").alias("out"))  # the edge lines of one page
    return pages.join(listed, "image_id", "left").select("media_id", "image_id", "page", "text", "out")


def running_text(marked: DataFrame, scrap: list[Written] | None = None) -> DataFrame:
    """The lines that are no furniture; ``next`` is the word that follows a line, on the next page if need be."""
    lines = _kept(marked.mapInArrow(_body, _BODY_SCHEMA), "body", scrap)
    # The first word of each page, by blocks of pages, and of each block.
    word = F.split(F.col("line"), r"\s+")[0]
    heads = lines.where(~F.col("line").rlike(r"^\d+$")).groupBy("media_id", "page").agg(F.min_by(word, "line_no").alias("word"))
    follow = over_pages(heads, F.lead, "word", F.min_by("word", "page"))
    return lines.join(follow, ["media_id", "page"], "left").withColumn("next", F.coalesce("next", "found")).drop("found")


def over_pages(rows: DataFrame, step, value: str, of_block) -> DataFrame:
    """``found``: ``value`` of the page after (``F.lead``) or before (``F.lag``) each one of its work.

    A work is looked through in blocks of pages, so one of any length spreads;
    ``of_block`` picks the value that a block shows to its neighbour.
    """
    blocked = rows.withColumn("block", F.floor(F.col("page") / PAGE_BLOCK))
    inside = blocked.withColumn("near", step(value).over(W.partitionBy("media_id", "block").orderBy("page")))
    blocks = blocked.groupBy("media_id", "block").agg(of_block.alias("shown"))
    across = blocks.select("media_id", "block", step("shown").over(W.partitionBy("media_id").orderBy("block")).alias("far"))
    return inside.join(across, ["media_id", "block"]).select("media_id", "page", F.coalesce("near", "far").alias("found"))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_PUNCT}|{_PUNCT}$", "")


def word_tokens(lines: DataFrame) -> DataFrame:
    """The words of each line but a broken last one: image_id, line_no, at and token (stripped)."""
    parts = F.split(F.col("line"), r"\s+")
    whole = F.when(_is_broken(), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = lines.where("line rlike '[A-Za-z]'").select("image_id", "line_no", F.posexplode(whole).alias("at", "raw"))
    return out.select("image_id", "line_no", "at", _stripped(F.col("raw")).alias("token"))


def _is_broken() -> Column:
    """Whether the last word of a line is broken and goes on."""
    return F.col("line").rlike(rf"[A-Za-z0-9+|][{HYPHENS}]$") & F.col("line").rlike("[A-Za-z]") & F.col("next").isNotNull()


def anagram_value(c: Column) -> Column:
    """The sum of the fifth powers of a text's code points, modulo a prime: equal for anagrams."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda a, ch: a + _char_value(ch))


_PRIME = 1_000_000_007


def _char_value(ch: Column) -> Column:
    p = F.lit(_PRIME).cast("long")
    x = F.ascii(ch).cast("long")
    x2 = (x * x) % p
    return F.when(ch == "", F.lit(0).cast("long")).otherwise((((x2 * x2) % p) * x) % p)


def valued(words: DataFrame) -> DataFrame:
    """Adds ``value``, the anagram value of ``word``."""
    return words.withColumn("value", anagram_value(F.col("word")))


def confusable_variants(rare: DataFrame, frequent: DataFrame, confusions: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Pairs (word, right) of which a confusion turns ``right`` into ``word``: word, right, n, right_n, wrong, true.

    ``rare`` and ``frequent``: word, n and, if it is stored, value (see
    ``valued``).  ``confusions``: (wrong, true), a fixed list or a table of a
    bounded number of rows.  A word meets another one only where their values
    differ by what a confusion changes.
    """
    rare, frequent = (df if "value" in df.columns else valued(df) for df in (rare, frequent))
    confusions = [tuple(r) for r in confusions.select("wrong", "true").collect()] if isinstance(confusions, DataFrame) else confusions
    known = [(w, t, _value_of(t) - _value_of(w)) for w, t in confusions]
    each = F.array(*[F.struct(F.lit(w).alias("wrong"), F.lit(t).alias("true"), F.lit(d).cast("long").alias("difference")) for w, t, d in known])
    held = F.filter(each, lambda x: F.instr(F.col("word"), x["wrong"]) > 0)
    asked = rare.select("word", "n", "value", F.explode(held).alias("c")).select("word", "n", "c.wrong", "c.true", (F.col("value") + F.col("c.difference")).alias("value"))
    stored = frequent.select(F.col("word").alias("right"), F.col("n").alias("right_n"), "value")
    pairs = asked.join(stored, "value")
    # The values agree; now at one place the confusion must turn one into the other.
    places = F.sequence(F.lit(1), F.length("word"))
    fits = F.exists(
        places,
        lambda k: (F.substring("word", k, F.length("wrong")) == F.col("wrong"))
        & (F.concat(F.substring("word", F.lit(1), k - 1), F.col("true"), F.substring("word", k + F.length("wrong"), F.length("word"))) == F.col("right")),
    )
    return pairs.where(fits).drop("value")


def _value_of(text: str) -> int:
    return sum(pow(ord(c), 5, _PRIME) for c in text)


_STRANGE = "[0-9+|\\x{FB00}-\\x{FB06}]"


def misread_words(words: DataFrame, counts: DataFrame) -> DataFrame:
    """Those of ``words`` that are misread, with their right forms: word, right, wrong, true.

    ``words`` and ``counts``, the words of the corpus: word (lower case), n,
    value.  The most frequent right form counts, then the last in the
    alphabet.
    """
    latin = lambda df: df.where(F.col("word").rlike("[a-z]") & (F.length("word") > 1))
    plain = latin(counts).where(~F.col("word").rlike(_STRANGE) & (F.col("n") >= LEAST))
    pairs = confusable_variants(latin(words), plain, CONFUSIONS)
    strange = F.col("word").rlike(_STRANGE) & ~F.col("word").rlike("^[a-z]{0,2}[0-9]+$|^[0-9]+[a-z]{0,2}$")
    # A single letter with digits, such as v12, is no word; two signs may be misread one after the other.
    kept = pairs.where((F.col("right_n") >= RATIO * F.col("n")) | (strange & (F.col("right_n") >= F.col("n"))))
    kept = kept.where(~F.col("word").rlike("^[a-z]?[0-9]+$") & (F.length("right") > 1))
    best = kept.groupBy("word").agg(F.max_by(F.struct("right", "wrong", "true"), F.struct(F.col("right_n"), F.col("right"))).alias("b"))
    return best.select("word", "b.right", "b.wrong", "b.true")


def _keep_case(word: Column, right: Column, wrong: Column, true: Column) -> Column:
    """``right`` (lower case) in the case of ``word``."""
    low = F.lower(word)
    k = F.expr("get(filter(sequence(1, length(token)), k -> lower(substring(token, k, length(wrong))) = wrong and concat(lower(substring(token, 1, k - 1)), `true`, lower(substring(token, k + length(wrong)))) = right), 0)")
    capital = F.substring(word, 1, 1) != F.substring(low, 1, 1)
    all_caps = (F.upper(word) == word) & (F.length(F.regexp_replace(word, "[^A-Z]", "")) > 1)
    spliced = F.concat(F.substring(word, F.lit(1), k - 1), true, F.substring(word, k + F.length(wrong), F.length(word)))
    return F.when(all_caps, F.upper(right)).when(capital, F.concat(F.upper(F.substring(spliced, 1, 1)), F.substring(spliced, F.lit(2), F.length(spliced)))).otherwise(spliced)


_ZH_SCHEMA = "image_id string, line_no int, at int, word long, place int"
_ZH_COUNT = "word long, place int, n long"
#: Three characters as one number of 21 bits each; ``place`` says which of them a window is about.
_BITS, _SIGN = 21, (1 << 21) - 1
_BMP_SPACE = np.array([chr(k).isspace() for k in range(1 << 16)])
_BMP_DIGIT = np.array([chr(k).isdigit() for k in range(1 << 16)])


def _windows(batch):
    """Page, line, place in the line, window and role of every window of three characters around each Chinese character.

    Blanks are left out and a run of digits counts as one 0; a page's begin
    and end are signs of their own.
    """
    texts, pages, numbers = [], [], []
    for k, (first, second) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
        lines = sorted(zip(second, first)) if isinstance(first, list) else [(no, line) for no, line in _text_lines(first, second) if _HAN.search(line)]
        if lines:
            texts += ["^", *[line for _, line in lines], "$"]
            pages += [k] * (len(lines) + 2)
            numbers += [-1, *[no for no, _ in lines], -1]
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    page, number = np.repeat(pages, size).astype(np.int64), np.repeat(numbers, size).astype(np.int64)
    at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    low = np.minimum(code, (1 << 16) - 1)
    code = np.where(_BMP_DIGIT[low], 48, code)
    keep = ~_BMP_SPACE[low]
    code, page, number, at = code[keep], page[keep], number[keep], at[keep]
    if len(code):
        keep = np.append(True, (code[1:] != 48) | (code[:-1] != 48) | (number[:-1] < 0))
        code, page, number, at = code[keep], page[keep], number[keep], at[keep]
    han = np.flatnonzero((code >= 0x3400) & (code <= 0x9FFF))
    for place, first in ((2, han), (1, han - 1), (0, han - 2)):
        # A window about its first or last character does not reach beyond the page's own signs.
        ok = np.ones(len(han), bool) if place == 1 else number[han + 1] >= 0 if place == 2 else number[han - 1] >= 0
        where, begin = han[ok], first[ok]
        yield page[where], number[where], at[where], code[begin] | code[begin + 1] << _BITS | code[begin + 2] << 2 * _BITS, place


def _zh_counts(batches):
    for batch in batches:
        for _, _, _, word, place in _windows(batch):
            words, n = np.unique(word, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.full(len(words), place, np.int32)), pa.array(n.astype(np.int64))], names=["word", "place", "n"])


def _zh_places(wrong):
    """The windows about the characters of ``wrong``."""

    def places(batches):
        for batch in batches:
            for page, number, at, word, place in _windows(batch):
                hit = np.isin(word >> _BITS * (2 - place) & _SIGN, wrong)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("image_id").take(pa.array(page[hit])), pa.array(number[hit].astype(np.int32)), pa.array(at[hit].astype(np.int32)), pa.array(word[hit]), pa.array(np.full(int(hit.sum()), place, np.int32))],
                    names=["image_id", "line_no", "at", "word", "place"],
                )

    return places


def _code_value(code: Column) -> Column:
    p = F.lit(_PRIME).cast("long")
    x2 = (code * code) % p
    return (((x2 * x2) % p) * code) % p


def misread_characters(lines: DataFrame) -> DataFrame:
    """Misread Chinese characters: image_id, line_no, at (place in the line), ch, right.

    ``lines``: image_id, line_no, zh (a line with Chinese text, or null).
    """
    zh = lines.where("zh is not null").groupBy("image_id").agg(F.collect_list("zh").alias("lines"), F.collect_list("line_no").alias("nos"))  # the lines of one page
    return characters_on_pages(zh.select("image_id", "lines", "nos"))


def characters_on_pages(marked: DataFrame) -> DataFrame:
    """Misread Chinese characters of pages: image_id, line_no, at, ch, right.

    ``marked``: image_id and text, out (numbers of lines to leave out), or
    image_id and lines with their numbers.  Windows of three characters are the words here.  A rare window is joined with the
    frequent ones whose anagram value differs from its own by the difference
    of one character.  A character is misread if such pairs with one and the
    same other character explain a large part of its uses in the whole corpus.
    """
    scrap: list[Written] = []
    counts = marked.mapInArrow(_zh_counts, _ZH_COUNT).groupBy("word", "place").agg(F.sum("n").alias("n"))
    sign = lambda k: F.expr(f"shiftright(word, {_BITS} * {k}) & {_SIGN}L")
    own = F.expr(f"shiftright(word, {_BITS} * (2 - place)) & {_SIGN}L")
    value = _code_value(sign(0)) + _code_value(sign(1)) + _code_value(sign(2))
    counts = counts.select("word", "place", "n", own.alias("ch"), value.alias("value"))
    # What two windows that differ in one character have in common: their value less that of the character.
    counts = _kept(counts.withColumn("common", F.col("value") - _code_value(F.col("ch"))), "windows", scrap)
    uses = _kept(counts.groupBy("ch").agg(F.sum("n").alias("windows"), F.coalesce(F.sum(F.when(F.col("place") == 1, F.col("n"))), F.lit(0)).alias("uses")), "uses", scrap)
    most = uses.agg(F.max("uses")).first()[0] or 0
    # Every frequent character of a window stands for what could be meant; of the rare ones only those that RATIO lets pass beside some character.
    seldom = uses.where(F.col("uses") * RATIO <= F.lit(most)).select("ch")
    meant = counts.where("n >= 2").select("place", "common", F.col("word").alias("right_word"), F.col("ch").alias("right"), F.col("n").alias("right_n"))
    cand = counts.join(seldom, "ch", "left_semi").join(meant, ["place", "common"])
    field = F.expr(f"shiftleft({_SIGN}L, {_BITS} * (2 - place))")
    alike = F.col("word").bitwiseOR(field) == F.col("right_word").bitwiseOR(field)
    cand = cand.where(alike & (F.col("ch") != F.col("right")) & (F.col("right_n") >= WINDOW_RATIO * F.col("n")))
    cand = _kept(cand.select("place", "word", "n", "ch", "right", "right_n"), "variants", scrap)
    # For each character the one that makes its windows likeliest; at most one row for each character that exists.
    gain = F.sum(F.col("n") * F.log(F.col("right_n") * 10 + 1))
    pairs = cand.groupBy("ch", "right").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("place") == 1, F.col("n")).otherwise(0)).alias("middle"), gain.alias("gain"))
    pairs = pairs.join(uses, "ch").join(uses.select(F.col("ch").alias("right"), F.col("uses").alias("right_uses")), "right")
    pairs = pairs.where((F.col("right_uses") >= RATIO * F.col("uses")) & (F.col("n") >= 0.5 * F.col("windows")) & (F.col("middle") >= 0.2 * F.col("uses")))
    likely = F.col("gain") - F.col("windows") * F.log("right_uses")
    pairs = pairs.groupBy("ch").agg(F.max(F.struct(likely.alias("likely"), "right")).alias("p")).select("ch", "p.right")
    learned = cut(pairs, "pairs")
    # Where windows stand that were joined for such a pair.
    wrong = np.array(sorted(r.ch for r in learned.select("ch").collect()), np.int64)  # at most one for each character that exists
    places = marked.mapInArrow(_zh_places(wrong), _ZH_SCHEMA)
    variants = cand.join(learned, ["ch", "right"]).select("place", "word", "ch", "right")
    hit = places.join(variants, ["word", "place"])
    sent = lambda c: F.expr(f"decode(unhex(lpad(hex({c}), 8, '0')), 'UTF-32')")
    found = hit.groupBy("image_id", "line_no", "at", "ch", "right").agg(F.count("*").alias("votes"))
    found = cut(found.select("image_id", "line_no", "at", sent("ch").alias("ch"), sent("right").alias("right"), "votes"), "characters")
    for table in scrap:
        table.drop()
    return found


def pages_of(images: DataFrame) -> DataFrame:
    """Pages with text: media_id, image_id, page, first_page, text; repeated rows of an image count once.

    ``first_page`` is the work's first page, with text or without.
    """
    media, page = F.coalesce("media_id", F.lit("")), F.coalesce("item_index", F.lit(0)).cast("long")
    rows = images.where(F.col("image_id").isNotNull()).select("image_id", media.alias("media_id"), page.alias("page"), F.col("ocr_text").alias("text"))
    first = rows.groupBy("media_id").agg(F.min("page").alias("first_page"))
    one = rows.where(F.btrim("text") != "").groupBy("image_id").agg(F.min(F.struct("media_id", "page", "text")).alias("r"))
    return one.select("r.media_id", "image_id", "r.page", "r.text").join(first, "media_id")


def located_repairs(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every repair with its place, and the pages with their furniture.

    Repairs: image_id, line_no, kind, at (the word's or the character's place
    in the stripped line, null for furniture), repaired.  Pages: media_id,
    image_id, page, text, out.
    """
    scrap: list[Written] = []
    pages = _kept(pages_of(images), "pages", scrap)
    out = cut(furniture(pages, scrap), "furniture")
    marked = cut(marked_pages(pages, out), "marked")
    lines = cut(running_text(marked, scrap), "lines")
    for table in scrap:
        table.drop()
    tokens = word_tokens(lines)
    counts = tokens.where(F.col("token").rlike("[A-Za-z]")).groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n"))
    counts = cut(valued(counts), "words")
    wrong = cut(misread_words(counts, counts), "misread")
    small = wrong.count() <= BROADCAST_WORDS
    sized = F.broadcast(wrong) if small else wrong

    # Broken words: written as they stand inside lines elsewhere, joined or with a hyphen.
    last = F.element_at(F.split(F.col("line"), r"\s+"), -1)
    broken = lines.where(_is_broken()).select("image_id", "line_no", (F.size(F.split(F.col("line"), r"\s+")) - 1).alias("at"), F.regexp_replace(_stripped(last), rf"[{HYPHENS}]+$", "").alias("a"), _stripped(F.col("next")).alias("b"))
    broken = broken.where("b <> ''").withColumn("joined", F.concat("a", "b")).withColumn("dashed", F.concat("a", F.lit("-"), "b"))
    broken = cut(broken.select("image_id", "line_no", "at", "a", "b", "joined", "dashed"), "broken")
    asked = broken.select(F.explode(F.array(F.lower("joined"), F.lower("dashed"))).alias("word")).distinct()
    known = cut(valued(asked.join(counts.select("word", "n"), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))), "asked")
    fixed = misread_words(known.withColumn("n", F.greatest("n", F.lit(1))), counts)
    known = known.join(fixed.select("word", "right", F.col("wrong").alias("w"), F.col("true").alias("t")), "word", "left")
    known = known.join(counts.select(F.col("word").alias("right"), F.col("n").alias("right_n")), "right", "left")
    known = cut(known.select("word", "n", "right", "w", "t", F.coalesce("right_n", "n").alias("weight")), "joined")
    j = known.select(F.col("word").alias("jw"), F.col("right").alias("jr"), F.col("weight").alias("jn"), F.col("w").alias("jwr"), F.col("t").alias("jt"))
    d = known.select(F.col("word").alias("dw"), F.col("right").alias("dr"), F.col("weight").alias("dn"), F.col("w").alias("dwr"), F.col("t").alias("dt"))
    both = broken.join(j, F.lower("joined") == F.col("jw"), "left").join(d, F.lower("dashed") == F.col("dw"), "left")
    dash = F.coalesce("dn", F.lit(0)) > F.coalesce("jn", F.lit(0))
    both = both.select(
        "image_id", "line_no", "at", F.when(dash, F.col("dashed")).otherwise(F.col("joined")).alias("token"), F.when(dash, F.col("dr")).otherwise(F.col("jr")).alias("right"),
        F.when(dash, F.col("dwr")).otherwise(F.col("jwr")).alias("wrong"), F.when(dash, F.col("dt")).otherwise(F.col("jt")).alias("true"),
    )
    hyphen = both.select("image_id", "line_no", F.lit("hyphen").alias("kind"), "at", F.when(F.col("right").isNull(), F.col("token")).otherwise(_keep_case(F.col("token"), F.col("right"), F.col("wrong"), F.col("true"))).alias("repaired"))

    # Misread words; the tail of a broken word stands first in a line that follows a break.
    read = tokens.join(sized, F.lower("token") == F.col("word"))
    tails = broken.select("image_id", F.col("b").alias("tail")).distinct().groupBy("image_id").agg(F.collect_set("tail").alias("tails"))  # the broken words of one page
    read = read.join(tails, "image_id", "left").where((F.col("at") > 0) | F.col("tails").isNull() | ~F.array_contains("tails", F.col("token")))
    misread = read.select("image_id", "line_no", F.lit("misread").alias("kind"), "at", _keep_case(F.col("token"), F.col("right"), F.col("wrong"), F.col("true")).alias("repaired"))
    chars = characters_on_pages(marked.select("image_id", "text", "out")).select("image_id", "line_no", F.lit("character").alias("kind"), "at", F.col("right").alias("repaired"))
    edge = out.select("image_id", "line_no", F.lit("furniture").alias("kind"), F.lit(None).cast("int").alias("at"), F.lit("").alias("repaired"))
    return edge.unionByName(hyphen).unionByName(misread).unionByName(chars), marked


def repairs(images: DataFrame) -> DataFrame:
    """Every repair: image_id, line_no, kind (furniture, hyphen, misread), repaired.

    ``images``: image_id, media_id, item_index, ocr_text.  Null or blank texts
    give nothing; rows that repeat an image count once; a null media is a work
    of its own, a null index stands before the first page.
    """
    found, _ = located_repairs(images)
    kind = F.when(F.col("kind") == "character", "misread").otherwise(F.col("kind"))
    return found.select("image_id", "line_no", kind.alias("kind"), "repaired").distinct()


# --- continuous text -----------------------------------------------------------

_LINE_SCHEMA = "media_id string, page long, line_no int, line string, opens boolean, closed boolean, title boolean, tight boolean"


def _repaired(batches):
    """The repaired lines of each page; ``opens`` where a blank line or a title stands before, or the line is a title."""
    for batch in batches:
        rows = []
        names = ("media_id", "page", "text", "out", "fixes", "taken")
        for media, page, text, out, fixes, taken in zip(*(batch.column(c).to_pylist() for c in names)):
            raw = text.split("\n")
            lines = _text_lines(text, out)
            width = max((len(line) for _, line in lines), default=0)
            by_line: dict[int, list] = {}
            for fix in fixes or ():
                by_line.setdefault(fix["line_no"], []).append(fix)
            drop, before, was_title = bool(taken), None, False
            bare = lambda a, b: any(not raw[j].strip() for j in range(a, b - 1))  # noqa: E731  (a blank line between two lines)
            for k, (no, line) in enumerate(lines):
                # A title stands alone.
                alone = (k == 0 or bare(lines[k - 1][0], no)) and (k + 1 == len(lines) or bare(no, lines[k + 1][0]))
                tight, title = drop, alone and looks_like_title(line, width)
                signs = list(line)
                for fix in by_line.get(no, ()):
                    if fix["kind"] == "character":
                        signs[fix["at"]] = fix["repaired"]
                words = _WORD.findall("".join(signs))
                hyphen = False
                for fix in by_line.get(no, ()):
                    if fix["kind"] in ("misread", "hyphen"):
                        w = 2 * fix["at"]
                        body = strip_word(words[w])
                        words[w] = words[w].replace(body.rstrip(HYPHENS) if fix["kind"] == "hyphen" else body, fix["repaired"], 1)
                        if fix["kind"] == "hyphen":
                            words[w], hyphen = words[w].rstrip(HYPHENS), True
                if drop and not line.isdigit():
                    # The rest of a broken word stands in the line before; signs behind it follow it without a blank.
                    signs_left = _AFTER_WORD.search(words[0])[0]
                    words = ([GLUED + signs_left] if signs_left else []) + words[1:]
                    drop = False
                fixed = "".join(words).strip()
                blank = before is not None and bare(before, no)
                rows.append((media, page, no, fixed, blank or title or was_title, bool(_SAID.search(fixed)), title, tight))
                before, was_title, drop = no, title, hyphen or (drop and line.isdigit())
        yield from _records(rows, _LINE_SCHEMA)


_WORD = re.compile(r"\S+|\s+")
#: Closing signs, with quotes and brackets behind them.
_SAID = re.compile(r"[.?!。？！…:：;；][\"'”’」』）)\]]*$")
#: Chinese signs; a line's end beside one stands for no blank.
_WIDE = r"\x{3000}-\x{303F}\x{3400}-\x{9FFF}\x{FF00}-\x{FFEF}"
#: Stands before a line's first sign that belongs to the word before.
GLUED = "\x01"
_AFTER_WORD = re.compile(rf"{_PUNCT}$|$")


def paragraphs(images: DataFrame) -> DataFrame:
    """The continuous text of each work: media_id, paragraph_no (from 1), first_page, text.

    Furniture is left out, broken words are whole and misread ones right.  A
    blank line between two lines of text, or a title, parts paragraphs; over
    the edge of a page a paragraph goes on unless its line ends with a closing
    sign or a title follows.  Lines are joined by a blank, Chinese ones, and
    numbers beside Chinese signs, without.  Inputs as in ``repairs``; images without media are the work
    with the empty name.
    """
    found, marked = located_repairs(images)
    fixes = found.where("kind <> 'furniture'").groupBy("image_id").agg(F.collect_set(F.struct("line_no", "kind", "at", "repaired")).alias("fixes"))  # the repairs of one page
    held = marked.join(fixes, "image_id", "left")
    # A page whose last word goes on takes the first word of the next page with text.
    ends = marked.select("media_id", "page", "image_id", F.expr("array_max(filter(sequence(1, size(split(text, '\n'))), k -> btrim(split(text, '\n')[k - 1]) <> '' and not coalesce(array_contains(out, k), false) and not btrim(split(text, '\n')[k - 1]) rlike '^[0-9]+$'))").alias("last_line")).where("last_line is not null")
    open_ = ends.join(found.where("kind = 'hyphen'").select("image_id", F.col("line_no").alias("last_line"), F.lit(True).alias("goes_on")), ["image_id", "last_line"], "left")
    open_ = open_.groupBy("media_id", "page").agg(F.coalesce(F.max("goes_on"), F.lit(False)).alias("goes_on"))
    taken = over_pages(open_, F.lag, "goes_on", F.max_by("goes_on", "page")).select("media_id", "page", F.coalesce("found", F.lit(False)).alias("taken"))
    pages = held.join(taken, ["media_id", "page"], "left").select("media_id", "page", "text", "out", "fixes", "taken")
    lines = cut(pages.mapInArrow(_repaired, _LINE_SCHEMA).where("line <> ''"), "repaired")
    # Whether a page goes on where the one before ended, and how many paragraphs begin on it.
    edges = lines.groupBy("media_id", "page").agg(
        F.min_by("title", "line_no").alias("title"), F.min_by("tight", "line_no").alias("tight"), F.min("line_no").alias("first_line"), F.max_by(F.struct("closed", "title"), "line_no").alias("end"),
        F.count(F.when(F.col("opens"), 1)).alias("inside"), F.min_by("opens", "line_no").alias("first_opens"),
    )
    before = over_pages(edges, F.lag, "end", F.max_by("end", "page"))
    edges = edges.join(before, ["media_id", "page"])
    starts = F.col("found").isNull() | (~F.col("tight") & (F.col("title") | F.col("found.closed") | F.col("found.title")))
    edges = edges.select("media_id", "page", "first_line", starts.alias("starts"), (F.col("inside") - F.col("first_opens").cast("int") + starts.cast("int")).alias("n"))
    blocks = edges.withColumn("block", F.floor(F.col("page") / PAGE_BLOCK))
    sums = blocks.groupBy("media_id", "block").agg(F.sum("n").alias("n"))
    sums = sums.select("media_id", "block", F.coalesce(F.sum("n").over(W.partitionBy("media_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("media_id", "block").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("inside", inside).join(sums, ["media_id", "block"]).select("media_id", "page", "first_line", "starts", (F.col("inside") + F.col("earlier")).alias("earlier"))
    rows = lines.join(placed, ["media_id", "page"]).withColumn("new", F.when(F.col("line_no") == F.col("first_line"), F.col("starts")).otherwise(F.col("opens")))
    number = F.col("earlier") + F.sum(F.col("new").cast("int")).over(W.partitionBy("media_id", "page").orderBy("line_no"))
    rows = rows.withColumn("paragraph_no", number)
    held = rows.groupBy("media_id", "paragraph_no").agg(F.min("page").alias("first_page"), F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))).alias("c"))  # the lines of one paragraph
    text = F.replace(F.array_join(F.transform("c", lambda x: x["line"]), "\n"), F.lit("\n" + GLUED), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, rf"(?<=[{_WIDE}])\n(?=[{_WIDE}0-9])|(?<=[0-9])\n(?=[{_WIDE}])", ""), r"\n", " ")
    return held.select("media_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), "first_page", text.alias("text"))
