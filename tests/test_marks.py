"""Mathematics, numbers, escapes, source lists, and facts of HTML beside those of Markdown."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import marks
from tallyloom.operators import compare, reports
from tallyloom.plans import reports as report_plans
from tallyloom.sources import facts


@pytest.mark.parametrize(
    "text,want",
    [
        ("$5$", [("inline", "5")]), ("$x$$y$", [("inline", "x"), ("inline", "y")]), ("$100", []), ("costs $1,000.50, no more", []), ("$x", [("unclosed", "$")]), ("$5 + x", [("unclosed", "$")]),
        ("$$a\nb$$ and $c$", [("block", "a\nb"), ("inline", "c")]), ("\\[x = 1\\]", [("block", "x = 1")]), ("$$ never", [("unclosed", "$$")]), ("`$a$` and \\$b\\$", []), ("```\n$a$\n```\n$b$", [("inline", "b")]),
        ("$ a $", [("unclosed", "$"), ("unclosed", "$")]), ("$a\nb$", [("unclosed", "$"), ("unclosed", "$")]), (None, []), ("", []),
    ],
)
def test_math(text, want):
    assert [(kind, value) for kind, _, _, value in marks.scan_math(text)] == want


def test_numbers():
    got = {n["raw"]: (n["unit"], n["context"]) for n in marks.numbers("5ms 1,000 20% 3DES v2 1.2.3 7 min `8` $9$ https://x.example/10 a11")}
    assert got == {"5ms": ("ms", "body"), "1,000": (None, "body"), "20%": ("%", "body"), "3DES": (None, "identifier"), "v2": (None, "identifier"), "1.2.3": (None, "identifier"), "7 min": ("min", "body"), "8": (None, "code"), "9": (None, "math"), "10": (None, "url"), "a11": (None, "identifier")}
    twice = marks.numbers("see <b>4</b> of\n4 and see 4 of")
    assert [(n["before"], n["after"], n["occurrence"], n["line"]) for n in twice][0] == ("see ", " of 4 ", 1, 1)
    assert marks.numbers("4 x 4 x 4 x 4 x 4")[2]["occurrence"] >= 1 and marks.numbers(None) == []


def test_escapes():
    assert marks.resolved_escapes(r"a \* b \\ c `\*` $\*$ \q") == r"a * b \ c `\*` $\*$ \q"
    assert marks.resolved_escapes(None) is None and marks.resolved_escapes("plain") == "plain"


def test_source_lists():
    assert marks.split_sources(" a.md:1 [x; y]; b.md ;; c ]; d") == ["a.md:1 [x; y]", "b.md", "c ]", "d"]
    assert marks.joined_sources(["b", "a [long]", "a", "a [x]"]) == "a [long]; b"
    assert marks.split_sources(None) == [] and marks.joined_sources([]) == ""


def test_subsequence():
    assert marks.subsequence_end("abc", "xaybzc!", 0, 7) == 6
    assert marks.subsequence_end("abc", "xaybz", 0, 5) is None and marks.subsequence_end("a", "b" * 100 + "a", 0, 101) is None


PAGE = """<html><head><title>no</title></head><body><h1>One &amp; two</h1><p>Text <code>x = 1</code> and $a$ <a href="b.html">b</a><a href="#fn-1">1</a></p>
<ul><li>first<ul><li>inner</li></ul></li></ul><div class="admonition note"><p>Mind this</p></div><pre><code>a
b</code></pre><dl><dt>word</dt><dd>meaning</dd></dl><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table>
<img src="d.png" class="only-dark"><img src="l.png"><ol><li id="fn-1">the note</li></ol><span class="math">x^2</span></body></html>"""


def test_page_facts():
    got = facts.page_facts(PAGE)
    by = lambda s: [(level, value) for stream, level, value in got if stream == s]
    assert by("heading") == [(1, "One & two")] and by("inline-code") == [(0, "x = 1")] and by("code") == [(0, "a\nb")]
    assert by("item") == [(0, "first"), (1, "inner")] or by("item") == [(0, "firstinner"), (1, "inner")]
    assert by("cell") == [(0, "k"), (0, "v"), (1, "1"), (1, "2")] and by("term") == [(0, "word")] and by("box") == [(0, "note")]
    assert by("image") == [(0, "l.png")] and by("link") == [(0, "b.html")] and by("note-ref") == [(0, "1")] and by("note-def") == [(0, "1")]
    assert by("math") == [(1, "a"), (1, "x^2")]
    assert facts.page_facts(None) == facts.page_facts("") == [] and facts.page_facts("<p>open <b>never")[:1] == []


def test_pages_and_texts_tell_the_same(spark):
    text = "# One\n\nSome text.\n\n- item\n- two\n\n| a | b |\n|---|---|\n| 1 | x \\| y |\n\n```\ncode <b>\n```\n"
    df = spark.createDataFrame([(1, text, facts.html_of(text)), (2, None, None), (3, "", "")], "doc_id long, text string, page string")
    left, right = facts.scanned(df, "doc_id", "page", facts.page_facts), facts.scanned(df, "doc_id", "text", facts.text_facts)
    # A fence holds no inline code; both sides list the same streams in the same order.
    diff = lambda a, b: compare.stream_diff(a, b, ["doc_id", "stream"], ["ord"], "value")
    assert left.count() == right.count() == 8 and diff(left, right).count() == 0
    changed = right.withColumn("value", F.when(F.col("value") == "two", "three").otherwise(F.col("value")))
    assert [(r.stream, r.pos, r.left_value, r.right_value) for r in diff(left, changed).collect()] == [("item", 2, "two", "three")]


def test_titles(spark):
    rows = [("One  two", "One two", True), ("One", "One （一）", True), ("One", "One（）", False), ("One", "One more", False), ("", "（一）", False), (None, "One", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(reports.title_matches(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_reports_at_their_edges(spark):
    df = spark.createDataFrame([(1, "a", 5, "t", 1), (1, "a", None, "t", 2), (2, "b", 5, "t", 3), (2, "b", 6, "u", 4), (3, None, None, None, 5)], "k int, issue string, v int, place string, row_id int")
    got = {r.k: (r.v, r.v_state, r.place, r.sources) for r in reports.united(df.drop("issue"), ["k"], ["v"], ["place"], "row_id").collect()}
    assert got == {1: (5, "known", "t", [1, 2]), 2: (None, "conflict", None, [3, 4]), 3: (None, "unknown", None, [5])}
    empty = df.limit(0)
    assert reports.united(empty.drop("issue"), ["k"], ["v"], ["place"], "row_id").count() == 0 and reports.envelope(empty, ["k"], "v", "row_id").count() == 0
    assert reports.bounded(df, ["k"], ["row_id"], 1).count() == 3
    scope = reports.carried_scope(spark.createDataFrame([("s", 1, "x"), ("s", 2, None), ("s", 3, ""), ("s", 4, None), ("s", 5, "y")], "s string, n int, c string"), ["s"], ["n"], ["c"])
    assert [r.now_c for r in scope.orderBy("n").collect()] == ["x", "x", None, None, "y"]
    keys = spark.createDataFrame([(1, '{"a": {"Password": 1, "b": "prompt"}}'), (2, "broken \"text\": 1"), (3, None)], "row_id int, j string")
    assert [(r.row_id, r.name) for r in reports.private_keys(keys, "row_id", "j").collect()] == [(1, "password")]
    files = spark.createDataFrame([("a/x.png",), ("b/x.png",), ("b/y.png",)], "file string")
    entries = spark.createDataFrame([("1", "a/x.png"), ("2", "y.png"), ("3", "x.png"), ("4", "z.png"), ("5", None)], "entry string, path string")
    assert {r.entry: (r.how, r.file) for r in reports.attributed(entries, files).collect()} == {"1": ("path", "a/x.png"), "2": ("name", "b/y.png"), "3": ("ambiguous", None), "4": ("none", None), "5": ("none", None)}
    assert len(report_plans.QUERIES) == len(report_plans.ORACLES)
