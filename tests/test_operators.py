"""Cells, lifecycles, texts, comparisons, graphs, sources, sinks and streams."""

import json
import os
import random
import sqlite3
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import markdown
from tallyloom.operators import cells, compare, glossary, graphs, media, metering, pages, textfacts
from tallyloom.sources import html, logs, sinks, stores, subtitles
from tallyloom.streaming import streams

MAP = {"input": "in", "output": "out", "cache_read": "cache"}


def usage(spark, rows):
    return cells.usage_cells(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "row_id int, j string"), "j", MAP, "total")


# --- cells ---------------------------------------------------------------------------


def test_cells(spark):
    rows = ['{"in":100,"out":10,"cache":90}', '{"in":10,"out":1,"cache":11}', '{"in":true,"out":1.5,"cache":"3"}', '{"in":-1,"out":null}', '{"in":1,"out":2,"total":4}', "{broken", None, "[]", '{"in":0,"out":0,"cache":0}', '{"in":123456789012345678901234567890}']
    got = {r.row_id: r for r in usage(spark, rows).collect()}
    states = {i: (r.input.state, r.output.state, r.cache_read.state, r.non_cache_read.value, r.total.value, r.total.state) for i, r in got.items()}
    assert states[0] == ("reported", "reported", "reported", 10, 110, "derived")
    assert states[1] == ("reported", "reported", "conflict", None, 11, "derived")
    assert states[2] == ("conflict", "conflict", "conflict", None, None, "unknown")
    assert states[3] == ("conflict", "unknown", "unknown", None, None, "unknown")
    assert states[4] == ("reported", "reported", "unknown", None, None, "conflict")
    assert {states[k] for k in (5, 6, 7)} == {("unknown", "unknown", "unknown", None, None, "unknown")}
    assert states[8] == ("reported", "reported", "reported", 0, 0, "derived")
    assert states[9][0] == "conflict"


def test_aggregate_keeps_unknown_apart_from_zero(spark):
    """The weighted ratio is over rows where both parts are known."""
    rows = ['{"in":100,"out":10,"cache":90}', '{"in":300,"out":10,"cache":0}']
    one = cells.aggregate(usage(spark, rows).withColumn("g", F.lit(1)), ["g"]).first()
    assert (one.input, one.cache_read, one.non_cache_read, one.output, one.total, one.hit_rate, one.calls, one.hit_rate_state) == (400, 90, 310, 20, 420, 0.225, 2, "known")
    part = cells.aggregate(usage(spark, [rows[0], '{"in":300,"out":10}']).withColumn("g", F.lit(1)), ["g"]).first()
    assert (part.hit_rate, part.hit_rate_state, part.cache_read_state, part.cache_read_reasons) == (0.9, "partial", "partial", "not reported")
    zero = cells.aggregate(usage(spark, ['{"in":0,"out":0,"cache":0}']).withColumn("g", F.lit(1)), ["g"]).first()
    assert (zero.input, zero.input_state, zero.hit_rate, zero.hit_rate_state) == (0, "known", None, "not_applicable")
    none = cells.aggregate(usage(spark, [None]).withColumn("g", F.lit(1)), ["g"]).first()
    assert (none.input, none.input_state, none.hit_rate_state) == (None, "unknown", "unknown")
    assert cells.aggregate(usage(spark, [None]).limit(0).withColumn("g", F.lit(1)), ["g"]).count() == 0


def test_reconcile(spark):
    rows = usage(spark, ['{"in":100,"out":10}', '{"in":120,"out":10}', '{"in":5,"out":1}']).withColumn("k", F.when(F.col("row_id") < 2, "a").otherwise("b"))
    got = {r.k: r for r in cells.reconcile(rows, ["k"], ["input", "output"], "row_id").collect()}
    assert (got["a"].input.state, got["a"].input.value, got["a"].output.value, got["a"].copies) == ("conflict", None, 10, 2)
    assert got["b"].input.value == 5


def test_views_agree_with_plain_aggregates(spark):
    random.seed(1)
    rows = [json.dumps({"in": random.randrange(50), "out": random.randrange(5), **({"cache": random.randrange(60)} if random.random() < 0.7 else {})}) for _ in range(200)]
    df = usage(spark, rows).withColumn("a", F.col("row_id") % 3).withColumn("b", F.when(F.col("row_id") % 5 > 0, F.col("row_id") % 5))
    views = cells.dimension_views(df, {"a": ["a"], "both": ["a", "b"]})
    plain = cells.aggregate(df, ["a"]).select(F.col("a").cast("string").alias("identity"), *[c for c in views.columns if c not in ("dimension", "identity")])
    assert sorted(map(str, views.where("dimension = 'a'").drop("dimension").collect())) == sorted(map(str, plain.collect()))
    assert views.where("dimension = 'both'").agg(F.sum("records")).first()[0] == 200


# --- lifecycles -------------------------------------------------------------------------


def test_counters(spark):
    rows = [("a", 1, 0), ("a", 2, 100), ("a", 3, 1000), ("b", 1, 500), ("b", 2, 100), ("b", 3, 150), ("c", 1, None)]
    df = spark.createDataFrame(rows, "k string, n int, v long")
    got = {(r.k, r.n): (r.delta_v, r.issue) for r in metering.counter_deltas(df, ["k"], ["n"], ["v"]).collect()}
    assert got == {("a", 1): (0, None), ("a", 2): (100, None), ("a", 3): (900, None), ("b", 1): (None, "no baseline"), ("b", 2): (None, "reset"), ("b", 3): (50, None), ("c", 1): (None, None)}


def test_forward_fill_resets_to_null(spark):
    df = spark.createDataFrame([("f", 1, "ctx", "m1"), ("f", 2, "x", None), ("f", 3, "ctx", None), ("f", 4, "x", None)], "f string, n int, t string, m string")
    kept = [r.ctx_m for r in metering.forward_fill(df, ["f"], ["n"], ["m"]).orderBy("n").collect()]
    reset = [r.ctx_m for r in metering.forward_fill(df, ["f"], ["n"], ["m"], F.col("t") == "ctx").orderBy("n").collect()]
    assert kept == ["m1"] * 4 and reset == ["m1", "m1", None, None]


@pytest.mark.parametrize("seed", [1, 2])
def test_spread_windows_equal_plain_ones(spark, seed):
    random.seed(seed)
    rows = [(random.choice(["hot"] * 8 + ["a", "b", None]), n, random.choice([None, "x", "y", "z"]), random.choice(["ctx", "o", "o"]), random.choice([None, 0, n, n // 2])) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, n int, m string, t string, v long")
    same = lambda f: sorted(map(str, f(False).select("*").collect())) == sorted(map(str, f(True).select(f(False).columns).collect()))
    assert same(lambda s: metering.forward_fill(df, ["k"], ["n"], ["m", "v"], spread=s))
    assert same(lambda s: metering.forward_fill(df, ["k"], ["n"], ["m", "v"], F.col("t") == "ctx", spread=s))
    assert same(lambda s: metering.counter_deltas(df, ["k"], ["n"], ["v"], spread=s))
    assert same(lambda s: metering.epochs(df, ["k"], ["n"], F.col("t") == "ctx", spread=s))


def test_days_with_clock_changes(spark):
    at = lambda s: int(__import__("datetime").datetime.fromisoformat(s).timestamp() * 1000)
    rows = [(at("2026-03-08T04:59:59+00:00"),), (at("2026-03-08T05:00:00+00:00"),), (at("2026-11-02T04:59:59+00:00"),), (None,)]
    df = spark.createDataFrame(rows, "t long")
    day = metering.local_date(F.col("t"), "America/New_York")
    got = [(str(r.d) if r.d else None, r.s) for r in df.select(day.alias("d"), metering.day_start_ms(day, "America/New_York").alias("s")).collect()]
    assert [g[0] for g in got] == ["2026-03-07", "2026-03-08", "2026-11-01", None]
    assert got[1][1] == at("2026-03-08T05:00:00+00:00") and got[2][1] == at("2026-11-01T04:00:00+00:00")


# --- texts --------------------------------------------------------------------------------


def test_markdown_facts():
    text = "# One ##\ntext `a` and ``b ` c``\nmore\n\n~~~py\n# no\n```\n~~~\n| a | b |\n|---|---|\n| 1 \\| 2 | |\n- item [l](u) ![i](p.png)\n[^1]: note\nsee [^1] $x$ costs $100\n$$y$$\n```\nopen"
    got = markdown.facts(text)
    assert [(k, n, v) for k, n, _, v in got if k in ("heading", "fence", "table", "item", "paragraph", "open_fence")] == [
        ("heading", 1, "One"), ("paragraph", 2, "text `a` and ``b ` c``"), ("fence", 5, "# no\n```"), ("table", 9, "| a | b |"), ("table", 11, "| 1 \\| 2 | |"), ("item", 12, "item [l](u) ![i](p.png)"),
        ("paragraph", 14, "see [^1] $x$ costs $100"), ("open_fence", 16, "open"),
    ]
    assert [v for k, _, _, v in got if k == "code"] == ["a", "b ` c"] and [v for k, _, _, v in got if k in ("link", "image")] == ["p.png", "u"]
    assert [v for k, _, _, v in got if k == "math"] == ["x", "y"] and [v for k, _, _, v in got if k in ("note_def", "note_ref")] == ["1", "1"]
    assert markdown.facts(None) == markdown.facts("") == []
    assert markdown.cells("| 1 \\| 2 | |") == ["1 | 2", ""] and markdown.slug("A b, C!") == "a-b-c"


def test_packed_lines(spark):
    random.seed(2)
    texts = ["\n".join("x" * random.choice([0, 3, 30, 700]) for _ in range(random.randrange(1, 40))) for _ in range(20)] + ["", "one"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "d int, t string")
    got = {}
    for r in textfacts.packed_lines(df, "d", "t", 100).collect():
        got.setdefault(r.doc_id, []).append((r.chunk, r.first_line, r.last_line, r.characters))
    assert 99 not in got
    for d, text in enumerate(texts):
        lines, want = text.split("\n"), []
        for no, line in enumerate(lines, 1):
            if want and want[-1][2] + 1 + len(line) <= 100:
                want[-1] = [want[-1][0], no, want[-1][2] + 1 + len(line)]
            else:
                want.append([no, no, len(line)])
        assert sorted(got[d]) == [(k, *w) for k, w in enumerate(want, 1)]


def test_numbers(spark):
    df = spark.createDataFrame([(1, "5ms, 1,000 and 20% of 3DES v2 1.2.3.")], "d int, t string")
    got = [(r.token, r.kind, r.amount, r.unit) for r in textfacts.number_tokens(df, "d", "t").collect()]
    assert got == [("5ms", "quantity", "5", "ms"), ("1,000", "number", "1,000", None), ("20%", "quantity", "20", "%"), ("3DES", "identifier", None, None), ("v2", "identifier", None, None), ("1.2.3", "number", "1.2.3", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_comparisons(spark, seed):
    random.seed(seed)
    a = [random.choice("xyz") for _ in range(30)]
    b = [c if random.random() < 0.8 else random.choice(["w", None]) for c in a[: random.randrange(20, 31)]] + ["new"]
    left = spark.createDataFrame([(1, i, v) for i, v in enumerate(a)], "k int, o int, v string")
    right = spark.createDataFrame([(1, i, v) for i, v in enumerate(b)], "k int, o int, v string")
    got = {r.pos: r.kind for r in compare.stream_diff(left, right, ["k"], ["o"], "v").collect()}
    want = {i + 1: "added" if i >= len(a) else "missing" if i >= len(b) else "changed" for i in range(max(len(a), len(b))) if i >= len(a) or i >= len(b) or a[i] != b[i]}
    assert got == want
    multi = {r.v: (r.missing, r.added) for r in compare.multiset_diff(left, right, ["v"]).collect()}
    ca, cb = Counter(a), Counter(b)
    assert multi == {v: (max(ca[v] - cb[v], 0), max(cb[v] - ca[v], 0)) for v in set(a) | set(b) if ca[v] != cb[v]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    random.seed(seed)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    nodes = list(range(165))
    root = list(range(165))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.grp for r in graphs.components(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(n,) for n in nodes], "node int")).collect()}
    assert got == {n: find(n) for n in nodes}


def test_html():
    page = "<body><h2>T</h2><p>a<b>b</b> c<br>d<p>e</p><ul><li>x<ul><li>y</ul></ul><pre>\n 1\n</pre><script>no()</script>tail"
    assert html.blocks(page) == [
        ("heading", 2, "T", ""), ("paragraph", 0, "ab c d", ""), ("paragraph", 0, "e", ""), ("item", 1, "x", ""), ("item", 2, "y", ""), ("code_block", 0, " 1", ""), ("text", 0, "tail", ""),
    ]
    table = "<table><tr><th>k<td>v<tr><td><td><a href='x'>l</a></table>after<img src=i alt=p>"
    assert html.blocks(table) == [
        ("header_cell", 0, "k", ""), ("cell", 0, "v", ""), ("cell", 0, "", ""), ("cell", 0, "l", ""), ("link", 0, "", "x"), ("text", 0, "after", ""), ("image", 0, "p", "i"),
    ]
    assert html.blocks(None) == [] and html.blocks("") == []


def test_glossary_terms_fold_width_and_case(spark):
    df = spark.createDataFrame([("ＣＵＤＡ",), ("`kernel`",), (" Heat   Sink ",), (None,), ("Straße",)], "t string")
    assert [r.k for r in df.select(glossary.term_key(F.col("t")).alias("k")).collect()] == ["cuda", "kernel", "heat sink", None, "strasse"]


def test_media_functions(spark):
    df = spark.createDataFrame([("https://a.site.example/x/abc?d=1#e", "https://evilsite.example/", "名字名字名字名字", "ab cd")], "u string, e string, t string, s string")
    got = df.select(
        media.host_in(F.col("u"), ["site.example"]), media.host_in(F.col("e"), ["site.example"]), media.bare_url(F.col("u")), media.content_id(F.col("u")), media.single_title(F.col("t")), media.single_title(F.col("s")), media.clock(F.lit(3725.9))
    ).first()
    assert tuple(got) == ("site.example", None, "https://a.site.example/x/abc", "abc", "名字名字", "ab cd", "01:02:05")


def test_subtitles(spark):
    text = "WEBVTT\n\nNOTE x\n\n1\n00:01.500 --> 00:02,000 align:left\nline one\nline two\n\n2\n01:00:00.000 --> 01:00:01.000\n\n\n3\n00:03 --> 00:04\nlast"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "d int, t string")
    got = [(r.d, r.cue_no, r.cue_start, r.cue_end, r.cue_text) for r in subtitles.parse_subtitles(df, "t", ["d"]).collect()]
    assert got == [(1, 1, 1.5, 2.0, "line one line two"), (1, 2, 3.0, 4.0, "last")]


def test_reading_order_and_grid(spark):
    cells_ = spark.createDataFrame([("t", 1, 0, 0, 2, 2), ("t", 2, 1, 1, 1, 1), ("t", 3, 2, 2, 1, 1)], "table string, cell int, row int, col int, rowspan int, colspan int")
    grid = pages.table_grid(cells_)
    assert grid.where("problem = 'overlap'").count() == 2 and grid.count() == 6
    assert {(r.row, r.col) for r in pages.grid_holes(grid).collect()} == {(0, 2), (1, 2), (2, 0), (2, 1)}


# --- sources and sinks ------------------------------------------------------------------------

LOG = [
    {"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": "s1"}},
    {"type": "turn_context", "payload": {"turn_id": "t1", "model": "m1", "model_provider_id": "p"}},
    {"type": "event_msg", "timestamp": "2026-01-01T00:00:01Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 0, "output_tokens": 0, "total_tokens": 0, "cached_input_tokens": 0}}}},
    {"type": "token_usage_record", "timestamp": "2026-01-01T00:00:02Z", "payload": {"response_id": "r1", "turn_id": "t1", "usage": {"input_tokens": 100, "output_tokens": 10, "cached_input_tokens": 90, "total_tokens": 110}}},
    {"type": "event_msg", "timestamp": "2026-01-01T00:00:03Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 100, "output_tokens": 10, "total_tokens": 110, "cached_input_tokens": 90}}}},
    {"type": "turn_context", "payload": {"turn_id": "t2"}},
    {"type": "event_msg", "timestamp": "2026-01-01T00:00:04Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 400, "output_tokens": 30, "total_tokens": 430, "cached_input_tokens": 90}}}},
    {"type": "event_msg", "payload": {"type": "item_completed", "item": {"id": "c1", "status": "ok", "duration": {"secs": 1, "nanos": 5}}}},
    {"type": "event_msg", "payload": {"type": "item_completed", "item": {"id": "c2", "status": "ok", "duration": {"secs": -1, "nanos": 5}}}},
    {"type": "response_item", "timestamp": "2026-01-01T00:00:05Z", "payload": {"role": "user", "id": "u1"}},
]


def test_logs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    whole = "\n".join(json.dumps(x) for x in LOG)
    (tmp_path / "a.jsonl").write_text(whole + "\n\n{broken\n[1]\n" + json.dumps(LOG[3]) + "\n" + '{"type":')
    (tmp_path / "sub" / "b.jsonl").write_text(json.dumps({**LOG[3], "payload": {**LOG[3]["payload"], "usage": {**LOG[3]["payload"]["usage"], "input_tokens": 120}}}) + "\n")
    (tmp_path / "c.txt").write_text("{}\n")
    lines = logs.read_lines(spark, str(tmp_path))
    assert sorted((r.line_no, r.problem) for r in logs.read_issues(lines).collect()) == [(12, "corrupt"), (13, "no object"), (15, "unterminated")]
    log = logs.event_log(lines)
    direct, counters = logs.direct_records(log), logs.counter_records(log)
    assert sorted((r.turn, r.model, r.delta_input, r.issue) for r in counters.collect()) == sorted([("t1", "m1", 0, None), ("t1", "m1", 100, None), ("t2", None, 300, None)], key=str)
    rows = logs.preferred_records(direct, counters).collect()
    assert sorted((r.granularity, r.turn, r.input) for r in rows) == [("interval", "t2", 300), ("model_call", "t1", 100), ("model_call", "t1", 100), ("model_call", "t1", 120)]
    call = logs.unique_calls(direct).first()
    assert (call.copies, call.input, call.output, call.conflict) == (3, None, 10, cells.SOURCES_DIFFER)
    assert {r.id: (r.duration_ns, r.problem) for r in logs.tool_events(log).collect()} == {"c1": (1_000_000_005, None), "c2": (None, "duration")}
    assert [(r.session, r.id) for r in logs.requests(log).collect()] == [("s1", "u1")]


def test_request_dialect(spark, tmp_path):
    row = {"sessionId": "s", "turnId": "t", "requestId": "r1", "attempt": 1, "model": {"providerId": "p", "modelId": "m"}, "response": {"usage": {"inputTokens": 100, "outputTokens": 5}}}
    redacted = {**row, "requestId": "r3", "response": {"usage": {"redacted": True}}}
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(r) for r in (row, row, {**row, "attempt": 2}, redacted)) + "\n")
    got = logs.request_dialect(logs.read_lines(spark, str(tmp_path))).collect()
    assert sorted((r.request, r.attempt, r.input) for r in got) == [("r1", 1, 100), ("r1", 2, 100), ("r3", 1, None)]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "db.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE session (id TEXT, n INT)")
        db.executemany("INSERT INTO session VALUES (?, ?)", [(f"s{i}", i) for i in range(1000)])
        db.execute("CREATE TABLE none (id TEXT)")
    got = stores.read_sqlite(spark, path, "session", "id string, n long, parent_id string")
    assert got.agg(F.count("*"), F.sum("n"), F.count("parent_id")).first()[:] == (1000, 499_500, 0)
    assert stores.read_sqlite(spark, path, "none", "id string").count() == 0
    with pytest.raises(ValueError):
        stores.read_sqlite(spark, path, 'x"; drop', "id string")


def test_zip_and_json(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.json", '{"k": 1}')
    (tmp_path / "b.zip").write_bytes(b"no zip")
    got = {(os.path.basename(r.path), r.member): (r.text, r.problem) for r in stores.read_zip_members(spark, str(tmp_path), ["one.json", "two.json"]).collect()}
    assert got == {("a.zip", "one.json"): ('{"k": 1}', None), ("a.zip", "two.json"): (None, "missing"), ("b.zip", "one.json"): (None, "corrupt"), ("b.zip", "two.json"): (None, "corrupt")}
    page = spark.createDataFrame([("<script>window.STATE = {\"a\": undefined, \"b\": 2};</script>",), ("<p>",)], "p string")
    assert [r[0] for r in page.select(stores.embedded_json(F.col("p"), "window.STATE")).collect()] == ['{"a": null, "b": 2}', None]
    assert stores.strict_object('{"a": 1}') == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', "[1]", "x"):
        with pytest.raises(ValueError):
            stores.strict_object(bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc", [1])], "n int, t string, l array<int>")
    sinks.export(df, str(tmp_path / "out"), "csv", [str(tmp_path / "in")])
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "out")).first().l == "[1]"
    for target in (tmp_path / "in", tmp_path / "in" / "x"):
        with pytest.raises(ValueError):
            sinks.export(df, str(target), "json", [str(tmp_path / "in")])
    with pytest.raises(Exception):
        sinks.export(df, str(tmp_path / "out"), "json")
    assert sinks.markdown_rows(df, ["n", "t"]).first().row == "| 1 | a\\|b c |"
    assert [sinks.backoff(k) for k in range(5)] == [1, 2, 4, 4, 4]
    sent = sinks.send_rows(spark.range(250).coalesce(1), lambda rows: 503 if rows[0]["id"] == 100 else 200, 100, 3, lambda s: None).collect()
    assert [tuple(r) for r in sent] == [(100, 1, 200), (100, 3, 503), (50, 1, 200)]


# --- streams ----------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    schema = "k string, at timestamp, v long"
    rows = [("a", f"2026-01-01 00:{m:02d}:00", m) for m in (0, 1, 1, 20, 59)] + [("b", "2026-01-01 00:02:00", 5)]
    spark.createDataFrame(rows, "k string, at string, v long").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert len(run(streams.once(source(), ["k", "v"], "at", "2 hours"), "t_once")) == 5
    sums = run(streams.windowed_sums(source(), "at", "0 seconds", "10 minutes", ["k"], "v"), "t_sums")
    assert sorted((r.k, r.n, r.total) for r in sums) == [("a", 1, 20), ("a", 3, 2), ("b", 1, 5)]
    active = run(streams.sessions(source(), "at", "0 seconds", "5 minutes", ["k"]), "t_sessions")
    assert sorted((r.k, r.n) for r in active) == [("a", 1), ("a", 3), ("b", 1)]
    deltas = run(streams.counter_deltas(source(), "k", "at", "v"), "t_deltas")
    assert sorted((r.delta for r in deltas if r.k == "a"), key=str) == [0, 0, 1, 19, 39]
    assert [r.delta for r in deltas if r.k == "b"] == [None]


def test_whole_texts():
    from tallyloom.operators import integrity

    text = "# a\n```\n# b\n```\n~~~~\n```\n~~~\n~~~~\n## c\n```\nopen"
    assert integrity.demoted(text) == "## a\n```\n# b\n```\n~~~~\n```\n~~~\n~~~~\n### c\n```\nopen" and integrity.demoted(None) is None
    bare, fences = integrity.with_placeholders(text)
    assert len(fences) == 2 and integrity.spliced(bare, fences) == text
    for broken in (bare.replace("FENCE:0", "FENCE:1"), bare + "\n[[FENCE:0]]", bare.replace("[[FENCE:1]]", "")):
        with pytest.raises(ValueError):
            integrity.spliced(broken, fences)
    assert integrity.with_placeholders(None) == ("", [])


def test_lines_of_files_that_are_read_in_splits(spark, tmp_path):
    """Numbers and the missing end are right however a file is cut."""
    from tallyloom.sources import logs

    (tmp_path / "big.jsonl").write_text("".join('{"n": %d}\n' % k if k % 7 else "\n" for k in range(1, 3001)) + '{"n": "end"}')
    (tmp_path / "small.jsonl").write_text('[1]\r\n{"a": 1}\r\n\n{broken\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        got = {(r.path.rsplit("/", 1)[1], r.line_no): (r.line, r.problem) for r in logs.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("big.jsonl", k): ('{"n": %d}' % k, None) for k in range(1, 3001) if k % 7} | {("big.jsonl", 3001): ('{"n": "end"}', "unterminated")}
    want |= {("small.jsonl", 1): ("[1]", "no object"), ("small.jsonl", 2): ('{"a": 1}', None), ("small.jsonl", 4): ("{broken", "corrupt")}
    assert got == want
    (tmp_path / "link.jsonl").symlink_to(tmp_path / "small.jsonl")
    paths = [str(tmp_path / n) for n in ("small.jsonl", "link.jsonl", "gone.jsonl")]
    assert sorted((r.path.rsplit("/", 1)[1], r.problem) for r in logs.captured(spark, paths).collect()) == [("gone.jsonl", "unreadable"), ("link.jsonl", None)]
