"""Metering of event logs from lines to records."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import logs, spans


def usage(i, o=0, c=0):
    return {"input_tokens": i, "output_tokens": o, "cached_input_tokens": c, "total_tokens": i + o}


def meta(s="s"):
    return {"type": "session_meta", "timestamp": "t0", "payload": {"id": s}}


def turn(t, model="m"):
    return {"type": "turn_context", "payload": {"turn_id": t, "model": model}}


def call(r, i, o=10, c=0, t=None):
    return {"type": "token_usage_record", "timestamp": f"at-{r}", "payload": {"response_id": r, "turn_id": t, "usage": usage(i, o, c)}}


def counter(i, o=0, last=None, at="c"):
    info = {"total_token_usage": usage(i, o)} | ({"last_token_usage": last} if last else {})
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": info}}


def reply(r):
    return {"type": "response_item", "payload": {"type": "message", "role": "assistant", "id": r}}


@pytest.fixture
def metered(spark, tmp_path):
    def run(*files):
        for k, lines in enumerate(files):
            (tmp_path / f"f{k}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
        log = logs.event_log(logs.read_lines(spark, str(tmp_path)))
        found = spans.spans(log)
        direct = logs.unique_calls(logs.direct_records(log))
        return log, found, spans.metered(direct, found)

    return run


def selected(spark, records, *turns):
    chosen = spark.createDataFrame([(t,) for t in turns], "turn string")
    return sorted((r.scope, r.input) for r in spans.in_turns(records, chosen).collect())


def test_calls_and_a_notice_of_the_same_use(metered):
    """A counter beside calls is another view of them, never one more call."""
    _, found, records = metered([meta(), turn("t1"), call("r1", 100, 10, 90), call("r2", 300), call("r1", 100, 10, 90), counter(400)])
    rows = records.collect()
    assert sum(r.input for r in rows) == 400 and sum(r.cache_read for r in rows) == 90 and sum(r.calls for r in rows) == 2
    assert [r.kind for r in found.collect()] == ["direct"]


def test_equal_keys_with_different_counts(metered):
    _, _, records = metered([meta(), turn("t"), call("r", 100), call("r", 120)])
    assert [(r.input, r.output) for r in records.collect()] == [(None, 10)]


def test_turns_are_a_set(spark, metered):
    _, _, records = metered([meta(), turn("t1"), call("a", 100), turn("t2"), call("b", 900), turn("t3"), call("c", 300)])
    assert selected(spark, records, "t1", "t3", "t1") == [("kept", 100), ("kept", 300), ("other", 900)]


def test_intervals_between_counters(spark, metered):
    _, _, records = metered([meta(), turn("t1"), counter(0), counter(100), turn("t2"), counter(1000), turn("t3"), counter(1300)])
    assert selected(spark, records, "t1", "t3") == [("kept", 100), ("kept", 300), ("other", 900)]
    assert all(r.calls is None for r in records.collect())


def test_an_interval_over_turns_that_are_not_all_selected(spark, metered):
    _, _, records = metered([meta(), turn("t1"), counter(0), counter(100), turn("t2"), turn("t3"), counter(1300)])
    got = selected(spark, records, "t1", "t3")
    assert ("kept", 100) in got and ("crossing", 1200) in got


def test_a_counter_that_falls(metered):
    _, found, records = metered([meta(), turn("t"), counter(500), counter(100)])
    assert records.count() == 0 and sorted(r.issue for r in found.collect()) == ["no baseline", "reset"]


def test_the_one_reply_of_a_span(metered):
    lines = [meta(), turn("t"), counter(0), reply("a"), counter(100, 10, usage(100, 10)), reply("b"), reply("c"), counter(150, 12, usage(50, 2)), reply("d"), counter(400, 20, usage(9, 9))]
    _, found, records = metered(lines)
    assert [(r.kind, r.call_id, r.input) for r in found.orderBy("epoch").collect()] == [("none", None, None), ("reply", "a", 100), ("interval", None, 50), ("interval", None, 250)]
    assert {(r.granularity, r.calls) for r in records.collect()} == {("reply_usage", 1), ("cumulative_interval", None)}
    _, found, _ = metered([meta(), turn("t"), reply("x"), counter(700, 5, usage(100, 5))])
    first = [r for r in found.collect() if r.call_id == "x"]
    assert [(r.input, r.issue) for r in first] == [(100, "earlier use without baseline")]


def test_intervals_of_turns_with_calls_are_left_out(metered):
    _, _, records = metered([meta(), turn("t1"), counter(0), call("r", 70), counter(70), turn("t2"), counter(170), turn("t1"), counter(200)])
    assert sorted((r.granularity, r.input) for r in records.collect())[-1] == ("model_call", 70)
    assert all("t1" not in r.turns for r in records.collect() if r.granularity != "model_call")


def test_compactions(metered):
    lines = [meta(), turn("t"), call("r1", 10), call("r2", 20)] + [{"type": "compacted", "payload": p} for p in ({"compaction_response_id": "r2"}, {"compaction_response_id": "gone"}, {})]
    log, _, records = metered(lines)
    marks = spans.compactions(log)
    assert {(r.call_id, r.internal_kind) for r in spans.reclassified(records, marks).collect()} == {("r1", None), ("r2", "compaction")}
    assert {(r.call_id, r.problem) for r in spans.unmatched_compactions(records, marks).collect()} == {("gone", "call without usage"), (None, "names no call")}


def test_spawned(spark):
    rows = [("subagent.started", "c1", None, "a", "p", "f", 1), ("subagent.spawned", "p", "t1", "a", None, "f", 2), ("subagent.spawned", "p", "t9", "a", None, "f", 3), ("subagent.spawned", "p", "t2", "b", None, "f", 4), ("x", "c2", None, "z", "p", "f", 5)]
    events = spark.createDataFrame(rows, "event string, session string, turn string, agent string, parent string, path string, line_no int")
    assert [tuple(r) for r in spans.spawned(events).collect()] == [("c1", "p", "t1")]


def test_nothing(metered, spark):
    _, found, records = metered([meta()])
    assert found.count() == 0 and records.count() == 0
    assert spans.in_turns(records, spark.createDataFrame([], "turn string")).where(F.col("scope") == "kept").count() == 0
