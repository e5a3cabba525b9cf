"""Usage queries over start times in every spelling, against brute force: SQL reads only numbers of 13 digits."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from test_problems import TIMES

from tallyloom.operators import timestamps
from tallyloom.plans import usage

HOUR, DAY = 3_600_000, 86_400_000
GROUPS = {"main_turn": "main", "subagent": "child", "workflow_child": "child"} | dict.fromkeys(("compact", "session_title", "web_fetch_processing", "web_search_tool"), "internal")
#: Spellings whose finest part is coarser than a millisecond.
UNITS = {
    "2026-006T02:43:30Z": 1000, "20260106T024346Z": 1000, "2026/1/10 下午1:51:44": 1000, "2026/1/10 上午12:51:44": 1000, "2026年1月10日 00:55:04": 1000, "2026年01月05日22时38分": 60_000,
    "Apr 10, 2026, 1:26:37 AM": 1000, "Sep 30, 2026 9:47:00 AM GMT": 1000, "Fri, 01 May 2026 01:11:36 +0800": 1000, "2026-01-06": DAY, "2026-11-01T01:30:00-04:00": 1000,
    "  2026-01-06T10:37:04+01 ": 1000, "2026-01-09 12:32:18 Etc/GMT-8": 1000,
}


@pytest.fixture(scope="module")
def table(spark, small, tmp_path_factory):
    """The rows of model_usage with start times of known instants, and ends near them."""
    rng, rows = random.Random(7), []
    source = spark.read.parquet(f"{small}/model_usage.parquet")
    for k, r in enumerate(source.orderBy("row_id").collect()):
        text, zone, us = TIMES[k % len(TIMES)]
        start = us // 1000 if us is not None else None
        at = start if start is not None else 1_780_000_000_000
        first = rng.choice([None, at + rng.randrange(5000), at + rng.randrange(5000), at - 1])
        end = rng.choice([None, at + rng.randrange(9000), at + 26 * HOUR, at + rng.randrange(9000), at - 5])
        unit = UNITS.get(text, 1)
        direct = rng.choice([None, -1, *([end - at - rng.randrange(unit), end - at - unit - 1] if end is not None else [7])])
        native = rng.choice([None, None, -3, *([first - at] * 3 if first is not None else [5])])
        rows.append(r.asDict() | {"started_at": text, "recorded_tz": zone, "first_token_at": first, "completed_at": end, "duration_ms": direct, "time_to_first_token_ms": native, "want": start, "unit": unit})
    folder = str(tmp_path_factory.mktemp("times"))
    spark.createDataFrame([tuple(r[c] for c in source.columns) for r in rows], source.schema).write.parquet(f"{folder}/model_usage.parquet")
    return folder, rows


def group(r):
    return GROUPS.get(r["query_source"], "unknown")


def days(rows):
    """The day of each record of the range; ``None`` if it began before its day or the range."""
    for r in rows:
        if r["completed_at"] is None or not usage.SINCE <= r["completed_at"] < usage.UPTO:
            continue
        start = (r["completed_at"] + 8 * HOUR) // DAY * DAY - 8 * HOUR
        crosses = r["want"] is not None and r["want"] < max(start, usage.SINCE)
        yield r, None if crosses else (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=start + 8 * HOUR)).strftime("%Y-%m-%d")


def latency(r):
    start, first, native, tools = r["want"], r["first_token_at"], r["time_to_first_token_ms"], r["tool_call_count"]
    if start is None or first is None:
        return "missing: start or first token"
    if tools is None:
        return "missing: tool call count"
    if tools > 0:
        return "unsupported: tool arguments"
    if first < start:
        return "conflict: first token before start"
    if native is not None and native < 0:
        return "conflict: native latency"
    if native is not None and native != first - start:
        return "conflict: native latency differs"
    return "sample" if usage.SINCE <= first < usage.UPTO else "range: first token"


def test_days_of_every_spelling(spark, table):
    folder, rows = table
    placed = list(days(rows))
    assert sum(d is None for _, d in placed) > 10
    assert {(r.day, r.grp): r.records for r in usage.usage_daily(spark, folder).collect()} == Counter((d, group(r)) for r, d in placed if d)
    assert {(r.day, r.model_id): r.records for r in usage.usage_day_models(spark, folder).collect()} == Counter((d, r["model_id"]) for r, d in placed if d)
    assert {r.grp: r.records for r in usage.usage_unbucketed(spark, folder).collect()} == Counter(group(r) for r, d in placed if d is None)
    assert {r.part: r.n for r in usage.usage_partition(spark, folder).collect()} == Counter("days" if d else "unbucketed" for _, d in placed)
    sessions = defaultdict(set)
    for r, d in placed:
        if d:
            sessions[d] |= {r["session_id"]} - {None}
    got = usage.usage_daily_sessions(spark, folder).collect()
    assert {r.day: (r.sessions, r.records) for r in got} == {d: (len(s), sum(x == d for _, x in placed)) for d, s in sessions.items()}


def test_latency_of_every_spelling(spark, table):
    folder, rows = table
    assert {r.outcome: r.n for r in usage.latency_outcomes(spark, folder).collect()} == Counter(map(latency, rows))
    total = Counter()
    for r in rows:
        if latency(r) == "sample":
            total[r["model_id"]] += r["first_token_at"] - r["want"]
    assert {r.model_id: r.total_ms for r in usage.latency_by_model(spark, folder).collect()} == total


def test_durations_are_compared_as_finely_as_starts_are_written(spark, table):
    folder, rows = table
    want = defaultdict(Counter)
    for r in rows:
        direct, span = r["duration_ms"], None if r["want"] is None or r["completed_at"] is None else r["completed_at"] - r["want"]
        bad = (direct is not None and direct < 0) or (span is not None and span < 0) or (None not in (direct, span) and abs(span - direct) > r["unit"])
        state = "conflict" if bad else "missing" if direct is None and span is None else "valid"
        want[group(r)][state] += 1
        want[group(r)]["total_ms"] += (span if direct is None else direct) if state == "valid" else 0
    got = usage.duration_groups(spark, folder).collect()
    assert {r.grp: {k: r[k] for k in ("valid", "conflict", "missing", "total_ms")} for r in got} == {g: {k: c[k] for k in ("valid", "conflict", "missing", "total_ms")} for g, c in want.items()}


def test_units_of_spellings(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(TIMES)], "row_id long, v string, z string")
    got = {TIMES[r.row_id][0]: r.unit for r in timestamps.normalise_times(df, "v", "z", ["row_id"], unit="unit").collect()}
    assert {v: max(1, u // 1000) for v, u in got.items()} == {v: UNITS.get(v, 1) for v, _, us in TIMES if us is not None}
