"""The general operators against brute force on small inputs, and at their edges."""

import datetime as dt
import random
import zoneinfo

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import delivery, hierarchy, intervals, references, timestamps

US = 1_000_000


def utc(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp()) * US


# --- times ---------------------------------------------------------------------

TIMES = [
    ("2026-01-06T02:08:16.677Z", None, utc(2026, 1, 6, 2, 8, 16) + 677_000),
    ("2026-01-06 11:52:25,188 Asia/Shanghai", None, utc(2026, 1, 6, 3, 52, 25) + 188_000),
    ("2026-01-06T03:08:29.190+01:00[Europe/Berlin]", "Asia/Tokyo", utc(2026, 1, 6, 2, 8, 29) + 190_000),
    ("1767658913838", None, utc(2026, 1, 6, 0, 21, 53) + 838_000),
    ("1767658913.8389999", None, utc(2026, 1, 6, 0, 21, 53) + 838_999),
    ("1767658913838123999", None, utc(2026, 1, 6, 0, 21, 53) + 838_123),
    ("2026-006T02:43:30Z", None, utc(2026, 1, 6, 2, 43, 30)),
    ("20260106T024346Z", None, utc(2026, 1, 6, 2, 43, 46)),
    ("2026/1/10 下午1:51:44", " asia/shanghai ", utc(2026, 1, 10, 5, 51, 44)),
    ("2026/1/10 上午12:51:44", "UTC", utc(2026, 1, 10, 0, 51, 44)),
    ("2026年1月10日 00:55:04", "UTC-5", utc(2026, 1, 10, 5, 55, 4)),
    ("2026年01月05日22时38分", "GMT+08:00", utc(2026, 1, 5, 14, 38)),
    ("Apr 10, 2026, 1:26:37 AM", "-0800", utc(2026, 4, 10, 9, 26, 37)),
    ("Sep 30, 2026 9:47:00 AM GMT", "Asia/Tokyo", utc(2026, 9, 30, 9, 47)),
    ("Fri, 01 May 2026 01:11:36 +0800", None, utc(2026, 4, 30, 17, 11, 36)),
    ("10-APR-2026 03:49:53.561", "+05:30", utc(2026, 4, 9, 22, 19, 53) + 561_000),
    ("2026-01-06", "Asia/Kathmandu", utc(2026, 1, 5, 18, 15)),
    ("2026-11-01T01:30:00-04:00", "America/New_York", utc(2026, 11, 1, 5, 30)),
    ("  2026-01-06T10:37:04+01 ", None, utc(2026, 1, 6, 9, 37, 4)),
    ("2026-01-09 12:32:18 Etc/GMT-8", None, utc(2026, 1, 9, 4, 32, 18)),
    # Not determinable.
    ("2026-11-01 01:30:00", "America/New_York", None),
    ("2026-03-08 02:30:00", "America/New_York", None),
    ("2026-02-30T10:15:00Z", None, None),
    ("2026-04-18T25:61:00Z", None, None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("2026-01-06 10:00:00", None, None),
    ("2026-01-06 10:00:00", "Orbit/Station_9", None),
    ("2026/1/10 下午13:51:44", "UTC", None),
    ("1234567890", None, None),
    ("yesterday", "UTC", None),
    ("N/A", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
    ("x" * 100_000 + "1", "UTC", None),
]


def test_times(spark):
    rows = [(i, v, z, "clash") for i, (v, z, _) in enumerate(TIMES)] + [(0, TIMES[0][0], None, "again")]
    df = spark.createDataFrame(rows, "row_id long, v string, z string, __value string")
    got = sorted((r.row_id, r.utc_us) for r in timestamps.normalise_times(df, "v", "z", ["row_id", "__value"]).collect())
    want = sorted([(i, u) for i, (_, _, u) in enumerate(TIMES) if u is not None] + [(0, TIMES[0][2])])
    assert got == want
    assert timestamps.normalise_times(df.limit(0), "v", None, ["row_id"]).count() == 0
    left = {r.row_id for r in timestamps.undetermined_times(df, "v", "z", ["row_id"]).collect()}
    assert left == {i for i, (v, _, u) in enumerate(TIMES) if u is None and v is not None}


@pytest.mark.parametrize("name", ["America/New_York", "Europe/London", "Australia/Adelaide", "Africa/Casablanca", "Asia/Kathmandu", "Pacific/Apia", "UTC"])
def test_zone_tables(name):
    import numpy as np

    zones, zone = timestamps.Zones([name]), zoneinfo.ZoneInfo(name)
    random.seed(3)
    local = [random.randrange(0, 2_400_000_000) for _ in range(3000)]
    got, good = zones.to_utc(np.array(local), np.zeros(len(local), np.int64))
    for wall, at, ok in zip(local, got, good):
        naive = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=wall)
        fits = {int((naive.replace(tzinfo=zone, fold=f)).timestamp()) for f in (0, 1)}
        fits = {t for t in fits if dt.datetime.fromtimestamp(t, zone).replace(tzinfo=None) == naive}
        assert ok == (len(fits) == 1)
        assert not ok or fits == {int(at)}


def test_far_years_and_versions(spark):
    """Before the first and beyond the last written change, the zone's own rules hold."""
    rows = [("1890-06-01 12:00:00", "Europe/Berlin"), ("1850-01-01 00:00:00", "America/New_York"), ("2150-07-01 12:00:00", "America/New_York"), ("2150-01-01 12:00:00", "America/New_York"), ("9999-12-31 23:59:59", "Europe/London"), ("2200-03-09 02:30:00", "America/New_York")]
    df = spark.createDataFrame([(i, v, z) for i, (v, z) in enumerate(rows)], "row_id long, v string, z string")
    got = {r.row_id: r.utc_us for r in timestamps.normalise_times(df, "v", "z", ["row_id"], tzdb=timestamps.tzdb_version()).collect()}
    want = {}
    for i, (v, z) in enumerate(rows[:5]):
        at = dt.datetime.fromisoformat(v).replace(tzinfo=zoneinfo.ZoneInfo(z))
        want[i] = round((at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds()) * US
    assert got == want  # the clocks jump over half past two on the second Sunday of March 2200
    with pytest.raises(ValueError):
        timestamps.normalise_times(df, "v", "z", ["row_id"], tzdb="1999a")
    numbers = spark.createDataFrame([(1, "1767658913"), (2, "631200000")], "row_id long, v string")
    assert [r.row_id for r in timestamps.normalise_times(numbers, "v", None, ["row_id"]).collect()] == [1]


# --- references ------------------------------------------------------------------


def test_references(spark):
    day = lambda d: dt.datetime(2026, 3, d, tzinfo=dt.timezone.utc)
    sessions = spark.createDataFrame(
        [("a", day(1), None, 1), ("a", day(9), None, 2), ("b", day(5), None, 3), ("c", day(1), day(4), 4), (None, day(1), None, 5), ("", day(1), None, 6)],
        "id string, ingested_at timestamp, deleted_at timestamp, h int",
    )
    turns = spark.createDataFrame(
        [(1, "a", "t", day(2)), (2, "zz", "t", day(2)), (3, None, "u", day(2)), (4, "a", None, day(2)), (5, "", "v", day(2))], "row_id long, session_id string, turn_id string, ingested_at timestamp"
    )
    usage = spark.createDataFrame(
        [(1, "a", "t", day(3)), (2, "b", "t", day(3)), (3, "c", "", day(4)), (4, "c", None, day(3)), (5, "no", "t", day(3)), (6, None, "u", day(3)), (7, "", "v", day(3)), (8, "a", "t", day(1)), (9, "a", "t", None)],
        "row_id long, session_id string, turn_id string, ingested_at timestamp",
    )
    got = sorted((r.ref_table, r.ref_field, r.row_id, r.state, r.ref_month) for r in references.usage_references(usage, turns, sessions).collect())
    assert got == sorted([
        ("turn_usage", "session_id", 2, "missing", "2026-03"), ("model_usage", "session_id", 2, "late", "2026-03"), ("model_usage", "session_id", 3, "deleted", "2026-03"),
        ("model_usage", "session_id", 5, "missing", "2026-03"), ("model_usage", "turn_id", 2, "missing", "2026-03"), ("model_usage", "turn_id", 5, "missing", "2026-03"),
        ("model_usage", "turn_id", 6, "missing", "2026-03"), ("model_usage", "turn_id", 8, "late", "2026-03"),
    ])
    assert references.usage_references(usage.limit(0), turns.limit(0), sessions.limit(0)).count() == 0
    assert references.usage_references(usage, turns.limit(0), sessions.limit(0)).where("state = 'missing'").count() == 7 + 7


def test_lookup_tells_equal_hashes_apart():
    import numpy as np
    import pyarrow as pa

    parents = pa.table({"h": [5, 5, 5, 9], "key": ["x", "y", "z", "w"], "seen": [1, 2, 3, 4], "gone": pa.array([None, 7, None, None], pa.int64())})
    found, seen, gone = references.lookup(pa.array(["z", "y", "q", "w", None, "a"]), np.array([5, 5, 5, 9, 5, 1]), parents)
    assert found.tolist() == [True, True, False, True, False, False]
    assert seen[[0, 1, 3]].tolist() == [3, 2, 4] and gone[1] == 7


def test_hot_reference_is_spread(spark, monkeypatch):
    monkeypatch.setattr(references, "ROWS_PER_SLOT", 50)
    refs = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"), F.lit("2026-01-02").cast("timestamp").alias("at"), "id")
    parents = spark.range(800, 1000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("2026-01-01").cast("timestamp").alias("seen_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    assert max(r.tasks for r in references._busy_ranges(refs.withColumn("h", F.xxhash64("key")), 5).collect()) >= 14
    got = references.failing_references(refs, parents)
    assert got.count() == 800 and {r.state for r in got.select("state").distinct().collect()} == {"missing"}


# --- hierarchies -----------------------------------------------------------------


def walk(parents):
    out = {}
    for node in parents:
        path, seen, at = [node], {node}, node
        while at is not None and parents.get(at) in parents and parents[at] is not None:
            at = parents[at]
            if at in seen:
                break
            seen.add(at)
            path.append(at)
        else:
            at = None
        out[node] = (path[-1], len(path) - 1, path[::-1]) if at is None else (None, -1 if at == node else -2, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy(spark, seed):
    random.seed(seed)
    parents = {f"n{i}": f"n{random.randrange(max(0, i - 3), i)}" if i and random.random() < 0.9 else random.choice([None, "", "lost"]) for i in range(60)}
    parents |= {f"c{i}": f"c{i + 1}" for i in range(120)} | {"c120": None}  # a long chain
    parents |= {"r0": "r1", "r1": "r2", "r2": "r0", "s": "s", "x": "r1", "y": "x", "z": "s", "lone": None}
    rows = [(k, v, 1) for k, v in parents.items()] + [("n5", parents["n5"], 2), (None, "n1", 3)]
    df = spark.createDataFrame(rows, "id string, parent string, k int")
    got = {r.node_id: (r.root_id, r.node_depth, r.ancestors) for r in hierarchy.hierarchy(df, "id", "parent").collect()}
    assert got == walk(parents)


def test_a_star_of_very_many_children(spark):
    n = 200_000
    rows = spark.range(n).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("hub").alias("parent")).unionByName(spark.createDataFrame([("hub", "top"), ("top", None)], "id string, parent string"))
    found = hierarchy.hierarchy(rows, "id", "parent")
    assert [tuple(r) for r in found.groupBy("node_depth").count().orderBy("node_depth").collect()] == [(0, 1), (1, 1), (2, n)]
    assert found.where("root_id <> 'top'").count() == 0


def test_hierarchy_edges(spark):
    empty = spark.createDataFrame([], "id string, parent string")
    assert hierarchy.hierarchy(empty, "id", "parent").count() == 0
    one = spark.createDataFrame([("a", "a")], "id string, parent string")
    assert [tuple(r) for r in hierarchy.hierarchy(one, "id", "parent").collect()] == [("a", None, -1, None)]
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string")
    found = hierarchy.hierarchy(tree, "id", "parent")
    assert sorted(tuple(r) for r in hierarchy.descendants(found).collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


# --- intervals ---------------------------------------------------------------------


def merged(rows):
    out = []
    for key in {r[0] for r in rows}:
        spans = []
        for a, b in sorted((a, b) for k, a, b in rows if k == key and a is not None and b is not None and b > a):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        out += [(key, "period", a, b) for a, b in spans] + [(key, "gap", x[1], y[0]) for x, y in zip(spans, spans[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,width", [(1, 3), (2, 30), (3, 400)])
def test_intervals(spark, seed, width):
    random.seed(seed)
    rows = []
    for _ in range(800):
        key = random.choice(["hot"] * 6 + ["a", "b", None])
        a = random.randrange(2000)
        rows.append((key, a if random.random() > 0.03 else None, a + random.randrange(-2, width) if random.random() > 0.03 else None))
    rows += rows[:50] + [("hot", 0, 1)] * 30
    df = spark.createDataFrame([(*r, "x") for r in rows], "e string, from_ms long, upto_ms long, pid string")
    got = sorted((tuple(r) for r in intervals.periods_and_gaps(df, ["e"]).collect()), key=repr)
    assert got == merged(rows)


def test_intervals_edges(spark):
    df = spark.createDataFrame([("a", 5, 5), ("a", 7, 3), ("b", None, None)], "e string, from_ms long, upto_ms long")
    assert intervals.periods_and_gaps(df, ["e"]).count() == 0
    touch = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("a", 5, 6)], "e string, from_ms long, upto_ms long")
    assert sorted(tuple(r) for r in intervals.periods_and_gaps(touch, ["e"]).collect()) == [("a", "gap", 3, 5), ("a", "period", 1, 3), ("a", "period", 5, 6)]


# --- repeated deliveries -------------------------------------------------------------

KEY = ("s", "i", "a", "row_id")


def groups(rows):
    out = {}
    for s, i, a, r in rows:
        if s is not None and a is not None and i is not None and i.strip(" \t\r\n 　"):
            out.setdefault((s, i.strip(" \t\r\n 　").lower(), a), []).append(r)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_copies(spark, seed):
    random.seed(seed)
    ids = [f"msg_{n:04x}" for n in range(40)] + ["MSG_0003", " msg_0004", "msg_4", "zz top", "Zz Top ", "", " ", None, "0a", "a"]
    rows = [(random.choice(["p", "q", "hot", "hot", "hot", None]), random.choice(ids + ["msg_0007"] * 30), random.choice([0, 0, 1, None]), n) for n in range(1500)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "s string, i string, a int, row_id long, __again string")
    want = groups(rows)
    found = delivery.copies(df, *KEY)
    assert sorted(tuple(r) for r in found.collect()) == sorted((r, g[0]) for g in want.values() if len(g) > 1 for r in g)
    assert delivery.delivered_once(df, *KEY).count() == len(rows) - sum(len(g) - 1 for g in want.values())
    pairs = sorted(tuple(r) for r in delivery.copy_pairs(found).collect())
    assert pairs == sorted((x, y) for g in want.values() for k, x in enumerate(g) for y in g[k + 1 :])


def test_copies_edges(spark, monkeypatch):
    schema = "s string, i string, a int, row_id long"
    assert delivery.copies(spark.createDataFrame([], schema), *KEY).count() == 0
    monkeypatch.setattr(delivery, "PAIR_ROWS", 10)
    same = spark.createDataFrame([("p", "m1", 0, n) for n in range(500)], schema)
    assert {tuple(r) for r in delivery.copies(same, *KEY).collect()} == {(n, 0) for n in range(500)}


def test_a_message_of_very_many_copies(spark):
    """One message fills a third of the rows and more; its rows are put together before they are shuffled."""
    n = 100_000
    rows = spark.range(3 * n).select(F.lit("p").alias("s"), F.when(F.col("id") % 3 > 0, "msg_00ff").otherwise(F.concat(F.lit("m_"), F.lpad(F.hex("id"), 9, "0"))).alias("i"), F.lit(0).alias("a"), F.col("id").alias("row_id"))
    assert delivery.delivered_once(rows, *KEY).count() == n + 1
    found = delivery.copies(rows, *KEY)
    assert found.count() == 2 * n and [r.kept_row_id for r in found.select("kept_row_id").distinct().collect()] == [1]


def test_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(delivery, "PAIR_ROWS", 10)
    same = spark.createDataFrame([("p", "m1" if n % 9 else "m2", 0, n) for n in range(120)], "s string, i string, a int, row_id long")
    got = sorted(tuple(r) for r in delivery.copy_pairs(delivery.copies(same, *KEY)).collect())
    assert got == [(x, y) for x in range(120) for y in range(x + 1, 120) if (x % 9 == 0) == (y % 9 == 0)]


def test_ranges_are_cut_at_blocks(spark):
    rows = spark.range(10_000).select(F.lit("p").alias("s"), F.concat(F.lit("m_"), F.lpad(F.hex("id"), 4, "0")).alias("i"), F.lit(0).alias("a"), F.col("id").alias("row_id"))
    ranges = sorted((r.block, r.lo, r.hi) for r in delivery.seen_ranges(rows, *KEY).collect())
    assert ranges == [(0, 0, 4095), (1, 4096, 8191), (2, 8192, 9999)]


def test_seen_ranges(spark):
    schema = "s string, i string, a int, row_id long"
    first = spark.createDataFrame([("p", f"m_{n:04x}", 0, n) for n in (1, 2, 3, 7, 8)] + [("p", "free form!", 0, 20)], schema)
    ranges = delivery.seen_ranges(first, *KEY)
    assert sorted((r.producer, r.lo, r.hi) for r in ranges.collect()) == [("free form!", 0, 0), ("m_", 1, 3), ("m_", 7, 8)]
    second = spark.createDataFrame([("p", "m_0004", 0, 30), ("p", "M_0004", 0, 31), ("p", "m_0003", 0, 32), ("p", "free form!", 0, 33), ("p", "other!", 0, 34), ("p", None, 0, 35)], schema)
    assert sorted(r.row_id for r in delivery.unseen(second, ranges, *KEY).collect()) == [30, 34]
    both = delivery.seen_ranges(second, *KEY, earlier=ranges)
    assert sorted((r.producer, r.lo, r.hi) for r in both.collect()) == [("free form!", 0, 0), ("m_", 1, 4), ("m_", 7, 8), ("other!", 0, 0)]
