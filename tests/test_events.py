"""Event operators: brute force, hot users, and stream = batch."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.functions import text
from panelscope.operators import audit, events
from panelscope.sources import keyed, logs
from panelscope.streaming import events as streams

START = dt.datetime(2024, 1, 1)
KEEP = {"late": "3650 days", "idle": None}
SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, institution string"


def make_events(n=1500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if i % 3 == 0 else rng.randint(2, 12)  # one user owns a third
        at = START + dt.timedelta(seconds=rng.randint(0, 40 * 3600), microseconds=rng.randint(0, 3))
        rows.append((i, user, at, rng.choice(["view", "ask"]), rng.choice(["A", "B", "", None])))
    return rows


@pytest.fixture(scope="module")
def usage(spark):
    return spark.createDataFrame(make_events(), SCHEMA).cache()


def brute_quota(rows, limit, seconds):
    out, state = {}, {}
    for event_id, user, at, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        start, used = state.get(user, (at, 0))
        if (at - start).total_seconds() > seconds:
            start, used = at, 0
        out[event_id] = used < limit
        state[user] = (start, used + (used < limit))
    return out


def brute_changes(rows):
    kept, last = set(), {}
    for event_id, user, at, _, value in sorted(rows, key=lambda r: (r[2], r[0])):
        if value and last.get(user) != value:
            kept.add(event_id)
            last[user] = value
    return kept


@pytest.mark.parametrize("limit,seconds", [(5, 3600), (50, 3600), (1, 7200)])
def test_quota(usage, limit, seconds):
    want = brute_quota(make_events(), limit, seconds)
    plain = events.quota_flags(usage, limit, seconds)
    assert {r["event_id"]: r["accepted"] for r in plain.collect()} == want


def test_quota_openings_match_the_sequential_form(usage):
    rows = sorted(make_events(), key=lambda r: (r[1], r[2], r[0]))
    want = {}
    for user in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == user]
        times = np.array([int((r[2] - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for r in mine])
        starts, flags = events.quota_windows(times, 4, 3600 * 1_000_000)
        want |= {r[0]: (int(s), bool(f)) for r, s, f in zip(mine, starts, flags)}
    got = events.quota_flags(usage, 4, 3600).collect()
    assert {r["event_id"]: (r["window_start_us"], r["accepted"]) for r in got} == want


@pytest.mark.parametrize("chunk_points", [0, 100, 1 << 20])
def test_quota_openings_by_chunks_and_by_doubling(spark, chunk_points):
    """Sparse users, a dense one, windows across chunks, and times on the borders."""
    rng, width = random.Random(5), 1000
    span = events.CHUNK_WINDOWS * width
    times = {"sparse": [rng.randrange(20 * span) for _ in range(60)], "dense": [rng.randrange(3 * span) for _ in range(3000)],
             "even": list(range(0, 6 * span, 250)), "borders": [k * span + d for k in range(5) for d in (-width, -1, 0, 1, width, width + 1)],
             "gaps": [k * 7 * span + d for k in range(4) for d in range(0, 3 * width, 333)], "one": [5], "before": [-5, -1, 0, 3]}
    rows = [(u, t, t // width) for u, held in times.items() for t in held * 2]
    cut = spark.createDataFrame(rows, "user_id string, _t long, _b long").repartition(5)
    want = set()
    for u, held in times.items():
        starts, _ = events.quota_windows(np.array(sorted(held)), 1, width)
        want |= {(u, int(s)) for s in starts}
    got = [tuple(r) for r in events.window_openings(cut, width, "user_id", chunk_points).select("user_id", "_o").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_chunk_maps_are_short():
    """Different entries soon lead to the same windows."""
    rng = np.random.default_rng(1)
    width, span = 1000, 32_000
    times = np.sort(rng.choice(span, 300, replace=False))
    group = np.zeros(300, np.int64)
    at, last = events.chunk_entries(group, times, width, span)
    assert len(at) < 12
    for start in range(0, width, 50):  # the end of the window open at the start
        now = int(np.searchsorted(times, start, "right"))
        entry = at[np.searchsorted(times[at], start, "right")]
        while (after := int(np.searchsorted(times, times[now] + width, "right"))) < 300:
            now = after
        assert times[last[np.flatnonzero(at == entry)[0]]] == times[now]


def test_quota_jobs_do_not_grow_with_time(spark):
    """A dense run of 400 windows."""
    rows = [(i, 1, START + dt.timedelta(minutes=20 * i), "ask", "A") for i in range(1200)]
    dense = spark.createDataFrame(rows, SCHEMA)
    got = {r["event_id"]: r["accepted"] for r in events.quota_flags(dense, 2, 3600).collect()}
    assert got == brute_quota(rows, 2, 3600)


def test_dedup(usage):
    kept = {r["event_id"] for r in events.dedup_consecutive(usage).collect()}
    assert kept == brute_changes(make_events())


def test_preferences_upsert(spark):
    cols = "user_id string, institution string, custom_peers array<string>, updated_at timestamp"
    old = spark.createDataFrame([("u", "A", ["x"], START), ("u", "B", ["y"], START)], cols)
    new = spark.createDataFrame([("u", "A", ["z"], START + dt.timedelta(days=1))], cols)
    got = {r["institution"]: r["custom_peers"] for r in events.upsert_preferences(old, new).collect()}
    assert got == {"A": ["z"], "B": ["y"]}


def test_merges_leave_other_buckets_alone(spark, tmp_path):
    cols = "user_id string, institution string, custom_peers array<string>, updated_at timestamp"
    path, keys = str(tmp_path / "kept"), ["user_id", "institution"]
    rows = [(f"u{i}" if i else None, "A", [str(i)], START) for i in range(300)]
    first = spark.createDataFrame(rows, cols)
    assert len(keyed.merge_keyed(spark, path, first, keys, ["updated_at"], 16)) == 16

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*.parquet")}

    before = files()
    later = START + dt.timedelta(days=1)
    changes = [("u5", "A", ["new"], later), ("u7", "A", ["older"], START - dt.timedelta(days=1)), (None, "A", ["none"], later),
               ("u5", "A", ["newer"], later + dt.timedelta(hours=1)), ("fresh", "B", [], START)]
    for _ in range(2):  # merged again, nothing changes
        touched = keyed.merge_keyed(spark, path, spark.createDataFrame(changes, cols), keys, ["updated_at"], 16)
        got = {(r.user_id, r.institution): r.custom_peers for r in keyed.read_keyed(spark, path, first).collect()}
        want = {(u, i): p for u, i, p, _ in rows} | {("u5", "A"): ["newer"], (None, "A"): ["none"], ("fresh", "B"): []}
        assert got == want and 1 <= len(touched) <= 4
    changed = {p.parent.name for p in set(files().items()) ^ set(before.items()) for p in [p[0]]}
    assert changed == {f"bucket={b}" for b in touched}
    assert keyed.merge_keyed(spark, path, first.where("false"), keys, ["updated_at"], 16) == []


@pytest.mark.parametrize("part_rows", [5, 1 << 20])
def test_merges_move_kept_rows_once(spark, tmp_path, monkeypatch, part_rows):
    cols, stored = "k long, v string, at long", []
    monkeypatch.setattr(keyed, "PART_ROWS", part_rows)
    monkeypatch.setattr(keyed, "write_scratch", lambda df, name, f=keyed.write_scratch: stored.append(name) or f(df, name))
    path, want = str(tmp_path / "kept"), {}
    for turn in range(3):
        rows = [(k if k else None, f"{turn}-{k}", 10 * (turn if k % 2 else -turn) + k) for k in range(turn * 50, turn * 50 + 120)]
        want |= {k: (v, at) for k, v, at in rows if k not in want or at > want[k][1]}
        keyed.merge_keyed(spark, path, spark.createDataFrame(rows, cols), ["k"], ["at"], 8)
        got = keyed.read_keyed(spark, path, spark.createDataFrame(rows, cols)).collect()
        assert len(got) == len(want) and {r.k: (r.v, r.at) for r in got} == want
    assert stored == ["changes"] * 3  # kept rows go from the table to the table


def ordered_files(spark, rows, folder, n=4):
    """The events as files in time order."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    step = -(-len(rows) // n)
    for i in range(n):
        part = spark.createDataFrame(rows[i * step:(i + 1) * step], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(folder)


def drain(stream, folder, name):
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/{name}")
        .option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/{name}")


@pytest.fixture(scope="module")
def event_stream(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream"))
    ordered_files(spark, make_events(300), f"{folder}/in")
    def open_stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return open_stream, folder


def test_quota_stream_equals_batch(spark, event_stream):
    open_stream, folder = event_stream
    got = drain(streams.quota_stream(open_stream(), 3, 3600, **KEEP), folder, "quota")
    assert {r["event_id"]: r["accepted"] for r in got.collect()} == brute_quota(make_events(300), 3, 3600)


def test_dedup_stream_equals_batch(spark, event_stream):
    open_stream, folder = event_stream
    got = drain(streams.dedup_consecutive_stream(open_stream(), **KEEP), folder, "dedup")
    assert {r["event_id"] for r in got.collect()} == brute_changes(make_events(300))


def test_idle_users_are_forgotten_only_if_asked(spark, event_stream):
    open_stream, folder = event_stream
    got = drain(streams.quota_stream(open_stream(), 3, 3600, late="1 hour", idle="2 hours"), folder, "idle")
    assert {r["event_id"]: r["accepted"] for r in got.collect()} == brute_quota(make_events(300), 3, 3600)


def many_users(n=900):
    """More users than rows a user; rows without a user are one user's, and ids beyond 2 ** 53 stand beside none."""
    rng = random.Random(8)
    return [((1 << 53) + i, rng.randint(1, 300) if i % 10 else None, at, kind, value)
            for i, _, at, kind, value in make_events(n, 8)]


@pytest.mark.parametrize("buckets", [4, 512])
def test_users_of_streams_share_groups(spark, tmp_path, buckets):
    folder, rows = str(tmp_path), many_users()
    ordered_files(spark, rows, f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for name, made in (("quota", streams.quota_stream(stream, 1, 36000, **KEEP, buckets=buckets)),
                       ("dedup", streams.dedup_consecutive_stream(stream, **KEEP, buckets=buckets))):
        query = made.writeStream.format("parquet").option("path", f"{folder}/{name}").option(
            "checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
        query.awaitTermination()
        assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= min(buckets + 1, 301)
    quota = spark.read.parquet(f"{folder}/quota").collect()
    assert len(quota) == len(rows) and {r.event_id: r.accepted for r in quota} == brute_quota(rows, 1, 36000)
    dedup = spark.read.parquet(f"{folder}/dedup").collect()
    assert sorted(r.event_id for r in dedup) == sorted(brute_changes(rows))
    assert {(r.event_id, r.user_id) for r in quota + dedup} <= {r[:2] for r in rows}


def test_rows_without_id_or_time_in_streams(spark, tmp_path):
    at = [START + dt.timedelta(hours=h) for h in range(3)]
    big = (1 << 53) + 1
    rows = [(None, 1, at[1], "view", "A"), (big, 1, at[1], "view", "B"), (big + 2, 2, at[1], "view", "A"),
            (7, 2, None, "view", "A"), (8, 3, at[2], "view", "")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    quota = drain(streams.quota_stream(stream, 1, 3600, **KEEP, buckets=1), folder, "quota").collect()
    # rows without an id come last among those of their time; without a time they are left out
    assert {(r.event_id, r.accepted) for r in quota} == {(big, True), (None, False), (big + 2, True), (8, True)}
    dedup = drain(streams.dedup_consecutive_stream(stream, **KEEP, buckets=1), folder, "dedup").collect()
    assert {(r.event_id, r.institution) for r in dedup} == {(big, "B"), (None, "A"), (big + 2, "A")}


@pytest.mark.parametrize("buckets", [1, 512])
def test_idle_users_of_a_group_are_forgotten_one_by_one(spark, tmp_path, buckets):
    folder = str(tmp_path)
    slices = [[(1, 1, 0, "A"), (2, 2, 0, "A")], [(3, 2, 1, "A"), (4, 3, 5, "A")], [(5, 3, 6, "A")],
              [(6, 1, 6.5, "A"), (7, 2, 6.6, "A"), (8, 3, 6.7, "A")]]
    for rows in slices:
        spark.createDataFrame([(i, u, START + dt.timedelta(hours=h), "view", v) for i, u, h, v in rows], SCHEMA).coalesce(
            1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    made = streams.dedup_consecutive_stream(stream, late="0 seconds", idle="2 hours", buckets=buckets)
    assert {r.event_id for r in drain(made, folder, "idle").collect()} == {1, 2, 4, 6, 7}


def hot_rows(n=600):
    """One user has two thirds of all events; some are later than those of the next file."""
    return [(i, -1 if i % 3 else user, at, kind, value) for i, user, at, kind, value in make_events(n, 9)]


@pytest.mark.parametrize("again", [False, True])
def test_hot_user_in_a_stream_equals_batch(spark, tmp_path, again):
    rows = hot_rows()
    folder = str(tmp_path)
    ordered_files(spark, rows, f"{folder}/in", 5)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for name, make in (("quota", lambda o, s: streams.quota_sink(o, s, 3, 3600)), ("dedup", streams.dedup_sink)):
        sink = make(f"{folder}/{name}", f"{folder}/{name}-kept")

        def run(batch, batch_id, sink=sink):
            sink(batch, batch_id)
            if again:  # as after a failure behind the last write
                sink(batch, batch_id)

        stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/{name}-state").trigger(
            availableNow=True).start().awaitTermination()
    quota = spark.read.parquet(f"{folder}/quota").collect()
    assert len(quota) == len(rows) and {r["event_id"]: r["accepted"] for r in quota} == brute_quota(rows, 3, 3600)
    dedup = [r["event_id"] for r in spark.read.parquet(f"{folder}/dedup").collect()]
    assert len(dedup) == len(set(dedup)) and set(dedup) == brute_changes(rows)


def test_idle_users_and_late_views_of_keyed_streams(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame([(i, 1, START + dt.timedelta(hours=h), "view", v) for i, h, v in rows], SCHEMA)

    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    sink = streams.dedup_sink(out, state, idle="5 hours")
    for n, rows in enumerate([[(1, 0, "A"), (2, 1, "A")], [(3, 6, "A"), (4, 7, "B")], [(5, 13, "B"), (6, 12.5, "B")], []]):
        sink(batch(*rows), n)
    assert {r["event_id"] for r in spark.read.parquet(out).collect()} == {1, 4, 6}
    out, state = f"{tmp_path}/quota", f"{tmp_path}/windows"
    sink = streams.quota_sink(out, state, 2, 3600)
    sink(batch((1, 5.0, "A")), 0)
    sink(batch((2, 4.5, "A"), (3, 5.2, "A"), (4, 6.1, "A")), 1)  # the first is late
    got = {r["event_id"]: (r["accepted"], r["window_start_us"]) for r in spark.read.parquet(out).collect()}
    first = got[1][1]
    assert got[2] == (True, first) and got[3] == (False, first) and got[4][0] and got[4][1] > first


def test_usage_stream_delivers_all_windows(spark, event_stream):
    open_stream, folder = event_stream
    counts = streams.usage_counts_stream(open_stream(), every="1 hour", late="1 hour")
    counts.writeStream.outputMode("update").foreachBatch(streams.append_versions(f"{folder}/usage")).option(
        "checkpointLocation", f"{folder}/usage-state").trigger(availableNow=True).start().awaitTermination()
    newest = streams.newest_versions(spark.read.parquet(f"{folder}/usage"), ["window_start", "event_type"])
    want = {}
    for _, _, at, kind, _ in make_events(300):
        hour = at.replace(minute=0, second=0, microsecond=0)
        want[hour, kind] = want.get((hour, kind), 0) + 1
    assert {(r["window_start"], r["event_type"]): r["n_events"] for r in newest.collect()} == want


def test_distinct_users_of_a_stream(spark, event_stream):
    open_stream, folder = event_stream
    counts = streams.usage_users_stream(open_stream(), every="1 hour", late="1 hour")
    counts.writeStream.outputMode("update").foreachBatch(keyed.merge_sink(
        f"{folder}/users", ["window_start", "event_type", "user_id"], ["batch"], 4)).option(
        "checkpointLocation", f"{folder}/users-state").trigger(availableNow=True).start().awaitTermination()
    want = {}
    for _, user, at, kind, _ in make_events(300):
        want.setdefault((at.replace(minute=0, second=0, microsecond=0), kind), []).append(user)
    got = streams.distinct_users(keyed.read_keyed(spark, f"{folder}/users", counts)).collect()
    assert {(r["window_start"], r["event_type"]): (r["n_events"], r["n_users"]) for r in got} == {
        k: (len(v), len(set(v))) for k, v in want.items()}


def test_usage_log(spark):
    lines = [
        "2026-01-13 22:57:18,223 - User: ann | Question: top 5 | by size", "",
        "2026-01-13 22:57:18,223 - User: ann | Question: top 5 | by size", "not a log line",
        "2026-01-13 23:08:40,447 - User: Bo | Question: YOY",
    ]
    got = logs.parse_usage_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r["ts"], r["username"], r["question"]) for r in got) == [
        (dt.datetime(2026, 1, 13, 22, 57, 18, 223000), "ann", "top 5 | by size"),
        (dt.datetime(2026, 1, 13, 23, 8, 40, 447000), "Bo", "YOY"),
    ]


def test_audit(spark):
    sql = [
        (1, "select * from f where field_code = 'eng_robotics' and agency_code='NSF'"),
        (2, "select * from f where FIELD_CODE='cs' or agency_code = 'NIH'"),
        (3, "select * from f where field_code = 'zoology'"),
    ]
    got = {r["id"]: r for r in audit.unknown_codes(spark.createDataFrame(sql, "id int, q string"), "id", "q").collect()}
    assert got[1]["kind"] == "field_code" and got[1]["suggestions"].split(", ")[0] == "eng_aerospace"
    assert len(got[1]["suggestions"].split(", ")) == 9
    assert got[2]["code"] == "NIH" and "HHS" in got[2]["suggestions"]
    assert len(got[3]["suggestions"].split(", ")) == 46


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [(1.5e9, "A & M, The"), (2.55e6, "Old Name, City Campus"), (999.0, "X Y"), (None, None), (float("nan"), "Z,the ")],
        "x double, n string",
    )
    got = df.select(
        text.short_dollars(F.col("x")).alias("s"), text.full_dollars(F.col("x")).alias("f"),
        text.article_first(F.col("n")).alias("t"), text.slug(F.col("n")).alias("g"),
        text.source_column(F.lit(" State and local government ")).alias("c"),
        text.source_column(F.lit("Business\t")).alias("c1"), text.source_column(F.lit("All other sources\n")).alias("c2"),
        text.source_column(F.lit("\u00a0\u00c9conomie publique")).alias("c3"),
    ).collect()
    assert [r["s"] for r in got[:3]] == ["$1.50B", "$2.5M", "$999"]  # 2.55 is stored below the tie
    assert [r["f"] for r in got] == ["$1,500,000,000", "$2,550,000", "$999", "—", "—"]
    assert [r["t"] for r in got] == ["The A & M", "Old Name, City Campus", "X Y", None, "The Z"]
    assert [r["g"] for r in got[:3]] == ["A_&_M", "Old_Name", "X_Y"]
    assert got[0]["c"] == "state_local"
    assert (got[0]["c1"], got[0]["c2"], got[0]["c3"]) == ("business", "other_sources", "économie_publique")
