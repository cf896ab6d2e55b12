"""Streams over several micro-batches, with late rows and restarts, against their batch form or brute force."""

import datetime
import random
import time
import uuid
from collections import defaultdict, deque

import pytest

from kbspark.sources.standins import Tables
from kbspark.streaming import jobs as J
from kbspark.streaming import state as S

SF = "/root/testdata/sf0.001"
START = datetime.datetime(2024, 1, 1)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def put(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_order(spark, tmp_path, batches, schema):
    """A stream with one micro-batch for each list of rows."""
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    for rows in batches:
        put(spark.createDataFrame(rows, schema), path)
    return stream(spark, path, schema)


def turn(user, minutes):
    return (user, START + datetime.timedelta(minutes=minutes))


TURNS = "user_id long, ts timestamp"


def test_changes_over_batches_with_turns_out_of_order(spark, tmp_path):
    rng = random.Random(5)
    base = sorted(rng.uniform(0, 600) for _ in range(400))
    batches, every = [], []
    for i in range(0, 400, 100):
        part = base[i : i + 100]
        rows = [turn(rng.randrange(5), m) for m in part]
        rng.shuffle(rows)
        batches.append([*rows, rows[0], (None, rows[0][1]), (1, None)])
        every += batches[-1]
    got = rows_of(S.drain_state(S.session_changes(in_order(spark, tmp_path, batches, TURNS))))
    assert got == rows_of(S.session_changes(spark.createDataFrame(every, TURNS)))
    assert {c for _, _, c in got} == {"active", "expired", "reactivated"}


def test_exactly_the_gap_is_the_same_session(spark):
    df = spark.createDataFrame([turn(1, 0), turn(1, 30), turn(1, 60.001), turn(2, 60.1), turn(9, 500)], TURNS)
    at = int(START.replace(tzinfo=datetime.timezone.utc).timestamp()) * 10**6
    got = [(u, (t - at) / 6e7, c) for u, t, c in rows_of(S.session_changes(df)) if u != 9]
    assert got == [(1, 0, "active"), (1, 60, "expired"), (1, 60.001, "reactivated"), (1, 90.001, "expired"), (2, 60.1, "active"), (2, 90.1, "expired")]
    assert rows_of(S.session_changes(df.limit(0))) == []


def test_late_turns_are_dropped_and_counted(spark, tmp_path):
    listener = S.LateRows()
    spark.streams.addListener(listener)
    try:
        batches = [[turn(1, 0), turn(2, 5)], [turn(1, 100), turn(2, 95)], [turn(2, 99)], [turn(1, 200), turn(1, 50), turn(2, 60), turn(2, 89), turn(3, 1), turn(3, 91)]]
        got = rows_of(S.drain_state(S.session_changes(in_order(spark, tmp_path, batches, TURNS))))
        for _ in range(100):
            if listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    late = {turn(1, 50), turn(2, 60), turn(2, 89), turn(3, 1)}  # rows are late by the watermark that the batch before has used: minute 90
    rest = [r for b in batches for r in b if r not in late]
    assert got == rows_of(S.session_changes(spark.createDataFrame(rest, TURNS)))
    assert sum(listener.dropped.values()) == len(late)


def test_changes_go_on_after_a_restart(spark, tmp_path):
    path, mark, out = (f"{tmp_path}/{n}" for n in ("in", "mark", "out"))

    def run():
        with S.rocksdb(spark):
            q = S.session_changes(stream(spark, path, TURNS)).writeStream.option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/__batch={n}")).start()
        q.awaitTermination()

    first, second = [turn(1, 0), turn(2, 3), turn(1, 20)], [turn(1, 45), turn(2, 80), turn(1, 300)]
    put(spark.createDataFrame(first, TURNS), path)
    run()
    put(spark.createDataFrame(second, TURNS), path)
    run()
    assert rows_of(spark.read.parquet(out).drop("__batch")) == rows_of(S.session_changes(spark.createDataFrame(first + second, TURNS)))


def test_queue_depth_after_several_batches(spark, tmp_path):
    schema = "kb_id string, updated_at timestamp, task_id long, status string"
    rows = [(f"k{r.kb_id}", r.ts, r.event_id, r.status) for r in Tables(spark, SF).tasks.selectExpr("kb_id", "updated_at AS ts", "task_id AS event_id", "status").collect()]
    random.Random(1).shuffle(rows)
    batches = [rows[i::4] for i in range(4)]
    got = S.depth_now(S.drain_state(S.queue_depth_changes(in_order(spark, tmp_path, batches, schema))))
    assert rows_of(got) == rows_of(J.queue_depth(J.latest_status(spark.createDataFrame(rows, schema))))


def admitted(rows, limit, seconds):
    held, out = defaultdict(deque), {}
    for user, event, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        while held[user] and at - held[user][0] > datetime.timedelta(seconds=seconds):
            held[user].popleft()
        out[user, event] = len(held[user]) < limit
        if out[user, event]:
            held[user].append(at)
    return out


def test_limiter_on_all_events(spark):
    t = Tables(spark, SF)
    rows = [(r.user_id, r.event_id, r.ts) for r in t.events.collect()]
    for limit, seconds in ((2, 86400.0), (1, 3600.0), (0, 60.0)):
        got = S.limit_requests(t.events, limit, seconds).where("event_id IS NOT NULL").collect()
        assert {(r.user_id, r.event_id): r.admitted for r in got} == admitted(rows, limit, seconds) and len(got) == len(rows)


def test_limiter_carries_times_over_batches(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    rows = [(r.user_id, r.event_id, r.ts) for r in Tables(spark, SF).events.orderBy("ts").collect()]
    batches = [rows[:300], rows[300:301], rows[301:]]
    got = S.limiter_stream(in_order(spark, tmp_path, batches, schema), 2, 86400.0).collect()
    assert {(r.user_id, r.event_id): r.admitted for r in got} == admitted(rows, 2, 86400.0)


def test_limiter_with_one_client(spark):
    one = spark.range(300_000).selectExpr("7L AS user_id", "id AS event_id", "timestamp_millis(id * 10) AS ts")
    got = S.limit_requests(one, 60, 60.0).where("event_id IS NOT NULL").groupBy("admitted").count().collect()
    # 60 at once, then none until the first is over 60 s old: 60 of each 6,001 requests, which then slide on
    assert {r.admitted: r["count"] for r in got}[True] == sum(admitted([(7, i, START + datetime.timedelta(milliseconds=10 * i)) for i in range(300_000)], 60, 60.0).values())


def test_live_context_in_any_order(spark, tmp_path):
    rows = [(s, s * 100 + i, i) for s in range(3) for i in range(30 * s)]
    random.Random(2).shuffle(rows)
    schema = "session_id long, message_id long, turn long"
    got = J.drain(J.live_context(in_order(spark, tmp_path, [rows[:20], rows[20:60], rows[60:]], schema), 20), "append")
    kept = {(s, m) for s, m, _ in rows} - set(rows_of(got))
    assert kept == {(s, s * 100 + i) for s in range(3) for i in range(max(30 * s - 20, 0), 30 * s)}


def test_ingest_starts_again_after_a_stop(spark, tmp_path):
    schema = "filename string, length long, content binary"
    path, mark, out = (f"{tmp_path}/{n}" for n in ("in", "mark", "out"))

    def files(*names):
        put(spark.createDataFrame([(n, len(n or ""), (n or "").encode() * 5) for n in names], schema), path)

    seen = []

    def stops(batch):
        from kbspark.operators.versions import build_corpus

        seen.append(batch.count())
        if len(seen) == 2:  # written in part, not committed
            build_corpus(batch)[0].limit(1).write.mode("overwrite").parquet(f"{out}/__batch=1")
            raise RuntimeError("executor lost")
        return build_corpus(batch)[0]

    files("a.txt", "b.txt", "a.txt")
    S.ingest(stream(spark, path, schema), out, mark, stops)
    files("b.txt", "c.txt", "d.txt", None)
    with pytest.raises(Exception, match="executor lost"):
        S.ingest(stream(spark, path, schema), out, mark, stops)
    S.ingest(stream(spark, path, schema), out, mark)
    files("a.txt", "e.txt")
    S.ingest(stream(spark, path, schema), out, mark)
    S.ingest(stream(spark, path, schema), out, mark)
    assert sorted(r.filename for r in S.ingested(spark, out).select("filename").collect()) == ["a.txt", "b.txt", "c.txt", "d.txt", "e.txt"]
