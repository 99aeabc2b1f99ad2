"""The event-time backlog: one key's board step by step, and a stream of several batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestream.streaming import backlog, jobs
from lodestream.streaming.backlog import EXPIRED, IN_ORDER, LATE, Board

S = 1_000_000


def test_rows_wait_for_the_slowest_source():
    b = Board(2 * S, 6 * S, 100 * S)
    out = []
    for source, event, arrival, row in (("alpha", 2, 3, 1), ("beta", 1, 3, 2), ("alpha", 5, 6, 3), ("beta", -10, 7, 4), ("beta", 4, 8, 5)):
        out += b.observe(source, event * S, arrival * S, row)
    # beta is at 4, so 2 may go; -10 is over six seconds behind the watermark of -1
    assert out == [(4, EXPIRED, None), (2, IN_ORDER, 1), (1, IN_ORDER, 2)] and b.watermark == 2 * S
    assert sorted(b.waiting) == [(4 * S, 5), (5 * S, 3)]


def test_idle_sources_are_not_waited_for():
    b = Board(1 * S, 5 * S, 5 * S)
    assert b.observe("alpha", 0, 0, 1) == [] and b.observe("beta", 0, 0, 2) == []
    assert [r for r, *_ in b.observe("alpha", 10 * S, 10 * S, 3)] == [1, 2]
    assert b.observe("alpha", 12 * S, 12 * S, 4) == [(3, IN_ORDER, 3)] and b.watermark == 11 * S
    # a source that comes back holds nothing up that has gone; what it brings late is marked
    assert b.observe("beta", 9 * S, 13 * S, 5) == [(5, LATE, 4)] and b.watermark == 11 * S
    assert b.wake() == 17 * S
    # with all sources idle everything goes
    assert b.clock(40 * S) == [(4, IN_ORDER, 5)] and b.wake() is None


def test_positions_rise_and_event_times_rise_in_order():
    b, out = Board(3 * S, 60 * S, 1000 * S), []
    for i in range(200):
        out += b.observe("abc"[i % 3], (i + (i * 7) % 5) * S, i * S, i)
    assert [p for *_, p in out] == list(range(1, len(out) + 1)) and len(out) > 150
    times = [(i + (i * 7) % 5) for i, s, _ in out if s == IN_ORDER]
    assert times == sorted(times)


def test_stream_of_several_batches_is_the_board_run_row_by_row(spark):
    base = datetime(2024, 1, 1)
    rows = []
    for k in ("a", "b", "quiet"):
        for i in range(60 if k != "quiet" else 5):
            arrival = i * 60 + len(k)
            rows.append((k, f"s{i % 3}" if i % 11 else None, base + timedelta(seconds=arrival - (i * 7) % 90 - (0, 400, 900)[i % 13 % 3 if i % 13 < 3 else 0]), base + timedelta(seconds=arrival), len(rows)))
    rows += [("a", "s1", None, base, 900), ("a", "s1", base, None, 901)]
    df = spark.createDataFrame(rows, "k string, s string, ts timestamp, arrival timestamp, row long")
    stream = backlog.released(jobs.feed(df, "arrival", files=6, batches=3), "k", "s", "ts", "arrival", "row", "2 minutes", "3 minutes", "20 minutes", "1 minute")
    got = sorted(map(tuple, jobs.drain(stream, provider=jobs.ROCKS).select("k", "row", "status", "position").collect()), key=str)
    micros = {r["row"]: (r["e"], r["a"]) for r in df.select("row", F.unix_micros("ts").alias("e"), F.unix_micros("arrival").alias("a")).collect()}
    want = []
    last = max(a for _, a in micros.values() if a is not None)
    for k in ("a", "b", "quiet"):
        b = Board(120 * S, 180 * S, 1200 * S)
        out = []
        for r in sorted((r for r in rows if r[0] == k and r[4] < 900), key=lambda r: (r[3], r[4])):
            out += b.observe(r[1] or "", *micros[r[4]], r[4])
        out += b.clock(last - 60 * S)
        want += [(k, *x) for x in out]
    assert got == sorted(want, key=str)
    # the quiet key's rows go once its sources are idle
    assert [r[1] for r in got if r[0] == "quiet" and r[2] != EXPIRED] and {r[2] for r in got} == {IN_ORDER, LATE, EXPIRED}


def test_feed_keeps_the_order_and_all_rows(spark):
    df = spark.createDataFrame([(i * 13 % 101, i) for i in range(101)] + [(None, 500)], "t long, i long")
    seen = []
    stream = jobs.feed(df, "t", files=5, batches=5)
    q = stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(-1 if r["t"] is None else r["t"] for r in b.collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    flat = [x for s in seen for x in s]
    assert flat == sorted(flat) and len(flat) == 102 and len(seen) >= 3
