"""Recurrences carried along series, and what keyed streams keep, against plain Python."""

import math

from pyspark.sql import functions as F

from lodestream.operators import folds
from lodestream.streaming import jobs, keyed


def test_fold_carries_state_over_batches_and_keys(spark):
    rows = [(k, i, float(i % 7)) for k in ("a", None, "c") for i in range(40)] + [("one", 0, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        step = lambda s, v: (s + (v or 0.0), (s + (v or 0.0),))
        last = folds.streamed_fold(df, ["k"], ["i"], {"v": F.col("v")}, "total double", lambda: 0.0, step).collect()
        each = folds.streamed_fold(df, ["k"], ["i"], {"v": F.col("v")}, "total double", lambda: 0.0, step, each=True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    total = sum(float(i % 7) for i in range(40))
    assert sorted(map(tuple, last), key=str) == sorted([("a", total), (None, total), ("c", total), ("one", 0.0)], key=str)
    assert len(each) == 121 and all(r["total"] == sum(float(j % 7) for j in range(r["i"] + 1)) for r in each if r["k"] != "one")
    assert folds.streamed_fold(df.where("i < 0"), ["k"], ["i"], {"v": F.col("v")}, "total double", lambda: 0.0, step).count() == 0


def test_release_frees_for_a_later_reservation(spark):
    log = [("reserve", 1, 60.0, 0.0), ("reserve", 2, 60.0, 0.0), ("release", 1, None, None), ("reserve", 2, 60.0, 0.0), ("reserve", 2, 1.0, 0.0), ("commit", 2, None, None), ("commit", 2, None, None), ("release", 9, None, None), ("reserve", 3, 41.0, 0.0), ("reserve", 4, 40.0, 99.0), ("reserve", 5, -1.0, 0.0)]
    df = spark.createDataFrame([("b", i, *e) for i, e in enumerate(log)], "book string, i long, act string, id long, b double, q double")
    got = sorted(folds.reservation_log(df, ["book"], ["i"], "act", "id", "b", "q", 100.0, 50.0).collect(), key=lambda r: r["i"])
    assert [r["status"] for r in got] == ["reserved", "refused", "released", "reserved", "refused", "committed", "refused", "unknown", "refused", "refused", "refused"]
    assert (got[-1]["base"], got[-1]["base_reserved"], got[-1]["quote"], got[-1]["quote_reserved"]) == (40.0, 0.0, 50.0, 0.0)


def test_value_series_with_novelty(spark):
    rets, news = [0.5, -0.2, 0.0, 1.0, None], [0.0, 5.0, 0.0, 2.0, 0.0]
    df = spark.createDataFrame([("k", i, r, n) for i, (r, n) in enumerate(zip(rets, news))], "k string, i long, r double, n double")
    got = sorted(folds.value_series(df, ["k"], ["i"], "r", F.col("n")).collect(), key=lambda r: r["i"])
    v = tonic = 0.0
    for row, r, n in zip(got, rets, news, strict=True):
        r = r or 0.0
        rpe = r + 0.99 * v - v
        v += 0.1 * rpe
        phasic = min(2.0, max(0.0, rpe) * 2)
        tonic = min(1.0, max(0.0, tonic + 0.05 * (max(0.0, r + 0.1 * n) + phasic - tonic)))
        assert (row["rpe"], row["phasic"], row["tonic"]) == (rpe, phasic, tonic) and abs(row["level"] - 1 / (1 + math.exp(-5 * (tonic - 0.5)))) < 1e-12


def test_percentiles_of_the_last_samples(spark):
    vals = [float(i * 37 % 101) for i in range(120)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(vals)] + [("k", 500, None)], "k string, i long, v double")
    got = {r["i"]: r["p"] for r in folds.rolling_percentile(df, ["k"], ["i"], "v", 0.9, samples=16).collect()}
    w = keyed.Window(16)
    for i, v in enumerate(vals):
        w.add(v)
        last = sorted(vals[max(0, i - 15) : i + 1])
        at = 0.9 * (len(last) - 1)
        want = last[int(at)] + (last[min(int(at) + 1, len(last) - 1)] - last[int(at)]) * (at - int(at))
        assert abs(got[i] - want) < 1e-12 and abs(w.percentile(0.9) - want) < 1e-12
    assert got[500] == got[119] and keyed.Window(4).percentile(0.5) is None


def test_book_takes_snapshots_and_ignores_what_is_old():
    b = keyed.Book()
    b.take(5, False, [("bid", 1.0, 2.0)])
    assert not b.levels and b.stale == 1  # no snapshot yet
    b.take(6, True, [("bid", 1.0, 2.0), ("ask", 3.0, 4.0)])
    b.take(7, False, [("bid", 1.0, 0.0), ("bid", 0.9, 5.0)])
    b.take(7, False, [("bid", 0.9, 9.0)])
    b.take(10, False, [("ask", 3.0, 1.0)])
    assert b.levels == {("bid", 0.9): 5.0, ("ask", 3.0): 1.0} and (b.stale, b.gaps, b.seq) == (2, 1, 10)
    b.changed.clear()
    b.take(20, True, [("ask", 8.0, 1.0)])
    assert b.levels == {("ask", 8.0): 1.0} and b.changed == {("bid", 0.9): 0.0, ("ask", 3.0): 0.0, ("ask", 8.0): 1.0}


def test_latency_state_drops_the_oldest_over_batches(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(90)] + [("k", 200, None)], "k string, i long, v double").withColumn("ts", F.timestamp_seconds("i"))
    out = jobs.drain(keyed.latency_windows(jobs.feed(df, "ts", files=6, batches=3), "k", "ts", "i", "v", samples=10), "update", jobs.ROCKS).collect()
    last = max(out, key=lambda r: r["seen"])
    assert len({r["batch"] for r in out}) == 3 and (last["seen"], last["n"], last["p50"], last["most"], last["mean"]) == (90, 10, 84.5, 89.0, 84.5)
