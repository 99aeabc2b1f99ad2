"""Contracts on small literals: nulls, ties, gaps, leakage, resampling properties."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators import clean, folds, joins, modelling, resample, stats
from lodestream.operators.primitives import asof, asof_sliced, global_position, islands

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_asof_takes_the_last_value_and_hides_what_was_not_known(spark):
    market = spark.createDataFrame([(1, at(10)), (1, at(100)), (2, at(50)), (1, None)], "k int, ts timestamp")
    macro = spark.createDataFrame([(1, at(5), at(50), 1.0), (1, at(100), at(100), 2.0), (2, at(60), at(60), 3.0)], "k int, period timestamp, available timestamp, v double")
    out = {(r["k"], r["ts"]): r["v"] for r in joins.join_without_leakage(market, macro, ["k"], "ts", "period", "available", ["v"]).collect()}
    assert out == {(1, at(10)): None, (1, at(100)): 2.0, (2, at(50)): None, (1, None): None}
    free = {(r["k"], r["ts"]): r["v"] for r in joins.join_without_leakage(market, macro, ["k"], "ts", "period", "available", ["v"], allow_future=True).collect()}
    assert free[(1, at(10))] == 1.0
    cut = {(r["k"], r["ts"]): r["v"] for r in asof_sliced(market.where("ts IS NOT NULL"), macro, ["k"], "ts", "period", ["v"], 30).collect()}
    whole = {(r["k"], r["ts"]): r["v"] for r in asof(market.where("ts IS NOT NULL"), macro, ["k"], "ts", "period", ["v"]).collect()}
    assert cut == whole
    ahead = {(r["k"], r["ts"]): r["v"] for r in asof(market.where("ts IS NOT NULL"), macro, ["k"], "ts", "period", ["v"], "forward").collect()}
    assert ahead == {(1, at(10)): 2.0, (1, at(100)): 2.0, (2, at(50)): 3.0}


def test_bars_without_sizes_have_no_volume(spark):
    t = spark.createDataFrame([("a", at(1), 1, 5.0, None), ("a", at(2), 2, 7.0, None), ("a", at(61), 3, 6.0, 2.0), ("a", at(62), 4, None, 9.0)], "s string, ts timestamp, id int, p double, size double")
    out = {r["bucket"]: r for r in resample.bars(t, 60, ["s"], "ts", "id", "p", "size").collect()}
    assert (out[T0]["open"], out[T0]["close"], out[T0]["volume"]) == (5.0, 7.0, None)
    assert out[at(60)]["volume"] == 2.0 and out[at(60)]["n"] == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(1, 50)), min_size=1, max_size=40))
def test_resampling_keeps_volume_and_bounds(spark, ticks):
    df = spark.createDataFrame([("a", at(s), i, float(p), float(p)) for i, (s, p) in enumerate(ticks)], "s string, ts timestamp, id int, p double, v double")
    small = resample.bars(df, 60, ["s"], "ts", "id", "p", "v")
    wide = resample.coarser_bars(small, 600, ["s"]).collect()
    direct = {r["bucket"]: r for r in resample.bars(df, 600, ["s"], "ts", "id", "p", "v").collect()}
    assert sum(r["volume"] for r in wide) == sum(p for _, p in ticks)
    for r in wide:
        d = direct[r["bucket"]]
        assert all(r[c] == d[c] for c in ("open", "high", "low", "close", "volume", "n")) and r["low"] <= min(r["open"], r["close"]) <= r["high"]


def test_interpolation_goes_by_position_and_takes_nearest_at_the_ends(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "k string, i int, v double")
    assert [r["v"] for r in resample.interpolate(df, ["k"], ["i"], ["v"]).orderBy("i").collect()] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_gaps_are_half_open(spark):
    df = spark.createDataFrame([("a", at(60 * m)) for m in (0, 1, 4, 5, 9)], "k string, ts timestamp")
    assert [(r["start"], r["end"], r["buckets"]) for r in resample.gaps(df, ["k"], "ts", 60).orderBy("start").collect()] == [(at(120), at(240), 2), (at(360), at(540), 3)]


def test_quality_gate_names_every_reason(spark):
    df = spark.createDataFrame([("a", at(i), i, v) for i, v in enumerate([100.0, 101.0, 99.0, 100.0, 101.0, 500.0])] + [("a", at(5), 6, 100.0)], "k string, ts timestamp, id int, v double")
    out = {r["id"]: r["reasons"] for r in clean.quality_gate(df, ["k"], "ts", "id", "v", 5, 3.0, 0.0, 400.0).collect()}
    assert out[5] == ["spike", "range"] and out[6] == ["duplicate"] and out[0] == []


def test_scaling_constant_and_null(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, 2.0), (3, 5.0, 4.0)], "i int, a double, b double")
    assert [(r["a"], r["b"]) for r in clean.scale(df, ["a", "b"]).orderBy("i").collect()] == [(0.0, None), (0.0, -1.0), (0.0, 1.0)]


def test_purged_folds_are_disjoint_and_purged(spark):
    df = spark.createDataFrame([(i, i + 3) for i in range(23)], "i int, end int")
    out = modelling.purged_folds(df, ["i"], "end", 4, 2).collect()
    for f in range(4):
        test = sorted(r["pos"] for r in out if r["fold"] == f and r["role"] == "test")
        train = [r["pos"] for r in out if r["fold"] == f and r["role"] == "train"]
        assert test == list(range(test[0], test[-1] + 1)) and not set(test) & set(train)
        assert all(p + 3 <= test[0] - 0 or p > test[-1] + 2 for p in train)
    assert sorted(r["pos"] for r in out if r["role"] == "test") == list(range(23))


def test_global_position_numbers_all_rows_once(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [r["pos"] for r in global_position(df, ["x"]).orderBy("x").collect()] == list(range(1000))


def test_islands_and_average_cost(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate("xxyyx")], "k string, i int, v string")
    from pyspark.sql import Window

    out = islands(df, ["k"], ["i"], F.col("v") != F.lag("v").over(Window.partitionBy("k").orderBy("i")))
    assert [r["island"] for r in out.orderBy("i").collect()] == [0, 0, 1, 1, 2]
    fills = spark.createDataFrame([("s", 1, 10.0, 2.0), ("s", 2, 20.0, 2.0), ("s", 3, 30.0, -1.0), ("s", 4, 5.0, -5.0)], "s string, i int, p double, q double")
    r = folds.average_cost(fills, ["s"], ["i"], "p", F.col("q")).first()
    assert (r["pos"], r["cost"], r["pnl"]) == (-2.0, 5.0, 15.0 - 30.0)


def test_corrections_by_hand(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "f string, i int, p double")
    out = {r["i"]: r for r in stats.corrected(df, ["f"], "p", "i").collect()}
    assert [round(out[i]["holm"], 6) for i in range(4)] == [0.04, 0.09, 0.09, 0.5]
    assert [round(out[i]["bh"], 6) for i in range(4)] == [0.04, 0.053333, 0.053333, 0.5]


def test_exponent_of_an_exact_power_law(spark):
    df = spark.createDataFrame([("k", i, float(i), float(i) ** -1.1) for i in range(1, 60)], "k string, i int, x double, y double")
    r = stats.theil_sen(df, ["k"], "i", "x", "y").first()
    assert abs(r["gamma"] - 1.1) < 1e-9 and r["verdict"] == "METASTABLE"


def test_plans_stay_on_the_jvm_and_prune_columns(spark):
    from lodestream.plans import registry

    data = "/root/testdata/sf0.001"
    plan = registry.QUERIES["t2_ohlcv_bars"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "props" not in plan


def test_slices_of_a_shuffle_meet_as_the_whole_shuffle_does(spark):
    df = spark.range(700).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS k", "id", "CASE WHEN id % 50 > 0 THEN CAST(id * id % 101 AS double) END AS v")
    whole = stats.autocovariances(stats.shuffled(df, ["k"], ["id"], "id", "v", 5), ["k", "round"], ["i"], "v", 1)
    want = {(r["k"], r["round"]): r["rho"] for r in whole.collect()}
    for bits in (1, 3, 9):  # some slices, and more than there are rows
        got = {(r["k"], r["round"]): r["rho"] for r in stats.shuffled_autocovariances(df, ["k"], "id", "v", 5, bits=bits).collect()}
        assert got.keys() == want.keys() and len(got) == 10
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
