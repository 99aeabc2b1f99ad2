"""Contrasts of series on small literals."""

import math

from lodestream.operators import contrasts as C
from lodestream.operators.search import uniform
from lodestream.operators.stats import poisson_weight


def test_bootstrap_difference_holds_the_difference(spark):
    rows = [(i, i % 2 == 0, float(i % 7) + (3.0 if i % 2 == 0 else 0.0)) for i in range(400)] + [(900, None, 1.0), (901, True, None)]
    df = spark.createDataFrame(rows, "id long, g boolean, v double").selectExpr("'a' AS k", "*")
    [got] = C.bootstrap_difference(df, ["k"], "id", "g", "v").collect()
    mean = lambda side: sum(v for _, g, v in rows if g is side and v is not None) / sum(1 for _, g, v in rows if g is side and v is not None)
    assert abs(got["difference"] - (mean(True) - mean(False))) < 1e-9
    assert got["low"] < got["difference"] < got["high"] and got["high"] - got["low"] < 1.2
    assert C.bootstrap_difference(df.where("id < 0"), ["k"], "id", "g", "v").count() == 0


def test_coherence_of_equal_series_is_one(spark):
    df = spark.createDataFrame([("a", i, math.sin(i * 0.7) + (i * 37 % 11) / 5, (i * 53 % 17) / 3.0) for i in range(320)], "k string, i long, x double, z double")
    same = C.coherence(df, ["k"], ["i"], "x", "x").collect()
    assert len(same) == 33 and all(abs(r["coherence"] - 1) < 1e-9 and r["segments"] == 9 for r in same)
    assert all(0 <= r["coherence"] <= 1 for r in C.coherence(df, ["k"], ["i"], "x", "z").collect())
    assert C.coherence(df.where("i < 64"), ["k"], ["i"], "x", "z").count() == 0


def test_null_fidelity_of_the_series_itself_is_zero(spark):
    df = spark.createDataFrame([("a", i, float(i * 7 % 13)) for i in range(60)], "k string, i long, x double").selectExpr("*", "x AS y", "x + 2 AS z")
    [own] = C.null_fidelity(df, ["k"], ["i"], "x", "y", 5).collect()
    [off] = C.null_fidelity(df, ["k"], ["i"], "x", "z", 5).collect()
    assert own["acf_rmse"] < 1e-12 and own["distribution_error"] == 0
    assert off["acf_rmse"] < 1e-12 and off["distribution_error"] == 2


def test_a_draw_of_the_bootstrap_is_hashed_once_and_gives_the_weights_of_its_cuts(spark):
    df = spark.range(5000).selectExpr("'a' AS k", "id", "id % 2 = 0 AS g", "CAST(id % 7 AS double) AS v")
    d = df.withColumn("u", uniform(7, "id"))
    cuts = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    assert all(r["w"] == sum(r["u"] > c for c in cuts) for r in d.withColumn("w", poisson_weight("u")).collect())
    plan = C.bootstrap_difference(df, ["k"], "id", "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1
