"""Slopes of series that are too long for all pairs, against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from lodestream.operators import stats


def brute(x, y):
    i, j = np.triu_indices(len(x), 1)
    k = x[i] != x[j]
    return np.median((y[j] - y[i])[k] / (x[j] - x[i])[k])


def test_bisected_slope_is_that_of_all_pairs():
    rng = np.random.default_rng(3)
    for n in (2, 3, 7, 64, 401, 900):
        for values in (3, 97, 10**6):
            x = np.log(1.0 + rng.integers(0, values, n))
            y = np.round(x * rng.normal() + rng.normal(size=n), int(rng.integers(0, 4)))
            if len(set(x)) > 1:
                assert abs(stats.median_pair_slope(x, y, direct=0) - brute(x, y)) < 1e-9
    assert stats.median_pair_slope(np.ones(900), np.arange(900.0)) is None


def test_theil_sen_uses_every_row_of_a_long_series(spark):
    d = spark.range(2500).select(F.lit(1).alias("k"), "id", (1.0 + F.col("id") % 97).alias("x"), (1.0 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0 + F.col("id") % 97).alias("y"))
    got = stats.theil_sen(d, ["k"], "id", "x", "y").first()
    p = d.toPandas()
    x, y = np.log(p["x"].to_numpy()), np.log(p["y"].to_numpy())
    m = brute(x, y)
    rest = y - np.median(y) - m * (x - np.median(x))  # from the line through the medians
    assert got["used"] == 2500 and abs(got["gamma"] + m) < 1e-9 and abs(got["r2"] - (1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_slope_of_many_points_takes_few_passes(monkeypatch):
    rng = np.random.default_rng(5)
    e, v = rng.integers(0, 10**6, 20_000), np.round(rng.exponential(50, 20_000), 2)
    x, y = np.log(1.0 + e % 97), np.log(v * 0.1 + 1.0 + e % 97)
    passes, count = [], stats._inversions
    monkeypatch.setattr(stats, "_inversions", lambda rank: passes.append(1) or count(rank))
    got = stats.median_pair_slope(x, y)
    assert len(passes) < 20
    # against all pairs, by counting: as many slopes below as above
    below = sum(int(((y[i + 1 :] - y[i] - got * (x[i + 1 :] - x[i])) * np.sign(x[i + 1 :] - x[i]) < 0).sum()) for i in range(0, 20_000))
    n = (20_000**2 - int((np.unique(x, return_counts=True)[1].astype(np.int64) ** 2).sum())) // 2
    assert abs(below - n / 2) <= 2


def test_slopes_of_two_heaps_and_of_one():
    x = np.repeat([0.0, 1.0], [1, 4000])
    y = np.append(0.0, np.repeat([0.0, 1.0], 2000))  # half of the slopes are 0, half are 1
    assert abs(stats.median_pair_slope(x, y) - 0.5) < 1e-12
    x = np.log(1.0 + np.arange(3000) % 97)
    assert abs(stats.median_pair_slope(x, 2 * x + 1) - 2) < 1e-12


def test_inversions_are_counted_pair_by_pair():
    rng = np.random.default_rng(6)
    for n in (1, 2, 31, 32, 33, 64, 65, 129, 700):
        r = rng.permutation(n)
        assert stats._inversions(r) == sum(int((r[:i] > r[i]).sum()) for i in range(n))
