"""Tests and intervals of any statistic, against plain Python."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from lodestream.functions import special
from lodestream.operators import resampling as R


def test_tails_against_integrals():
    for dof in (1, 2, 3.7, 12, 250):
        for t in (0.0, 0.3, 1.1, 2.5, 6.0):
            x = np.linspace(-1, 1, 400_001)[1:-1]
            u = x / (1 - x * x)  # the whole line
            density = np.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * (1 + u * u / dof) ** (-(dof + 1) / 2)
            weight = density * (1 + x * x) / (1 - x * x) ** 2
            tail = float(weight[np.abs(u) >= t].sum() * (x[1] - x[0]))
            assert abs(special.t_two_sided(np.array([t]), np.array([dof]))[0] - tail) < 2e-4
    assert abs(special.t_two_sided(np.array([12.706204736]), np.array([1.0]))[0] - 0.05) < 1e-9  # a tabled quantile
    assert abs(special.normal_two_sided(np.array([1.959963984540054]))[0] - 0.05) < 1e-12 and np.isnan(special.t_two_sided(np.array([np.nan]), np.array([3.0]))[0])


def table(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, bool(i % 3 == 0), float(round(rng.normal() + (1.0 if i % 3 == 0 and k == "a" else 0), 1))) for k in ("a", "b", None) for i in range(60)]
    return rows, spark.createDataFrame(rows + [("a", 900, None, 1.0), ("a", 901, True, None), ("c", 1, True, 1.0)], "k string, i long, g boolean, v double").repartition(5)


def test_one_sample_and_two_samples(spark):
    rows, df = table(spark)
    got = {r["k"]: r for r in R.one_sample_t(df, ["k"], "v", 0.2).collect()}
    x = np.array([v for k, _, _, v in rows if k == "b"])
    t = (x.mean() - 0.2) / (x.std(ddof=1) / math.sqrt(60))
    assert abs(got["b"]["t"] - t) < 1e-9 and got["b"]["dof"] == 59 and abs(got["b"]["p"] - special.t_two_sided([t], [59])[0]) < 1e-12
    assert got["c"]["t"] is None and got["c"]["p"] is None and got["a"]["n"] == 61
    two = {r["k"]: r for r in R.two_sample_p(df.where("g IS NOT NULL"), ["k"], F.col("g"), "v").collect()}
    a, b = ([v for k, _, g, v in rows if k == "b" and g is side] for side in (True, False))
    u = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    every = sorted(a + b)
    ties = sum(every.count(v) ** 3 - every.count(v) for v in set(every))
    sd = math.sqrt(len(a) * len(b) / 12 * (61 - ties / (60 * 59)))
    z = math.copysign(max(0, abs(u - len(a) * len(b) / 2) - 0.5), u - len(a) * len(b) / 2) / sd
    assert two["b"]["u"] == u and abs(two["b"]["z"] - z) < 1e-9 and abs(two["b"]["p_u"] - math.erfc(abs(z) / math.sqrt(2))) < 1e-9
    assert two["a"]["p_t"] < 0.01 and two["a"]["p_u"] < 0.01


def test_permutations_of_a_given_statistic(spark):
    rows, df = table(spark)

    def ratio(v, first, w):
        return F.sum(F.when(first, v * v).otherwise(0.0)) / F.sum(v * v) - 1 / 3

    for statistic, plain in ((R.mean_difference, lambda a, b: np.mean(a) - np.mean(b)), (ratio, lambda a, b: sum(x * x for x in a) / sum(x * x for x in a + b) - 1 / 3)):
        got = {r["k"]: r for r in R.permutation_test(df, ["k"], "i", "g", "v", statistic, rounds=29).collect()}
        assert set(got) == {"a", "b", None}
        for k in got:
            mine = [(i, g, v) for kk, i, g, v in rows if kk == k]
            seen = plain([v for _, g, v in mine if g], [v for _, g, v in mine if not g])
            hits = 0
            for b in range(1, 30):
                o = sorted(mine, key=lambda r, b=b: (hashlib.md5(f"42:{b}:{r[0]}".encode()).hexdigest(), r[0]))
                hits += abs(plain([v for *_, v in o[:20]], [v for *_, v in o[20:]])) >= abs(seen)
            assert abs(got[k]["statistic"] - seen) < 1e-9 and got[k]["extreme"] == hits and abs(got[k]["p"] - (hits + 1) / 30) < 1e-12
    assert got["a"] is not None


def test_bootstrap_of_standardised_differences(spark):
    rows, df = table(spark)
    got = {r["k"]: r for r in R.bootstrap_interval(df, ["k"], "i", "g", "v", rounds=150).collect()}
    for k in ("a", "b"):
        a, b = (np.array([v for kk, _, g, v in rows if kk == k and g is side]) for side in (True, False))
        d = (a.mean() - b.mean()) / math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / 58)
        assert abs(got[k]["point"] - d) < 1e-9 and got[k]["low"] < d < got[k]["high"] and 0.5 < got[k]["high"] - got[k]["low"] < 2
    assert "c" not in got and got["a"]["low"] > 0
