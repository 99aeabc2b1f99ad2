"""Long series against plain numpy: causes, bootstrap, autoregressions, permutations, splines, quantile regressors."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from lodestream.operators import causal, lags, nulls, quantiles, recurrences, replicates, splines


def test_lags_and_sums_do_not_depend_on_slices(spark):
    rows = [(k, t, float((t * 7 + (0 if k is None else len(k))) % 11)) for k in ("a", "bb", None, "c") for t in range({"a": 50, "bb": 1, "c": 9}.get(k, 23))]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    series = {k: [v for kk, _, v in rows if kk == k] for k in ("a", "bb", None, "c")}
    for size in (4, 7, 1000):
        for r in lags.lagged(df, ["k"], ["t"], ["v"], 3, size=size).collect():
            v, at = series[r["k"]], r["_at"]
            assert [x and x["v"] for x in r["_lags"]] == [v[at - j] if at >= j else None for j in range(4)]
        got = lags.prefix_sums(df, ["k"], ["t"], {"s": df["v"]}, size=size).collect()
        assert len(got) == len(rows) and all(abs(r["s"] - sum(series[r["k"]][: r["t"] + 1])) < 1e-9 for r in got)


def plain_causes(x, y, most):
    n, bic, fs = len(x), {}, {}

    def rss(z, t):
        return ((t - z @ np.linalg.lstsq(z, t, rcond=None)[0]) ** 2).sum()

    for lag in range(1, min(most + 1, n // 3)):
        t = y[lag:]
        own = np.column_stack([y[lag - j : n - j] for j in range(1, lag + 1)])
        whole = np.column_stack([own, *[x[lag - j : n - j] for j in range(1, lag + 1)]])
        a, b = rss(own, t), rss(whole, t)
        bic[lag] = len(t) * np.log(b / len(t)) + 2 * lag * np.log(len(t))
        fs[lag] = ((a - b) / lag) / (b / (len(t) - 2 * lag))
    lag = min(bic, key=bic.get)
    return lag, fs[lag], bic, fs


def test_causes_on_several_lags_and_permutations(spark):
    rng = np.random.default_rng(1)
    rows, series = [], {}
    for k in ("a", "b", None):
        x, y = rng.normal(size=160), np.zeros(160)
        for t in range(2, 160):
            y[t] = 0.4 * y[t - 1] + (0.6 * x[t - 2] if k == "a" else 0) + rng.normal()
        rows += [(k, t, float(x[t]), float(y[t])) for t in range(160)]
        series[k] = x, y
    rows += [("few", t, 1.0, 2.0) for t in range(6)] + [("a", 1000, None, 1.0), ("a", 1001, float("nan"), 1.0), ("flat", 1, None, None)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y double").repartition(5)
    got = {r["k"]: r for r in causal.multilag(df, ["k"], ["t"], "x", "y", 4, 9).collect()}
    assert set(got) == {"a", "b", None, "few"} and got["few"]["lag"] is None and got["few"]["n"] == 6 and got["few"]["p"] is None
    for k, (x, y) in series.items():
        lag, f, bic, fs = plain_causes(x, y, 4)
        r = got[k]
        assert r["lag"] == lag and abs(r["f"] - f) < 1e-6 and np.allclose(r["bic"], list(bic.values())) and np.allclose(r["fs"], list(fs.values()))
        hits = 0
        for b in range(1, 10):
            order = sorted(range(160), key=lambda i, b=b: (hashlib.md5(f"42:{b}:{i}".encode()).hexdigest(), i))
            hits += plain_causes(x[order], y, 4)[3][lag] >= f
        assert abs(r["p"] - (hits + 1) / 10) < 1e-12
    assert got["a"]["lag"] == 2 and got["a"]["p"] == 0.1
    assert causal.multilag(df.where("t < 0"), ["k"], ["t"], "x", "y", 4).count() == 0


def test_cause_graph_finds_the_planted_edge(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = np.append(0, 0.9 * x[:-1]) + 0.3 * rng.normal(size=200)
    z = rng.normal(size=200)
    df = spark.createDataFrame([(n, t, float(v[t])) for n, v in (("x", x), ("y", y), ("z", z)) for t in range(200)], "name string, t long, v double")
    got = {(r["src"], r["dst"]): r["p"] for r in causal.cause_graph(df, "name", "t", "v", 1, 39, 0.03).collect()}
    assert ("x", "y") in got and ("y", "x") not in got


def test_block_bootstrap_against_drawn_rows(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=300)) * 0.3
    y = 2 * x + rng.normal(size=300)
    df = spark.createDataFrame([("a", t, float(x[t]), float(y[t])) for t in range(300)] + [("a", 999, None, 1.0)], "k string, t long, x double, y double")
    [got] = replicates.block_bootstrap(df, ["k"], ["t"], "x", "y", rounds=25).collect()

    def time(z):
        z = z - z.mean()
        n, tau, most = len(z), 1.0, min(len(z) // 2, len(z) - 2)
        rho = [float(z[: n - k] @ z[k:] / (z @ z)) if k < most else 0.0 for k in range(most + 1)]
        for k in range(1, most):
            if rho[k] <= 0 and rho[k + 1] <= 0:
                break
            tau += 2 * rho[k]
        return max(tau, 1.0)

    b = np.polyfit(x, y, 1)[0]
    tau = max(time(x), time(y), time(y - b * x))
    assert tau > 5 and abs(got["tau"] - tau) < 1e-6 and abs(got["slope"] - b) < 1e-9  # needs more lags than the first 32
    block = max(math.ceil(2 * tau), 8)
    slopes = []
    for r in range(1, 26):
        at = []
        for k in range(-(-300 // block)):
            s = int(hashlib.md5(f"42:a:{r}:{k}".encode()).hexdigest()[:15], 16) % 300
            at += [(s + j) % 300 for j in range(min(block, 300 - k * block))]
        slopes.append(np.polyfit(x[at], y[at], 1)[0])
    assert np.allclose([got["low"], got["high"]], np.percentile(slopes, [2.5, 97.5]), atol=1e-8) and got["block"] == block
    assert replicates.block_bootstrap(df.where("t < 0"), ["k"], ["t"], "x", "y").count() == 0


def test_levinson_against_a_direct_solve(spark):
    rng = np.random.default_rng(2)
    x = np.zeros(600)
    for t in range(3, 600):
        x[t] = 0.5 * x[t - 1] - 0.3 * x[t - 2] + 0.1 * x[t - 3] + rng.normal()
    df = spark.createDataFrame([("a", t, float(x[t])) for t in range(600)] + [("short", t, 1.0) for t in range(5)] + [("flat", t, 1.0) for t in range(100)], "k string, t long, v double")
    got = {r["k"]: r for r in nulls.yule_walker(df, ["k"], ["t"], "v", 5).collect()}
    z = x - x.mean()
    r = np.array([(z[: 600 - k] * z[k:]).sum() / (600 - k) for k in range(6)])
    phi = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(5)] for i in range(5)]), r[1:])
    assert np.allclose(got["a"]["phi"], phi, atol=1e-9) and abs(got["a"]["sigma2"] - (r[0] - phi @ r[1:])) < 1e-9 and got["a"]["used"] == 5
    assert got["short"]["phi"] is None and not got["flat"]["converged"]
    assert nulls.stationary(np.array([0.5])) and not nulls.stationary(np.array([1.2]))


def test_twin_series_has_the_fitted_correlation(spark):
    rng = np.random.default_rng(2)
    x = np.zeros(4000)
    for t in range(1, 4000):
        x[t] = 0.8 * x[t - 1] + rng.normal()
    df = spark.createDataFrame([("a", t, float(x[t] + 5)) for t in range(4000)], "k string, t long, v double")
    one, other = (sorted((r["_at"], r["v"]) for r in nulls.ar_surrogate(df, ["k"], ["t"], "v", 2, size=size).collect()) for size in (300, 10_000))
    assert [a for a, _ in one] == list(range(4000)) and np.allclose([v for _, v in one], [v for _, v in other], atol=1e-8)
    y = np.array([v for _, v in one])
    assert abs(y.mean() - df.agg({"v": "avg"}).first()[0]) < 1e-9 and abs(np.corrcoef(y[1:], y[:-1])[0, 1] - 0.8) < 0.06


def test_permutation_keeps_values_and_nears_the_correlation(spark):
    rng = np.random.default_rng(4)
    x = np.zeros(900)
    for t in range(1, 900):
        x[t] = 0.7 * x[t - 1] + rng.normal()
    df = spark.createDataFrame([(None, t, float(x[t])) for t in range(900)] + [("flat", t, 3.0) for t in range(40)], "k string, t long, v double")
    got = nulls.matched_permutation(df, ["k"], ["t"], "v", 4, size=300, proposals=6000).collect()
    y = np.array([r["v"] for r in sorted((r for r in got if r["k"] is None), key=lambda r: r["_at"])])
    assert np.allclose(np.sort(y), np.sort(x)) and not np.allclose(y, x)
    acf = lambda z, k: float(((z - z.mean())[:-k] * (z - z.mean())[k:]).sum() / ((z - z.mean()) ** 2).sum())
    assert max(abs(acf(y, k) - acf(x, k)) for k in range(1, 5)) < 0.08 and acf(x, 1) > 0.6
    assert [r["v"] for r in got if r["k"] == "flat"] == [3.0] * 40


def whole_spline(t, v):
    """Second derivatives from one dense system with not-a-knot ends."""
    n = len(t)
    h = np.diff(t)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-1] + h[-2]), h[-2]
    m = np.linalg.solve(a, b)

    def at(p):
        i = min(max(int(np.searchsorted(t, p, "right")) - 1, 0), n - 2)
        x, y = t[i + 1] - p, p - t[i]
        return (m[i] * x**3 + m[i + 1] * y**3) / (6 * h[i]) + (v[i] / h[i] - m[i] * h[i] / 6) * x + (v[i + 1] / h[i] - m[i + 1] * h[i] / 6) * y

    return at


def test_spline_by_slices_is_that_of_the_whole_series(spark):
    rng = np.random.default_rng(6)
    t = np.cumsum(rng.uniform(0.3, 1.7, 400))
    v = np.sin(t) + rng.normal(size=400) * 0.1
    rows = [("a", float(a), float(b)) for a, b in zip(t, v)] + [("b", 0.0, 1.0), ("b", 2.0, 5.0), ("one", 1.0, 1.0), ("c", 0.0, 0.0), ("c", 1.0, 1.0), ("c", 3.0, 9.0), ("a", None, 1.0), ("a", 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "k string, t double, v double").repartition(6)
    at = whole_spline(t, v)
    for size in (100, 150, 10_000):
        got = splines.spline_grid(df, ["k"], "t", "v", 0.25, size=size).collect()
        mine = sorted((r["nth"], r["t"], r["value"]) for r in got if r["k"] == "a")
        grid = np.arange(t[0], t[-1], 0.25)
        assert [n for n, *_ in mine] == list(range(len(grid)))
        assert max(abs(y - at(p)) for _, p, y in mine) < 1e-9
        assert [(r["t"], r["value"]) for r in sorted(got, key=lambda r: r["nth"]) if r["k"] == "b"] == [(0.25 * i, 1 + 0.5 * i) for i in range(8)]
        assert all(abs(r["value"] - r["t"] ** 2) < 1e-9 for r in got if r["k"] == "c") and not [r for r in got if r["k"] == "one"]
    beats = spark.createDataFrame([(1, i, float(b)) for i, b in enumerate(np.diff(np.append(0, t)))] + [(1, 1000, -1.0), (1, 1001, None)], "k int, i long, b double")
    got = sorted((r["nth"], r["value"]) for r in splines.beats_to_grid(beats, ["k"], ["i"], "b").collect())
    own = whole_spline(t, np.diff(np.append(0, t)))
    assert max(abs(y - own(t[0] + 0.25 * n)) for n, y in got) < 1e-9 and len(got) == len(np.arange(t[0], t[-1], 0.25))


def pinball(beta, x, y, q):
    r = y - x @ beta
    return float(np.where(r >= 0, q * r, (q - 1) * r).sum())


def test_quantile_lines_reach_the_linear_program_s_optimum(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 10, 41)
    y = 3 + 0.5 * x + rng.normal(size=41) * (0.5 + 0.2 * x)
    rows = [(float(a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows + [(None, 1.0), (1.0, None), (float("inf"), 2.0)], "x double, y double")
    m = quantiles.fit_quantiles(df, ["x"], "y", passes=90)
    design = np.column_stack([np.ones(41), x])
    for q, beta in zip(m.quantiles, m.coefficients, strict=True):
        # the optimum passes through two points
        best = min((pinball(b, design, y, q), tuple(b)) for i, j in itertools.combinations(range(41), 2) for b in [np.linalg.solve(design[[i, j]], y[[i, j]])])
        assert pinball(np.array(beta), design, y, q) <= best[0] * (1 + 1e-4)
        assert np.allclose(beta, best[1], atol=0.02)
    p = m.predict(df).collect()
    assert all(r["low"] <= r["mid"] <= r["high"] for r in p)
    outside = quantiles.coverage(m.predict(df.where("x IS NOT NULL")), [], "y").first()
    assert outside["n"] == 42 and 0.1 <= outside["below"] <= 0.25 and 0.1 <= outside["above"] <= 0.25
    assert quantiles.fit_quantiles(df.where("x > 99 AND x < 100"), ["x"], "y") is None
    crossing = quantiles.QuantileModel(("x",), (0.2, 0.5, 0.8), ((0.0, 1.0), (1.0, 0.0), (2.0, -1.0)), 1)
    assert [tuple(r[c] for c in ("low", "mid", "high")) for r in crossing.predict(spark.createDataFrame([(0.0, 1.0), (5.0, 1.0)], "x double, y double")).collect()] == [(0.0, 1.0, 2.0), (-3.0, 1.0, 5.0)]


@pytest.mark.parametrize("size", [3, 5, 8])
def test_slopes_follow_cubics(size):
    t = np.cumsum(np.arange(1, size + 1) ** 0.5)
    k = splines.slopes(t, t**2, True, True)
    assert np.allclose(k, 2 * t)


def test_recurrence_against_the_whole_matrix(spark):
    rng = np.random.default_rng(9)
    series = {"wave": np.sin(np.arange(90) * 0.4) + rng.normal(size=90) * 0.05, None: np.round(rng.normal(size=60), 1), "flat": np.ones(30)}
    df = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)] + [("few", t, 1.0) for t in range(9)] + [("wave", 500, None)], "k string, t long, v double").repartition(4)
    got = {r["k"]: r for r in recurrences.recurrence_quantification(df, ["k"], ["t"], "v", 2, 3, 0.3).collect()}
    assert set(got) == set(series)
    for k, x in series.items():
        p = np.column_stack([x[:-4], x[2:-2], x[4:]])
        n = len(p)
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        eps = max(0.3 * np.percentile(d[:: max(1, n // 50)].ravel(), 95), 1e-10)
        m = (d < eps).astype(int)
        np.fill_diagonal(m, 0)
        runs = lambda line: [len(list(g)) for v, g in itertools.groupby(line) if v]
        diagonal = [c for o in range(1, n) for c in runs(np.diag(m, o)) if c > 1]
        vertical = [c for j in range(n) for c in runs(m[:, j]) if c > 1]
        share = np.array(diagonal) / max(1, sum(diagonal))
        want = (eps, m.sum() / (n * (n - 1)), sum(diagonal) / m.sum(), sum(vertical) / m.sum(), -float((share * np.log2(share + 1e-15)).sum()))
        assert np.allclose([got[k][c] for c in ("eps", "rr", "det", "lam", "ent")], want, atol=1e-9), k


def test_quantile_lines_of_many_rows_need_passes_over_those_near_a_line_only(spark, monkeypatch):
    df = spark.range(6000).selectExpr("id % 7 AS a", "2.0 + id % 7 + sin(id * 0.37) * (1 + id % 7) + (id * 7919 % 1000) / 500.0 AS y")
    seen = []
    totals = quantiles.totals
    monkeypatch.setattr(quantiles, "totals", lambda z, *rest: seen.append(len(z.inputFiles()) and z.count()) or totals(z, *rest))
    rows = df.toPandas()
    design, y = np.column_stack([np.ones(6000), rows["a"]]), rows["y"].to_numpy()
    qs = (0.2, 0.5, 0.8)
    full, _ = quantiles.settled(lambda c, eps: quantiles.sums_of(design, y, c, qs, eps), np.zeros((3, 2)), 6000, 80, 1e-9, 1.0)
    few = quantiles.fit_quantiles(df, ["a"], "y", qs, sample=1100, share=0.2, passes=30)
    assert seen.count(6000) <= 10 and 0 < max(n for n in seen if n < 6000) < 5000
    for q, a, b in zip(qs, full, few.coefficients, strict=True):
        assert pinball(np.array(b), design, y, q) <= pinball(a, design, y, q) * (1 + 1e-4)
    # a band too narrow for the first lines: all rows are passed over
    seen.clear()
    narrow = quantiles.fit_quantiles(df, ["a"], "y", qs, sample=30, share=0.002, looks=1, passes=20)
    assert seen.count(6000) > 10
    for q, a, b in zip(qs, full, narrow.coefficients, strict=True):
        assert pinball(np.array(b), design, y, q) <= pinball(a, design, y, q) * (1 + 1e-4)


def test_lag_products_over_slices_against_whole_series(spark):
    rng = np.random.default_rng(8)
    series = {None: rng.normal(size=23), "a": rng.normal(size=1), "b": rng.normal(size=40)}
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    for size in (7, 1000):
        got = {(r["k"], r["lag"]): r["v"] for r in lags.lag_products(df, ["k"], ["t"], ["v"], 5, size=size).collect()}
        want = {(k, n): float(x[: len(x) - n] @ x[n:]) for k, x in series.items() for n in range(min(5, len(x) - 1) + 1)}
        assert got.keys() == want.keys() and all(abs(got[at] - want[at]) < 1e-9 for at in want)
