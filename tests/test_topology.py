"""Graphs, fields and units against plain Python."""

import math
import random
from collections import Counter, deque

import numpy as np

from lodestream.operators import assemblies, fields, topology


def kruskal(edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    out = []
    for w, a, b in sorted(edges):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b, w))
    return sorted(out)


def test_forest_with_ties_against_kruskal(spark):
    rng = random.Random(1)
    for n, m, weights in ((12, 30, 3), (60, 90, 1000), (40, 25, 2)):
        rows = [(rng.randrange(n), rng.randrange(n), float(rng.randrange(weights))) for _ in range(m)]
        rows += [(1, 2, None), (2, 3, float("nan")), (4, 4, -5.0)]
        best = {}
        for a, b, w in rows:
            if a != b and w is not None and w == w:
                k = (min(a, b), max(a, b))
                best[k] = min(best.get(k, w), w)
        got = topology.spanning_forest(spark.createDataFrame(rows, "a long, b long, weight double")).collect()
        assert sorted(map(tuple, got)) == kruskal([(w, a, b) for (a, b), w in best.items()])
    chain = [(i, i + 1, 1.0) for i in range(70)]  # equal weights all along
    assert topology.spanning_forest(spark.createDataFrame(chain, "a long, b long, weight double")).count() == 70
    assert topology.spanning_forest(spark.createDataFrame([], "a long, b long, weight double")).count() == 0


def test_curve_and_score(spark):
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.2), (1, 3, 0.2), (4, 5, 0.3), (3, 4, 0.9)], "a long, b long, weight double")
    curve = topology.threshold_curve(edges, 6, [0.05, 0.2, 0.4])
    got = {r["threshold"]: tuple(r)[1:] for r in curve.collect()}
    assert got[0.05] == (0, 6, 12, 0.0) and got[0.2][:3] == (3, 4, 7) and got[0.4][:3] == (4, 3, 5)
    bars = [0.0, 0.2 - 0.5 / 3, 0.4 - 0.8 / 4]
    assert all(abs(got[t][3] - b) < 1e-12 for t, b in zip((0.05, 0.2, 0.4), bars))
    [s] = topology.topology_score(curve).collect()
    p = [b / sum(bars) for b in bars if b > 0]
    entropy, area = -sum(x * math.log(x) for x in p), (12 + 7) / 2 * 0.15 + (7 + 5) / 2 * 0.2
    assert s["long_bars"] == 1 and abs(s["entropy"] - entropy) < 1e-9 and abs(s["score"] - (1 / 3 + entropy + area)) < 1e-9


def test_edge_curvature_against_searched_hops(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(26)} | {(20, 21)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def hops(a):
        far, todo = {a: 0}, deque([a])
        while todo:
            v = todo.popleft()
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    todo.append(w)
        return far

    d = {v: hops(v) for v in near}
    mass = lambda v, x: 0.5 if v == x else 0.5 / len(near[v])
    want = {(a, b): 1 - sum(mass(a, x) * mass(b, y) * d[x][y] for x in near[a] | {a} for y in near[b] | {b}) for a, b in edges}
    got = {(r["a"], r["b"]): r["curvature"] for r in topology.edge_curvature(spark.createDataFrame([*edges, (5, 5), *[(b, a) for a, b in list(edges)[:5]]], "a long, b long")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def flooded(on):
    seen, out = {}, []
    for cell in sorted(on):
        if cell in seen:
            continue
        todo, n = [cell], 0
        seen[cell] = len(out)
        while todo:
            r, c = todo.pop()
            n += 1
            for x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if x in on and x not in seen:
                    seen[x] = len(out)
                    todo.append(x)
        out.append(n)
    return out


def test_clusters_across_tiles(spark):
    rng = random.Random(4)
    cells = [("x", r, c, rng.random() < 0.6) for r in range(17) for c in range(23)] + [(None, r, c, (r + c) % 2 == 0 or r == 5) for r in range(9) for c in range(9)] + [("x", 0, 0, True), ("x", 0, 0, True)]
    df = spark.createDataFrame(cells, "k string, r int, c int, lit boolean").repartition(6)
    for tile in (3, 5, 100):
        got = Counter((r["k"], r["cluster"]) for r in fields.clusters(df, ["k"], "r", "c", df["lit"], tile).collect())
        for k in ("x", None):
            assert sorted(n for (kk, _), n in got.items() if kk == k) == sorted(flooded({(r, c) for kk, r, c, lit in cells if kk == k and lit}))
    assert fields.clusters(df.where("r < 0"), ["k"], "r", "c", df["lit"], 4).count() == 0


def plain_criticality(history, at):
    f = history[at]
    sizes = flooded({(int(r), int(c)) for r, c in np.argwhere(f > np.median(f))})
    kinds = sorted(Counter(sizes).items())
    exponent = r2 = 0.0
    if len(sizes) >= 5 and len(kinds) >= 3:
        x, y = np.log([s for s, _ in kinds]), np.log([n / len(sizes) for _, n in kinds])
        k, b = np.polyfit(x, y, 1)
        exponent, r2 = -k, max(0.0, 1 - ((y - k * x - b) ** 2).sum() / (((y - y.mean()) ** 2).sum() + 1e-12))
    u = f - f.mean()
    n = len(f)
    radial = [[] for _ in range(n // 4)]
    for i in range(-n // 2, n // 2):
        for j in range(-n // 2, n // 2):
            if (k := int(math.hypot(i, j))) < n // 4:
                radial[k].append(float((u * np.roll(u, (i, j), (0, 1))).mean() / f.var()))
    mean = [sum(x) / len(x) for x in radial]
    length = next((k for k in range(1, len(mean)) if mean[k] < mean[0] / math.e), len(mean))
    m = np.array([h.mean() for h in history]) - np.mean([h.mean() for h in history])
    acf = [float(m[: len(m) - k] @ m[k:]) / (float(m @ m) + 1e-12) for k in range(len(m))]
    slow = next((k for k in range(1, len(m)) if acf[k] < 1 / math.e), len(m)) if len(m) >= 10 else 0
    chi = f.size * f.var()
    score = (max(0, 1 - abs(exponent - 2) / 1.5) * min(r2, 1) + min(1, length / (n / 5)) + min(1, chi / (f.size * 0.01 + 1e-12)) + min(1, slow / 10)) / 4
    return len(sizes), exponent, r2, length, chi, slow, score


def test_criticality_against_numpy(spark):
    rng = np.random.default_rng(8)
    history = []
    for t in range(12):
        noise = rng.normal(size=(16, 16))
        smooth = sum(np.roll(noise, (i, j), (0, 1)) for i in range(3) for j in range(3)) * 0.02 + t * 0.01
        history.append(smooth)
    rows = [("run", t, r, c, float(f[r, c])) for t, f in enumerate(history) for r in range(16) for c in range(16)]
    got = {r["t"]: tuple(r)[2:9] for r in fields.criticality(spark.createDataFrame(rows, "k string, t int, r int, c int, v double"), ["k"], "t", "r", "c", "v", tile=5).collect()}
    assert len(got) == 12
    for t in range(12):
        assert np.allclose(got[t], plain_criticality(history, t), atol=1e-9), t


def test_order_parameter_of_waves_and_noise(spark):
    rng = np.random.default_rng(2)
    wave = np.array([[math.cos(2 * math.pi * 3 * c / 20 + 0.3) for c in range(20)] for _ in range(6)])
    grids = {"odd": rng.normal(size=(4, 9)), "wave": wave, "same": np.full((3, 4), 2.0), None: rng.normal(size=(5, 8))}
    rows = [(k, r, c, float(v)) for k, g in grids.items() for r, line in enumerate(g) for c, v in enumerate(line)]
    got = {r["k"]: r for r in fields.order_parameter(spark.createDataFrame(rows, "k string, r int, c int, v double").repartition(5), ["k"], "r", "c", "v").collect()}
    for k, g in grids.items():
        x = g - g.mean()
        n = x.shape[1]
        h = np.array([1 if j == 0 or 2 * j == n else 2 if 2 * j < n else 0 for j in range(n)])
        z = np.array([[sum(h[f] * sum(line[m] * np.exp(-2j * np.pi * f * m / n) for m in range(n)) * np.exp(2j * np.pi * f * p / n) for f in range(n)) / n for p in range(n)] for line in x])
        want = np.exp(1j * np.angle(z)).mean()
        if k != "same":
            assert abs(got[k]["order"] - abs(want)) < 1e-9 and abs((got[k]["phase"] - np.angle(want) + 1) % (2 * np.pi) - 1) < 1e-6 or abs(want) < 1e-9
    assert got["wave"]["state"] == "incoherent" and abs(got["same"]["order"] - 1) < 1e-9


def test_planted_groups_of_units(spark):
    rng = np.random.default_rng(5)
    bins, units = 400, 24
    counts = rng.poisson(0.4, size=(units, bins))
    beat = rng.random(bins) < 0.15
    counts[3:8, beat] += 4
    events = [(f"u{u:02d}", b * 10 + k % 10) for u in range(units) for b in range(bins) for k in range(counts[u, b])]
    df = assemblies.binned(spark.createDataFrame(events, "u string, t long").withColumnRenamed("u", "who"), "who", "t", 10)
    lo, hi = min(t for _, t in events) // 10, max(t for _, t in events) // 10
    x = counts[:, lo : hi + 1].astype(float)
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    c = z @ z.T / x.shape[1]
    e, v = np.linalg.eigh(c)
    got = assemblies.assemblies(df).collect()
    edge = (1 + math.sqrt(units / x.shape[1])) ** 2
    assert {r["assembly"] for r in got} == set(range(int((e > edge).sum()))) and abs(got[0]["edge"] - edge) < 1e-12
    first = sorted((r for r in got if r["assembly"] == 0), key=lambda r: r["unit"])
    assert abs(first[0]["eigenvalue"] - e[-1]) < 1e-9 and [r["unit"] for r in first if r["core"]] == [f"u{u:02d}" for u in range(3, 8)]
    w = np.array([r["weight"] for r in first])
    assert np.allclose(np.abs(w), np.abs(v[:, -1]), atol=1e-9)
    groups = spark.createDataFrame([r for r in got if r["assembly"] == 0])
    act = [r["activation"] for r in sorted(assemblies.activation(df, groups, (lo, hi)).collect(), key=lambda r: r["bin"])]
    assert np.allclose(act, (w @ z) ** 2 - (z**2).sum(axis=0) / units, atol=1e-6)
    assert assemblies.assemblies(df.where("bin < 0")).count() == 0
