"""Whitening against plain numpy, with exact sums held against Python's whole numbers."""

import numpy as np
import pytest

from lodestream.llm import whitening

INF, NAN = float("inf"), float("nan")


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, x string, h double, w int").repartition(4)


def plain(vectors, weights="counts"):
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    fit = x if weights == "counts" else [list(t) for t in sorted(set(map(tuple, x)))]
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda rows: np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in rows])
    f = centred(fit)
    v = f.T @ f / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, centred(x) @ u / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(v)


def odd(seed=3, n=300, d=6):
    rng = np.random.default_rng(seed)
    good = [(i, (rng.normal(size=d) * [1, 2, 3, 4, 5, 6][:d]).tolist()) for i in range(n)]
    good += [(1000 + i, good[0][1]) for i in range(200)] + [(5, good[5][1]), (None, good[6][1]), (7000, [0.0] * d)]
    bad = [(8000, None), (8001, [None] * d), (8002, [1.0] * (d - 1) + [INF]), (8003, [NAN] * d), (8004, []), (8005, [1.0] * (d + 1)), (8006, [1.0])]
    return good, bad


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_against_numpy(spark, weights):
    good, bad = odd()
    got = whitening.whiten(table(spark, good + bad), weights=weights).collect()
    n, deviation, white, explained = plain([v for _, v in good], weights)
    assert len(got) == len(good) and {r["n"] for r in got} == {n}
    want = sorted((str(i), dev, tuple(w)) for (i, _), dev, w in zip(good, deviation, white, strict=True))
    have = sorted((str(r["id"]), int(r["deviation"]), tuple(r["whitened"])) for r in got)
    assert sorted(w[:2] for w in want) == sorted(h[:2] for h in have)
    a = np.array([h[2] for h in sorted(have, key=lambda h: h[:2])])
    b = np.array([w[2] for w in sorted(want, key=lambda w: w[:2])])
    assert np.abs(a - b * np.sign((a * b).sum(axis=0))).max() < 1e-9
    assert np.allclose(got[0]["explained"], explained, rtol=1e-9) and all(r["identity_error"] < 1e-9 for r in got)


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=3) * 1e15]) for i in range(40)] + [(90, [3e38, -3e38, 0.0])]
    got = {r["id"]: r for r in whitening.whiten(table(spark, rows[:40])).collect()}
    _, deviation, white, _ = plain([v for _, v in rows[:40]])
    assert [got[i]["deviation"] for i in range(40)] == [x if x < 10**38 else None for x in deviation]
    assert np.abs(np.abs([got[i]["whitened"] for i in range(40)]) - np.abs(white)).max() < 1e-9
    assert whitening.whiten(table(spark, rows)).count() == 41


def test_directions_without_variance_give_no_component(spark):
    rng = np.random.default_rng(1)
    flat = [(i, [*rng.normal(size=2).tolist(), 0.5]) for i in range(50)]
    assert {len(r["whitened"]) for r in whitening.whiten(table(spark, flat)).collect()} == {2}
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0


def test_query_columns(spark):
    got = whitening.op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    counts = got.groupBy("component").count().collect()
    assert len(counts) == 32 and len({r["count"] for r in counts}) == 1
