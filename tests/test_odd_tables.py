"""Registered queries against their SQL on small tables of odd rows: zeros, repeated times, many copies."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestream.plans import registry

START = dt.datetime(2024, 1, 1)


def events(values, seconds=60, kinds=("click", "view"), users=3):
    """Events of several kinds; every value is a tuple of what stands at one time."""
    rows = []
    for at, same in enumerate(values):
        for kind in kinds:
            for v in same:
                rows.append((len(rows), START + dt.timedelta(seconds=seconds * at), len(rows) % users, kind, v, None))
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    kind = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    return pa.Table.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=kind)


def agrees(spark, folder, name, **tables):
    """The query's rows are those of its SQL, NaN being equal to NaN only."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.QUERIES[name](spark, str(folder)).toArrow()
    want = con.execute(registry.SQL[name]).to_arrow_table().select(got.column_names)
    plain = lambda t: sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in zip(*[c.to_pylist() for c in t.columns], strict=True))
    assert got.num_rows
    assert plain(got) == plain(want)
    con.close()


#: Zeros after a price, before one and twice in a row: returns of infinity, NaN and -1.
ZEROS = [(10.0 + i % 7 + i / 3,) for i in range(30)] + [(0.0, 0.0), (5.0,), (0.0,), (9.0, 9.0)] + [(20.0 + i % 5 + i / 7,) for i in range(70)]


@pytest.mark.parametrize("name", ["g11_tail_risk", "g12_sharpe_drawdown", "i36_branch_rollup", "n9_guardrails", "w8_realised_volatility", "w18_volatility_shock"])
def test_returns_over_zero_prices(spark, tmp_path, name):
    agrees(spark, tmp_path, name, events=events(ZEROS))


def reads_anew(df):
    """Whether a window has a frame from a row to its key's end, which is read anew for each row."""
    return "currentrow$(), unboundedfollowing$()" in df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_to_the_end_are_seen(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy(F.col("id") % 2).orderBy("id")
    assert reads_anew(spark.range(5).withColumn("x", F.min("id").over(w.rowsBetween(0, Window.unboundedFollowing))))


def test_cleaning_reads_a_key_once(spark, tmp_path):
    e = events([(float(i % 11),) for i in range(60)])
    agrees(spark, tmp_path, "f1_clean_frame", events=e)
    assert not reads_anew(registry.QUERIES["f1_clean_frame"](spark, str(tmp_path)))


def test_corrections_read_a_family_once(spark):
    from lodestream.operators import stats

    p = [0.01, 0.04, 0.03, 0.04, 0.5]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "f string, i int, p double")
    out = stats.corrected(df, ["f"], "p", "i")
    assert not reads_anew(out)
    assert [round(r["bh"], 9) for r in out.orderBy("i").collect()] == [0.05, 0.05, 0.05, 0.05, 0.5]


def test_grid_reads_a_key_once(spark, tmp_path):
    e = events([(float(i % 11), 3.0) for i in range(60)], seconds=2500)
    agrees(spark, tmp_path, "t9_uniform_grid", events=e)
    assert not reads_anew(registry.QUERIES["t9_uniform_grid"](spark, str(tmp_path)))


def test_curvature_of_bipartite_graphs_lists_no_pairs(spark):
    from lodestream.operators import topology

    edges = [(i, 100 + (i * k + i // 3) % 9) for i in range(12) for k in (1, 2, 5)]
    odd = [(500, 501), (501, 502), (500, 502)]  # with a triangle elsewhere the graph is not bipartite
    graph = lambda e: topology.edge_curvature(spark.createDataFrame(e, "a long, b long"))
    fast = graph(edges)
    assert "hop2" not in fast._jdf.queryExecution().analyzed().toString()
    plain = lambda df: {(r["a"], r["b"]): round(r["curvature"], 9) for r in df.collect() if r["a"] < 500}
    assert plain(fast) == plain(graph(edges + odd)) and len(plain(fast)) == len(set(edges))


def test_permutation_orders_only_rows_near_the_border(spark, tmp_path):
    import hashlib

    from lodestream.operators import resampling as R

    rows = [("a", i, i % 3 == 0, float(i * i % 17)) for i in range(200)] + [(None, i, i % 2 == 0, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i long, g boolean, v double")
    for digits in (1, 3):
        got = {r["k"]: r["extreme"] for r in R.permutation_test(df, ["k"], "i", "g", "v", rounds=19, digits=digits).collect()}
        for k in ("a", None):
            own = [r for r in rows if r[0] == k]
            na = sum(r[2] for r in own)
            far = lambda one, two: abs(sum(r[3] for r in one) / len(one) - sum(r[3] for r in two) / len(two))
            seen, extreme = far([r for r in own if r[2]], [r for r in own if not r[2]]), 0
            for b in range(1, 20):
                dealt = sorted(own, key=lambda r: (hashlib.md5(f"42:{b}:{r[1]}".encode()).hexdigest(), r[1]))
                extreme += far(dealt[:na], dealt[na:]) >= seen
            assert got[k] == extreme


def test_groups_of_more_units_than_bins(spark, monkeypatch):
    import numpy as np

    from lodestream.operators import assemblies as A

    monkeypatch.setattr(A, "MOST", 50)  # units are more than a matrix may hold, bins are not
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.5, size=(120, 40))
    counts[10:60, ::5] += 6
    counts[:, 0] += 1
    counts[7] = 2  # no variance
    rows = [(u, t, int(x)) for (u, t), x in np.ndenumerate(counts) if x]
    got = A.assemblies(spark.createDataFrame(rows, "unit long, bin long, n long")).collect()
    sd = counts.std(axis=1, keepdims=True)
    z = np.divide(counts - counts.mean(axis=1, keepdims=True), sd, out=np.zeros(counts.shape), where=sd > 0)
    e, v = np.linalg.eigh(z @ z.T / 40)
    edge = (1 + np.sqrt(120 / 40)) ** 2
    assert {r["assembly"] for r in got} == set(range(int((e > edge).sum()))) != set()
    first = sorted((r for r in got if r["assembly"] == 0), key=lambda r: r["unit"])
    w = v[:, -1] * np.sign(v[np.argmax(np.abs(v[:, -1])), -1])
    assert abs(first[0]["eigenvalue"] - e[-1]) < 1e-9 and np.allclose([r["weight"] for r in first], w, atol=1e-9)
    assert [r["core"] for r in first] == list(np.abs(w) > 2 * w.std()) and abs(first[0]["explained"] - e[e > edge].sum() / e.sum()) < 1e-9


def test_correlations_by_blocks_of_units(spark, monkeypatch):
    import numpy as np

    from lodestream.operators import assemblies as A

    monkeypatch.setattr(A, "BLOCK", 5)
    monkeypatch.setattr(A, "STRIP", 7)
    rng = np.random.default_rng(9)
    counts = rng.poisson(0.4, size=(23, 30))
    counts[:, 0] = counts[:, -1] = 1
    counts[4] = 1  # no variance
    rows = [(f"u{u}", t, int(x)) for (u, t), x in np.ndenumerate(counts) if x]
    pairs, bins = A.unit_correlations(spark.createDataFrame(rows, "u string, t long, n long"), "u", "t", "n")
    assert bins == 30 and "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["a"], r["b"]): r["corr"] for r in pairs.collect()}
    names = sorted(f"u{u}" for u in range(23))
    assert set(got) == {(a, b) for a in names for b in names if a <= b}
    for (a, b), c in got.items():
        x, y = counts[int(a[1:])], counts[int(b[1:])]
        want = ((x * y).mean() - x.mean() * y.mean()) / (x.std() * y.std()) if x.std() and y.std() else 0.0
        assert abs(c - want) < 1e-9


def test_vote_that_just_reaches_its_share(spark):
    from lodestream.operators import aggregates as A

    tenths = [("bull", k) for k in (3, 5, 7)] + [("bear", k) for k in (7, 7, 3, 9, 9)]  # 15 of 50, though the sums' quotient is 0.29999999999999993
    rows = [(1, side, 0.1 + (k - 1) / 10, 10.0 if side == "bull" else 0.1) for side, k in tenths]
    df = spark.createDataFrame(rows, "u int, side string, c double, st double").coalesce(1)
    assert A.divergence_vote(df, ["u"], "side", "c", "st", 3, 0.3).collect()[0]["side"] == "bull"


def test_equal_means_are_told_apart_as_in_sql(spark, tmp_path):
    """Copies at one time make both means equal, so the order of adding decides which is greater."""
    agrees(spark, tmp_path, "w14_signals", events=events([(round(0.1 + i * 7.13 % 60, 2),) * (30 + i) for i in range(40)]))


def test_mean_by_runs(spark):
    from pyspark.sql import functions as F

    from lodestream.operators import windows as W

    rows = [(k, i, None if i % 11 == 5 else 0.1 * (i * i % 97) + i % 3 / 7) for k in ("a", None) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(3)
    got = {(r["k"], r["i"]): r["m"] for r in W.mean_by_runs(df, W.series(["k"], ["i"]), "v", 20, "m").where(F.col("i") >= 0).collect()}
    x = [r[2] for r in rows[:90]]
    for i in range(90):
        first, total = max(0, i - 19), 0.0
        runs = [s for s in range(0, 90, 16) if first <= s and s + 16 <= i + 1]
        for j in range(first, i + 1):
            inside = any(s <= j < s + 16 for s in runs)
            part = 0.0 if inside else x[j] or 0.0
            if j in runs:
                for v in x[j : j + 16]:  # sum() of Python compensates
                    part += v or 0.0
            total += part
        n = sum(v is not None for v in x[first : i + 1])
        assert got["a", i] == got[None, i] == total / n, i


def test_equal_votes_are_added_in_the_order_of_rows(spark, tmp_path):
    """Both sides' votes are equal in decimals, so the order of adding decides; rows are written in another order."""
    import random

    rows = []
    for user in range(60):
        own = [(side, 50 + side * k / 100, c) for side in (1, -1) for k, c in ((130 + user, 1), (700, 7), (333, 3), (4 * user, 9))]
        random.Random(user).shuffle(own)
        rows += [(10 * (8 * user + i) + c - 1, START, user, "view", v, None) for i, (_, v, c) in enumerate(own)]
    e = events([(1.0,)])
    e = pa.Table.from_pylist([dict(zip(e.column_names, row, strict=True)) for row in rows], schema=e.schema)
    con = duckdb.connect("", config={"threads": 1})
    con.register("events", e)
    want = sorted(con.execute(registry.SQL["g16_divergence_vote"]).fetchall())
    assert len({w[1] for w in want}) == 2  # the SQL tells equal votes apart
    random.Random(1).shuffle(rows)
    for part in range(3):
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        pq.write_table(pa.Table.from_pylist([dict(zip(e.column_names, row, strict=True)) for row in rows[part::3]], schema=e.schema), tmp_path / "events.parquet" / f"{part}.parquet")
    got = registry.QUERIES["g16_divergence_vote"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == want


def test_correlations_copy_counts_few_times(spark, monkeypatch):
    """Blocks grow with the units, so counts are copied COPIES times and not once for each BLOCK units; pairs leave by tiles."""
    import numpy as np

    from lodestream.operators import assemblies as A

    for name, value in (("BLOCK", 2), ("COPIES", 3), ("TILE", 2)):
        monkeypatch.setattr(A, name, value, raising=False)
    counts = np.random.default_rng(2).poisson(0.7, size=(29, 12))
    counts[:, 0] = counts[:, -1] = 1
    rows = [(u, t, int(x)) for (u, t), x in np.ndenumerate(counts) if x]
    pairs, _ = A.unit_correlations(spark.createDataFrame(rows, "u long, t long, n long"), "u", "t", "n")
    assert "sequence(0, 2" in pairs._jdf.queryExecution().analyzed().toString()
    got = pairs.toPandas()
    want = np.corrcoef(counts)[got["a"], got["b"]]
    assert len(got) == len(got.drop_duplicates(["a", "b"])) == 29 * 15 and (got["a"] <= got["b"]).all() and np.allclose(got["corr"], want)
