"""Steps that once listed pairs, or took a row at a time, against plain sums."""

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestream.operators import joins, ledger, panels, recurrences, search, topology
from lodestream.plans import registry
from lodestream.streaming import backlog, keyed


@pytest.mark.parametrize("cells", [30, 10**6])
def test_quantification_in_bands(spark, cells, monkeypatch):
    monkeypatch.setattr(recurrences, "CHUNK", 7)
    rng = np.random.default_rng(4)
    series = {"a": np.round(rng.normal(size=70), 1), None: np.sin(np.arange(50) * 0.3)}
    df = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)], "k string, t long, v double").repartition(3)
    got = {r["k"]: r for r in recurrences.recurrence_quantification(df, ["k"], ["t"], "v", 2, 3, 0.3, cells).collect()}
    for k, x in series.items():
        p = np.column_stack([x[:-4], x[2:-2], x[4:]])
        n = len(p)
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        m = (d < 0.3 * np.percentile(d[:: max(1, n // 50)].ravel(), 95)) & ~np.eye(n, dtype=bool)
        up = np.pad(m, ((1, 1), (0, 0)))
        slant = np.pad(m, 1)
        lam = (m & (up[:-2] | up[2:])).sum() / m.sum()
        det = np.triu(m & (slant[:-2, :-2] | slant[2:, 2:]), 1)
        ones = [len(s) for o in range(1, n) for s in "".join("x" if c else " " for c in np.diag(m, o)).split() if len(s) > 1]
        assert sum(ones) == det.sum()
        share = np.array(ones) / sum(ones)
        want = (m.sum() / (n * (n - 1)), det.sum() / m.sum(), lam, -float((share * np.log2(share + 1e-15)).sum()))
        assert np.allclose([got[k][c] for c in ("rr", "det", "lam", "ent")], want, atol=1e-9), k


def test_quantification_of_one_long_flat_series(spark):
    """All of 18 million pairs recur; they are not listed."""
    n = 6000
    df = spark.range(n + 4).selectExpr("'flat' AS k", "id AS t", "1.0 AS v")
    out = recurrences.recurrence_quantification(df, ["k"], ["t"], "v", 2, 3, 0.3)
    assert "_cell" not in out._jdf.queryExecution().optimizedPlan().toString().replace("_cells", "")
    [r] = out.collect()
    assert (r["n"], r["rr"], r["det"]) == (n, 1.0, (n * (n - 1) // 2 - 1) / (n * (n - 1)))
    assert r["lam"] == pytest.approx((n * (n - 1) - 2) / (n * (n - 1)))  # the main diagonal leaves a cell alone in two columns


@pytest.mark.parametrize("cells", [30, 10**6])
def test_recurrence_in_bands(spark, cells, monkeypatch):
    monkeypatch.setattr(recurrences, "CHUNK", 7)
    rng = np.random.default_rng(5)
    x = [float(v) for v in rng.integers(0, 9, size=60)]
    x[11] = x[30] = None
    x[40] = float("nan")
    rows = [("a", t, v) for t, v in enumerate(x)] + [("short", t, 1.0) for t in range(3)]
    got = {r["k"]: r for r in recurrences.recurrence(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], ["t"], "v", 2, 2, cells).collect()}
    points = [i for i in range(58) if x[i + 2] is not None]
    near = lambda a, b: a is not None and b is not None and abs(a - b) <= 2
    pairs = {(i, j) for i in points for j in points if i < j and near(x[i], x[j]) and near(x[i + 2], x[j + 2])}
    slant = [p for p in pairs if (p[0] + 1, p[1] + 1) in pairs or (p[0] - 1, p[1] - 1) in pairs]
    n = len(points)
    assert got["a"]["rate"] == pytest.approx(2 * len(pairs) / (n * (n - 1))) and got["a"]["determinism"] == pytest.approx(len(slant) / len(pairs))
    assert (got["short"]["rate"], got["short"]["determinism"]) == (None, None)


@pytest.mark.parametrize("block", [4, 2048])
def test_correlation_curve_by_blocks(spark, block):
    """Against the edges of all pairs, with days missing, nulls, infinities and users whose shared values are equal."""
    rng = np.random.default_rng(6)
    common = rng.normal(size=12)
    rows = []
    for u in range(21):
        x = common * (u % 3) + rng.normal(size=12) * 0.7 + 1000.0 * (u % 2)
        days = np.flatnonzero(rng.random(12) < 0.6)
        rows += [(u, int(t), float(x[t])) for t in days]
    rows += [(u, t, 7.1) for u in (30, 31) for t in range(5)] + [(32, t, 7.1 if t < 4 else 9.0) for t in range(6)]
    rows += [(33, t, None if t < 2 else float(t)) for t in range(5)] + [(34, t, float("nan") if t == 1 else float(t)) for t in range(5)] + [(35, t, float("inf") if t == 1 else float(t)) for t in range(5)]
    rows += [(None, 1, 1.0), (36, None, 1.0), (37, 1, 2.0)]
    panel = spark.createDataFrame(rows, "u long, t long, v double").repartition(3)
    marks = [0.1, 0.3, 0.5, 0.7]
    edges = []
    for a in range(38):
        for b in range(a + 1, 38):
            one, two = ({t: v for u, t, v in rows if u == k and t is not None} for k in (a, b))
            both = [(one[t], two[t]) for t in one.keys() & two.keys()]
            x, y = np.array([p for p in both if None not in p], dtype=float).reshape(-1, 2).T
            if len(both) > 2 and len(x) and np.isfinite(x).all() and np.isfinite(y).all() and np.ptp(x) > 0 and np.ptp(y) > 0:
                edges.append((round(float(np.sqrt(0.5 * (1 - np.clip(np.corrcoef(x, y)[0, 1], -1, 1)))), 9), a, b))
    got = {r["threshold"]: r for r in topology.correlation_curve(panel, "u", "t", "v", marks, block=block).collect()}
    users = len({u for u, _, _ in rows if u is not None})
    for t in marks:
        near = [e for e in edges if e[0] <= t]
        root = {}

        def find(v):
            while root.setdefault(v, v) != v:
                v = root[v]
            return v

        for _, a, b in near:
            root[find(a)] = find(b)
        parts = users - sum(1 for v in list(root) if find(v) != v)
        bar = max(0.0, t - sum(e[0] for e in near) / len(near))
        assert (got[t]["edges"], got[t]["components"], got[t]["euler"]) == (len(near), parts, users - len(near) + parts) and got[t]["bar"] == pytest.approx(bar, abs=1e-8)
    assert got[0.7]["edges"] > got[0.3]["edges"] > 0


@pytest.mark.parametrize("name", ["m5_threshold_curve", "m5_topology_score"])
def test_curves_list_no_pairs(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(topology, "spanning_forest", lambda edges, *_: small(edges))
    users, days = 150, 5

    def small(edges):
        assert edges.count() < 2 * users  # of 11,175 pairs
        return edges

    rng = np.random.default_rng(7)
    start = dt.datetime(2024, 1, 1)
    events = [{"event_id": u * days + t, "ts": start + dt.timedelta(days=t), "user_id": u, "event_type": "view", "value": float(v)} for u in range(users) for t, v in enumerate(rng.normal(size=days))]
    kind = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64())])
    pq.write_table(pa.Table.from_pylist(events, schema=kind), f"{tmp_path}/events.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count()


class Values:
    """A handle and its value states in one process; every call is counted."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def getValueState(self, name, _):  # noqa: N802
        outer = self

        class Value:
            def get(self):
                outer.calls += 1
                return outer.kept.get(name)

            def update(self, new):
                outer.calls += 1
                outer.kept[name] = new

        return Value()


def test_a_book_takes_two_calls_a_batch(spark):
    handle, p = Values(), keyed.BookProcessor("book")
    p.init(handle)
    frame = lambda rows: pd.DataFrame(rows, columns=["seq", "snapshot", "side", "price", "qty"])
    book = keyed.Book()
    for batch in ([(1, True, "bid", float(i), 1.0 + i) for i in range(500)], [(2, False, "bid", 3.0, 0.0), (2, False, "bid", 4.0, 7.0), (2, False, "bid", 4.0, 9.0)], [(9, True, "ask", 1.0, 2.0)]):
        handle.calls = 0
        [out] = list(p.handleInputRows(("b",), iter([frame(batch[1:]), frame(batch[:1])]), None))
        assert handle.calls == 2
        book.changed = {}
        book.take(batch[0][0], batch[0][1], sorted(r[2:] for r in batch))
        assert {(s, x): q for s, x, q in zip(out["side"], out["price"], out["qty"])} == book.changed and set(out["seq"]) == {book.seq}
    assert handle.kept["book"] == (9, ["ask"], [1.0], [2.0])


def test_a_bucket_takes_two_calls_a_batch(spark):
    handle, p = Values(), keyed.BucketProcessor("k", "row", 0.5, 2.0)
    p.init(handle)
    got = []
    for batch in ([(1.0, 7), (0.0, 5), (0.0, 4)], [(9.0, 8)]):
        handle.calls = 0
        [out] = list(p.handleInputRows(("a",), iter([pd.DataFrame(batch, columns=["at", "row"])]), None))
        assert handle.calls == 2
        got += list(out.itertuples(index=False, name=None))
    assert got == [("a", 4, True, 1.0), ("a", 5, True, 0.0), ("a", 7, False, 0.5), ("a", 8, True, 1.0)]


def test_a_backlog_takes_two_calls_a_batch(spark):
    handle, p = Values(), backlog.BacklogProcessor("k", "row", 10, 100, 5_000)
    timers = set()
    handle.registerTimer, handle.deleteTimer = timers.add, timers.remove
    p.init(handle)
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["source", "event", "arrival_us", "row"])])
    rows = lambda out: [tuple(r) for f in out for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
    assert rows(p.handleInputRows(("a",), frame(("y", 95, 1_001, 2), ("x", 100, 1_000, 1)), None)) == []
    assert handle.calls == 2 and timers == {7}  # idle at 6.0 ms
    assert rows(p.handleInputRows(("a",), frame(("x", 120, 4_000, 3), ("y", 110, 4_000, 4)), None)) == [("a", 2, "in order", 1), ("a", 1, "in order", 2)]
    assert handle.calls == 4 and timers == {10}
    timers.clear()  # as a timer that has fired
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda _: 10})()
    assert rows(p.handleExpiredTimer(("a",), now, None)) == [("a", 4, "in order", 3), ("a", 3, "in order", 4)]
    assert handle.calls == 6 and not timers


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} common") for i in range(40)], "doc long, text string")
    queries = spark.createDataFrame([(1, "w1 common"), (2, "w2 w4")], "q long, ask string")
    out = search.bm25(docs, "doc", "text", queries, "q", "ask", 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q#" not in plan and "hashpartitioning(doc#" in plan
    assert out.count() == 40 + len([i for i in range(40) if i % 3 == 2 or i % 5 in (2, 4)])


def test_one_cell_of_many_is_dealt_to_several_tasks(spark):
    near = spark.range(400).selectExpr("id AS a", "1.0 + id / 1e6 AS x").union(spark.createDataFrame([(900, None), (901, 50.0)], "a long, x double"))
    other = spark.range(300).selectExpr("id AS b", "1.0 - id / 1e6 AS y").union(spark.createDataFrame([(900, None), (901, 53.0), (902, 56.0)], "b long, y double"))
    out = joins.within_tolerance(near, other, "x", "y", 5.0, task_pairs=5_000)
    by_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 400 * 300 + 1 and max(by_task) < 40_000
    assert out.select("a", "b").distinct().count() == 400 * 300 + 1 and out.columns == ["a", "x", "b", "y"]


def test_a_chain_goes_on_from_batch_to_batch(spark):
    rows = [(k, i, None if i == 5 else f"{k}{i}") for k in ("a", None, "b") for i in range(40)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = ledger.append_chain(spark.createDataFrame(rows, "k string, n long, r string").repartition(3), "k", "n", "r")
        assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # no ledger is held whole
        got = {(r["k"], r["n"]): (r["record_hash"], r["chain_hash"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k in ("a", None, "b"):
        chain = "0" * 64
        for i in range(40):
            h = sha("" if i == 5 else f"{k}{i}")
            chain = sha(chain + h)
            assert got[k, i] == (h, chain)
    assert len(got) == len(rows)


@pytest.mark.parametrize("most", [5, 10**6])
def test_motifs_without_paths(spark, most):
    rng = np.random.default_rng(8)
    arcs = {(int(a), int(b)) for a, b in rng.integers(0, 12, size=(60, 2))} | {(50, 51), (51, 50)}
    df = spark.createDataFrame([*arcs, *arcs, (None, 3), (3, None)], "src long, dst long")
    x = {(a, b) for a, b in arcs if a != b}
    paths = [(a, b, d) for a, b in x for c, d in x if b == c and a != d]
    want = (sum((a, c) in x for a, _, c in paths), sum((c, a) in x for a, _, c in paths) // 3, sum((b, a) in x for a, b in x) // 2)
    [got] = panels.motifs(df, most).collect()
    assert tuple(got) == want and min(want) > 0
    assert tuple(panels.motifs(df.limit(0)).first()) == (0, 0, 0)


def test_buckets_take_rows_and_keep_their_level():
    from pyspark.sql import Row

    from lodestream.streaming.keyed import BucketProcessor

    class Level:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    p = BucketProcessor("client", "row", 0.5, 2.0)
    p.level = Level()
    first = list(p.handleInputRows((7,), iter([Row(at=1.0, row=2), Row(at=0.0, row=1), Row(at=1.0, row=3)]), None))
    assert [(r["client"], r["row"], r["allowed"], r["tokens"]) for r in first] == [(7, 1, True, 1.0), (7, 2, True, 0.5), (7, 3, False, 0.5)]
    assert p.level.value == (1.0, 0.5)
    (last,) = p.handleInputRows((7,), iter([Row(at=3.0, row=4)]), None)
    assert last["allowed"] and last["tokens"] == 0.5


def test_session_folders_are_found_by_tasks(spark, tmp_path):
    from lodestream.sources.files import read_sessions

    for i in range(3):
        folder = tmp_path / ("" if i else "night") / f"session={i}"  # below another folder as well
        folder.mkdir(parents=True)
        (folder / "log.json").write_text('{"event_id": 1, "status": "OK"}\n{"event_id": 2, "status": "FAILED"}\n')
    (tmp_path / "stray.json").write_text('{"event_id": 9, "status": "OK"}\n')
    (tmp_path / "session=1" / "note.txt").write_text('{"event_id": 9, "status": "OK"}\n')
    got = read_sessions(spark, f"file://{tmp_path}", "event_id long, status string")
    assert sorted((r["session"], r["event_id"]) for r in got.collect()) == [("0", 1), ("1", 1), ("2", 1)]


def test_blocks_give_few_edges_beside_the_first(spark, monkeypatch):
    """Ends that reach one unit of the first block anyway need no edge, so the forest gets about two edges a unit."""
    users, days, marks = 240, 30, [0.5, 0.6, 0.65, 0.7]
    v = np.random.default_rng(8).normal(size=(users, days)) + np.sin(np.arange(days)) * 0.5
    v[:3] = np.random.default_rng(9).normal(size=(3, days))  # hardly near to any other
    panel = spark.createDataFrame([(u, t, float(x)) for (u, t), x in np.ndenumerate(v)], "u long, t long, v double")
    given, forest = [], topology.spanning_forest
    monkeypatch.setattr(topology, "spanning_forest", lambda e, *a: given.append(e.count()) or forest(e, *a))
    curves = [sorted((r["threshold"], r["edges"], r["components"], round(r["bar"], 9)) for r in topology.correlation_curve(panel, "u", "t", "v", marks, block=n).collect()) for n in (30, 2048)]
    assert curves[0] == curves[1] and curves[0][0][2] > 1
    assert given[0] < 4 * users
