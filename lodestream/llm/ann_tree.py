"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first search, calibrated leaf visits.

* The tree is fitted on a bounded sample (``fit_rows`` vectors with the smallest hash of their id); every row of the
  table is then put into a leaf, in Spark tasks.  The fit goes down to leaves that stand for about ``leaf_rows`` rows of
  the whole table, so the number of leaves grows with the table until a leaf holds ``FEWEST`` vectors of the sample.
* A query walks the tree through one priority queue of centroid distances: the nearest node is opened next, whichever
  branch it is on, until ``visits`` leaves have come out - and further, until they hold ``k`` rows besides its own.
* ``visits`` is widened against brute force over all rows, for a bounded number of queries, until the mean recall
  reaches ``calibrated_recall``.
* Queries of neighbouring leaves form blocks of about ``block_queries``.  The rows of all leaves that a block visits are
  dealt over parts by a hash of the id and vector, so that a leaf that holds a third of all rows (copies of one vector)
  is in all parts.  A task holds the queries of a block and their ``k`` nearest so far; rows stream past, leaf by leaf.

Distances are Euclidean, in double precision on the original vectors.  Vectors that are null, empty, zero or hold null
or non-finite components take no part, nor do those of another length than the most common one.  Ties go to the
smaller id; repeated ids are separate candidates, but a row never finds its own id; a repeated query id is answered for
the vector of its smallest hash.  Empty tables give no rows; columns beside id and vector are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import clean_vectors, matrix


FEWEST = 4
PARTS, ROWS_A_PART, FLUSH, MOST_BROADCAST = 16, 1_000_000, 1 << 20, 1_000_000


class Tree:
    """Nodes in arrays: ``centre``, children as a range of node numbers, leaf number or -1."""

    def __init__(self, x: np.ndarray, branching: int = 8, leaf_rows: int = 64, rounds: int = 8, seed: int = 5):
        self.centre = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])]
        self.child: list[tuple[int, int]] = [(0, 0)]
        rng = np.random.default_rng(seed)
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            start = np.unique(rows[rng.permutation(len(rows))[: branching * 8]], axis=0)
            if len(start) < 2:
                continue
            c = start[rng.permutation(len(start))[:branching]]
            for _ in range(rounds):
                at = nearest(rows, c)
                keep = np.unique(at)
                c = np.stack([rows[at == k].mean(axis=0) for k in keep])
            at = nearest(rows, c)
            keep = np.unique(at)
            if len(keep) < 2:
                continue
            self.child[node] = (len(self.centre), len(self.centre) + len(keep))
            first = len(self.centre)
            for i, k in enumerate(keep):
                self.centre.append(c[k])
                self.child.append((0, 0))
                todo.append((first + i, rows[at == k]))
        self.centre = np.stack(self.centre)
        self.leaf = np.full(len(self.centre), -1)
        ends = [n for n, (a, b) in enumerate(self.child) if a == b]
        self.leaf[ends] = np.arange(len(ends))
        self.n_leaves = len(ends)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the nearest child at each level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            a, b = self.child[node]
            if a == b:
                out[rows] = self.leaf[node]
            elif len(rows):
                at = nearest(x[rows], self.centre[a:b])
                todo += [(a + k, rows[at == k]) for k in range(b - a)]
        return out

    def search(self, q: np.ndarray, visits: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: ``visits`` of them that hold rows, and more until they hold ``least`` rows."""
        heap, out, have, seen = [(0.0, 0)], [], 0, 0
        while heap and (seen < visits or have < least):
            _, node = heapq.heappop(heap)
            a, b = self.child[node]
            if a == b:
                leaf = int(self.leaf[node])
                n = 1 if held is None else int(held[leaf])
                if n:
                    out.append(leaf)
                    have, seen = have + n, seen + 1
                continue
            far = ((self.centre[a:b] - q) ** 2).sum(axis=1)
            for k in range(a, b):
                heapq.heappush(heap, (float(far[k - a]), k))
        return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)


def lengths(d: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; where squares leave the range of doubles, entries are divided by a power of two first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        far = np.sqrt((d * d).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(far) | (far < 2.0**-500))
        if len(odd):
            e = np.frexp(np.abs(d[odd]).max(axis=1, initial=0.0))[1]
            far[odd] = np.ldexp(np.sqrt((np.ldexp(d[odd], -e[:, None]) ** 2).sum(axis=1)), e)
    return np.where(np.isnan(far), np.inf, far)


def nearest_rows(ids: np.ndarray, v: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` nearest rows of another id, ties to the smaller id."""
    with np.errstate(over="ignore"):
        far = lengths(v - q)
    other = np.flatnonzero(ids != own)
    near = other[far[other] <= np.partition(far[other], k - 1)[k - 1]] if len(other) > k else other
    near = near[np.lexsort((ids[near], far[near]))][:k]
    return near, far[near]


def query_blocks(leaves: list[int], counts: list[int], most: int) -> tuple[list[tuple[int, int, int]], int]:
    """(leaf, first block, blocks) of the queries whose nearest leaf it is, and the number of blocks.

    Queries of neighbouring leaves share a block of about ``most``; those of a leaf with more are dealt over several.
    """
    out, block, have = [], 0, 0
    for leaf, n in zip(leaves, counts, strict=True):
        if have and have + n > most:
            block, have = block + 1, 0
        many = -(-n // most)
        out.append((leaf, block, many))
        block, have = (block + many, 0) if many > 1 else (block, have + n)
    return out, block + (have > 0)


class Nearest:
    """The ``k`` nearest rows of each query of a block, from rows that come leaf by leaf in any number."""

    def __init__(self, k: int, n_leaves: int):
        self.k, self.n_leaves = k, n_leaves
        self.asked: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.q = None

    def ask(self, ids: np.ndarray, q: np.ndarray, leaves: pa.Array) -> None:
        self.asked.append((ids, q, leaves))

    def start(self) -> None:
        self.own = np.concatenate([a[0] for a in self.asked])
        self.q = np.concatenate([a[1] for a in self.asked])
        with np.errstate(over="ignore"):
            self.norm = (self.q**2).sum(axis=1)
        n = np.concatenate([a[2].value_lengths().to_numpy() for a in self.asked])
        leaf = np.concatenate([a[2].flatten().to_numpy() for a in self.asked])
        order = np.argsort(leaf, kind="stable")
        self.by_leaf = np.repeat(np.arange(len(n)), n)[order]
        self.cut = np.searchsorted(leaf[order], np.arange(self.n_leaves + 1))
        self.bound = np.full(len(self.q), np.inf)
        self.at, self.far, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.have = 0

    def meet(self, leaf: int, ids: np.ndarray, v: np.ndarray) -> None:
        if self.q is None:
            if not self.asked:
                return
            self.start()
        who = self.by_leaf[self.cut[leaf] : self.cut[leaf + 1]]
        step = max(1, FLUSH // max(1, len(who)))
        for i in range(0, len(ids) if len(who) else 0, step):
            x, name = v[i : i + step], ids[i : i + step]
            with np.errstate(over="ignore", invalid="ignore"):
                norm = (x**2).sum(axis=1)[None, :] + self.norm[who][:, None]
                # products only rule rows out; what is kept, or is too large for them, is measured on the differences
                near = norm - 2 * self.q[who] @ x.T <= (self.bound[who] ** 2)[:, None] + 1e-9 * (norm + 1)
                near |= ~np.isfinite(norm)
                near &= name[None, :] != self.own[who][:, None]
                a, c = np.nonzero(near)
                far = lengths(x[c] - self.q[who[a]])
            keep = far <= self.bound[who[a]]
            self.fresh.append((who[a][keep], far[keep], name[c][keep]))
            self.have += int(keep.sum())
            if self.have > FLUSH // 4:
                self.settle()

    def settle(self) -> None:
        at, far, name = (np.concatenate([x, *(f[i] for f in self.fresh)]) for i, x in enumerate((self.at, self.far, self.id)))
        order = np.lexsort((name, far, at))
        at, far, name = at[order], far[order], name[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        keep = nth < self.k
        self.at, self.far, self.id = at[keep], far[keep], name[keep]
        full = nth == self.k - 1
        self.bound[at[full]] = far[full]
        self.fresh, self.have = [], 0

    def rows(self):
        if self.q is None:
            return
        self.settle()
        yield pa.RecordBatch.from_arrays([pa.array(self.own[self.at]), pa.array(self.id), pa.array(self.far)], ["query_id", "vec_id", "score"])


def calibrate(placed: DataFrame, tree: Tree, asked: DataFrame, k: int, goal: float, held: np.ndarray, queries: int, shrink: float = 1.0) -> int:
    """The fewest leaves that give mean recall ``goal`` over all rows, for ``queries`` queries: (id, v), chosen by hash."""
    some = asked.orderBy(F.xxhash64("id", "v"), "id").limit(queries).toArrow()
    qid, q = some.column("id").to_numpy(), matrix(some.column("v"))

    def work(batches):
        best: list = [[] for _ in qid]
        for b in batches:
            if not b.num_rows:
                continue
            ids, v, leaf = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy()
            for i in range(len(qid)):
                near, far = nearest_rows(ids, v, qid[i], q[i], k)
                best[i] = sorted([*best[i], *zip(far.tolist(), ids[near].tolist(), leaf[near].tolist(), strict=True)])[:k]
        rows = [(i, *x) for i, b in enumerate(best) for x in b]
        yield pa.RecordBatch.from_pylist([dict(zip(("q", "far", "id", "leaf"), r, strict=True)) for r in rows], schema=pa.schema([("q", pa.int32()), ("far", pa.float64()), ("id", pa.int64()), ("leaf", pa.int64())]))

    near = placed.select("id", "v", "leaf").mapInArrow(work, "q int, far double, id long, leaf long")
    w = Window.partitionBy("q").orderBy("far", "id", "leaf")
    found = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("q", "leaf").toArrow()  # queries times k rows
    need = []
    at, leaf = found.column("q").to_numpy(), found.column("leaf").to_numpy()
    for i in range(len(qid)):
        order = tree.search(q[i] * shrink, tree.n_leaves, held)
        place = dict(zip(order, range(1, len(order) + 1), strict=True))
        need += [place[x] for x in leaf[at == i].tolist()]
    need = np.sort(need)
    return int(need[min(len(need) - 1, int(np.ceil(goal * len(need))) - 1)]) if len(need) else 1


def search_nearest(
    rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, fit_rows: int = 20_000, leaf_rows: int = 256, calibrated_recall: float = 0.95, block_queries: int = 4096, test_queries: int = 64
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query."""
    spark = rows.sparkSession
    every = clean_vectors(rows, id_col, vec_col, drop_zero=True)
    asked = clean_vectors(queries, id_col, vec_col, drop_zero=True)
    size = every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    every, asked = every.where(F.size("v") == size["d"]), asked.where(F.size("v") == size["d"])
    fit = every.orderBy(F.xxhash64("id", "v"), "id").limit(fit_rows)
    # the tree sees vectors small enough for squares; distances are those of the vectors as they are
    top = every.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    shrink = 2.0 ** -max(0, math.frexp(top)[1] - 480)
    x = matrix(fit.select("v").toArrow().column(0)) * shrink
    tree = Tree(x, leaf_rows=max(FEWEST, round(leaf_rows * len(x) / size["count"])))

    def place(batches):
        for b in batches:
            leaf = tree.assign(matrix(b.column(1)) * shrink) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["id", "v", "leaf"])

    kind = "id long, v array<double>, leaf long"
    placed = written(every.mapInArrow(place, kind), "ann-rows")
    # One number a leaf; leaves are bounded by fit_rows.
    counts = placed.groupBy("leaf").count().toArrow()
    held = np.zeros(tree.n_leaves, np.int64)
    held[counts.column("leaf").to_numpy()] = counts.column("count").to_numpy()
    visits = calibrate(placed, tree, asked, k, calibrated_recall, held, test_queries, shrink)
    # A query has to meet k rows besides those of its own id.
    again = placed.groupBy("id").agg(F.count("*").alias("same")).where("same > 1")
    asked = asked.groupBy("id").agg(F.min(F.struct(F.xxhash64("v"), "v"))["v"].alias("v"))
    asked = asked.join(again, "id", "left").select("id", "v", F.coalesce("same", F.lit(1).cast("long")).alias("same"))

    def walk(batches):
        for b in batches:
            if not b.num_rows:
                continue
            found = [tree.search(q, visits, held, k + n) for q, n in zip(matrix(b.column(1)) * shrink, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32())), pa.array([f[0] for f in found], pa.int32())], ["id", "v", "leaves", "first"])

    walked = written(asked.mapInArrow(walk, "id long, v array<double>, leaves array<int>, first int"), "ann-queries")
    firsts = walked.groupBy("first").count().orderBy("first").toArrow()  # one number a leaf
    table, n_blocks = query_blocks(firsts.column("first").to_pylist(), firsts.column("count").to_pylist(), block_queries)
    if not n_blocks:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame(table, "first int, block long, many long")  # a row a leaf at most
    walked = walked.join(F.broadcast(table), "first").select("id", "v", "leaves", (F.col("block") + F.pmod(F.xxhash64("id"), "many")).alias("block"))
    # Each block of queries meets the rows in parts of all leaves, so a query gives k rows a part, not a leaf.
    parts = max(PARTS, -(-size["count"] // (ROWS_A_PART * n_blocks)))
    wanted = written(walked.select(F.explode("leaves").alias("leaf"), "block").distinct(), "ann-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    left = placed.join(wanted, "leaf").select("block", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("part"), F.col("leaf").cast("int").alias("leaf"), "id", "v", F.lit(None).cast("array<int>").alias("leaves"))
    right = walked.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).alias("leaf"), "id", "v", "leaves")
    met = right.union(left).repartition("block", "part").sortWithinPartitions("block", "part", "leaf")

    def join(batches):
        at, near = None, None
        for b in batches:
            if not b.num_rows:
                continue
            block, part, leaf = (b.column(c).to_numpy() for c in range(3))
            new = np.append(True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (leaf[1:] != leaf[:-1]))
            starts = np.flatnonzero(new)
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
                if at != (block[i], part[i]):
                    if near is not None:
                        yield from near.rows()
                    at, near = (block[i], part[i]), Nearest(k, tree.n_leaves)
                ids, v = b.column(3).slice(i, j - i).to_numpy(), matrix(b.column(4).slice(i, j - i))
                if leaf[i] < 0:
                    near.ask(ids, v, b.column(5).slice(i, j - i))
                else:
                    near.meet(int(leaf[i]), ids, v)
        if near is not None:
            yield from near.rows()

    near = met.mapInArrow(join, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann_kmeans_tree(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search_nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding")
