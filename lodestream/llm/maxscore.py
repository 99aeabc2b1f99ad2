"""Exact top-k inner products by MaxScore over sharded postings.

Terms are the vector dimensions.  A task keeps the rows it has read as a shard: postings (row, value) of each term, the
rows sorted so that similar ones lie together, in blocks that know the largest and smallest value of each term.  For a
query:

1. Its threshold is the k-th best score known so far: of a common sample of ``seed_rows`` rows, met by all shards, then
   of the rows that the task has scored already.
2. Blocks whose bound over all terms is under the threshold are skipped.
3. Terms are ordered by the width of their bounds over the blocks left; the narrow ones whose widths together cannot
   lift any row over the threshold are non-essential.  Essential postings are traversed.
4. The rows that can still compete are probed in the non-essential postings, the widest first, and leave as soon as
   their bound falls below the threshold.

A row leaves only if its bound is strictly below, so none that ties with the k-th score is skipped.  The shards' best are
merged.  Rows are neither copied nor shuffled: queries come to them in blocks of ``query_rows``, one pass over the rows
for each block, and what is shuffled is a shard's best of each query that reach the common threshold.

Components are integers floor(scale * x).  Scores are exact while bounds stay under 2**53, which holds for components
up to 2**23 in size at 64 dimensions; larger ones are multiplied as Python integers, and a score beyond 64 bits is an
error.  Vectors that are null, empty, or hold null or non-finite components take no part, nor do those of another length
than the most common one.  Ties go to the smaller id; a query never finds its own id; repeated ids are separate
candidates, and a repeated query id is answered for the vector of its smallest hash; empty tables give no rows; columns
beside id and vector are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import clean_vectors, matrix

BLOCK, TOGETHER = 64, 32


def alike(v: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size``: halves by the component of the largest spread, until they are small."""
    todo, ends = [np.arange(len(v))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            ends.append(rows)
            continue
        d = int(np.argmax(v[rows].std(axis=0))) if v.dtype != object else 0
        rows = rows[np.argsort(v[rows, d], kind="stable")]
        todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return ends


class Shard:
    """Posting lists of some rows, alike rows in one block, with the bounds of each block's terms."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        ends = alike(v, BLOCK)
        order = np.concatenate(ends)
        self.ids = ids[order]
        self.postings = np.ascontiguousarray(v[order].T)
        self.start = np.append(0, np.cumsum([len(e) for e in ends]))
        self.high = np.maximum.reduceat(self.postings, self.start[:-1], axis=1).T
        self.low = np.minimum.reduceat(self.postings, self.start[:-1], axis=1).T
        self.seen = np.zeros(4, np.int64)  # values, values traversed or probed; rows, rows that competed to the end

    def best(self, q: np.ndarray, own: np.ndarray, k: int, theta: np.ndarray, probe: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of the ``k`` best rows of each query that reach its ``theta``.

        The queries are traversed together, with the essential terms of any of them.
        """
        self.seen += [self.postings.size * len(q), 0, len(self.ids) * len(q), 0]
        bound = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        blocks = np.flatnonzero((bound >= theta[:, None]).any(axis=0))
        if not len(blocks):
            return np.zeros(0, np.int64), self.ids[:0], np.zeros(0, q.dtype)
        high, low = self.high[blocks].max(axis=0), self.low[blocks].min(axis=0)
        top, floor = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        order = np.argsort(-(top - floor).sum(axis=0), kind="stable")
        # what terms from here on can add, at most and beyond the least
        after = np.cumsum(top[:, order[::-1]], axis=1)[:, ::-1]
        spread = np.cumsum((top - floor)[:, order[::-1]], axis=1)[:, ::-1]
        slack = (spread > (theta - floor.sum(axis=1))[:, None]).any(axis=0)
        cut = int(slack.sum())  # no row can reach a threshold by the terms after the cut alone
        cut = min(len(order), max(1, cut))
        after = np.concatenate([after, np.zeros_like(after[:, :1])], axis=1)
        size = self.start[blocks + 1] - self.start[blocks]
        rows = np.repeat(self.start[blocks] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        some = self.postings if len(rows) == len(self.ids) else self.postings[:, rows]
        partial = q[:, order[:cut]] @ some[order[:cut]]
        self.seen[1] += cut * partial.size
        # while many rows compete, the next postings are cheaper to traverse than to probe
        while cut < len(order) and np.count_nonzero(partial >= (theta - after[:, cut])[:, None]) > 0.05 * partial.size:
            n = order[cut : cut + probe]
            cut += len(n)
            partial += q[:, n] @ some[n]
            self.seen[1] += len(n) * partial.size
        i, r = np.nonzero(partial >= (theta - after[:, cut])[:, None])
        score, r = partial[i, r], rows[r]
        at = cut
        while at < len(order) and len(i):
            n = order[at : at + probe]
            at += len(n)
            self.seen[1] += len(n) * len(i)
            score = score + (q[i[:, None], n] * self.postings[n, r[:, None]]).sum(axis=1)
            keep = score >= theta[i] - after[i, at]
            i, r, score = i[keep], r[keep], score[keep]
        self.seen[3] += len(i)
        ids = self.ids[r]
        keep = ids != own[i]
        i, ids, score = i[keep], ids[keep], score[keep]
        o = np.lexsort((ids, -score, i))
        i, ids, score = i[o], ids[o], score[o]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], ids[keep], score[keep]


def kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if score.shape[1] < k:
        return np.full(len(score), -np.inf)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]


def exact(x: np.ndarray, *others: np.ndarray) -> bool:
    """Whether sums of products stay whole in double precision."""
    return np.abs(x).max(initial=0) * max(np.abs(y).max(initial=0) for y in (x, *others)) * x.shape[1] < 2.0**53


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def wide(x: np.ndarray) -> np.ndarray:
    """Python integers, for components whose products do not fit."""
    return np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)


def top_k(rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 20, scale: float = 64.0, shard_rows: int = 16_384, query_rows: int = 32_768, seed_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest inner products of each query.

    A pass holds ``query_rows`` queries and ``seed_rows`` sampled rows in a task beside a shard of ``shard_rows`` rows;
    any numbers give the same result.
    """
    spark = rows.sparkSession
    every = clean_vectors(rows, id_col, vec_col, drop_zero=False)
    asked = clean_vectors(queries, id_col, vec_col, drop_zero=False)
    sizes = every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every, asked = every.where(F.size("v") == sizes["d"]), asked.where(F.size("v") == sizes["d"])
    asked = asked.groupBy("id").agg(F.min(F.struct(F.xxhash64("v"), "v"))["v"].alias("v"))
    sample = every.select("id", "v").orderBy(F.xxhash64("id", "v"), "id").limit(seed_rows).toArrow()  # seed_rows vectors
    seed_ids, seed_v = sample.column("id").to_numpy(), whole(matrix(sample.column("v")), scale)
    passes = max(1, -(-asked.count() // query_rows))

    def one_pass(p: int) -> DataFrame:
        # at most about query_rows vectors, which the tasks of this pass hold
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).toArrow() if passes > 1 else asked.toArrow()
        qid = block.column("id").to_numpy()
        q = whole(matrix(block.column("v")), scale)
        groups = alike(q, TOGETHER) if len(q) else []

        def work(batches):
            known = None  # the k best scores of each query, from this task and the sample
            held: list = []

            def told():
                nonlocal known
                ids = np.concatenate([h[0] for h in held])
                v = whole(np.concatenate([h[1] for h in held]), scale)
                plain = exact(q, v, seed_v) and exact(v)
                mine, theirs, common = (v, q, seed_v) if plain else (wide(v), wide(q), wide(seed_v))
                if known is None:
                    known = np.full(len(qid), -np.inf)
                    if plain:
                        for a in range(0, len(qid), 1024):
                            s = theirs[a : a + 1024] @ common.T
                            s[seed_ids[None, :] == qid[a : a + 1024, None]] = -np.inf
                            known[a : a + 1024] = kth(s, k)
                shard = Shard(ids, mine)
                found = []
                for g in groups:
                    i, near, score = shard.best(theirs[g], qid[g], k, known[g])
                    if plain:
                        last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
                        known[g[i[last]]] = np.maximum(known[g[i[last]]], score[last])
                    elif any(abs(int(x)) >= 1 << 63 for x in score):
                        raise OverflowError("a score does not fit 64 bits")
                    found.append((qid[g[i]], near, score.astype(np.int64)))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

            for b in batches:
                if b.num_rows and len(qid):
                    held.append((b.column(0).to_numpy(), matrix(b.column(1))))
                    if sum(len(h[0]) for h in held) >= shard_rows:
                        yield told()
                        held = []
            if held:
                yield told()

        return every.select("id", "v").mapInArrow(work, "query_id long, vec_id long, score long")

    # several passes run one after the other, so the driver holds the queries of one at a time
    best = one_pass(0) if passes == 1 else reduce(DataFrame.union, [written(one_pass(p), "maxscore-pass") for p in range(passes)])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_maxscore_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding")


OP4_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
