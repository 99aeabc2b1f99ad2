"""Text and vector search: segments, BM25, cosine, hybrid rank, re-rank, books, memories, weighted picks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.sources.files import work_path


def tokens(c: str) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def segments(docs: DataFrame, key: str, text: str, size: int = 200, overlap: int = 40) -> DataFrame:
    """Windows of ``size`` tokens that overlap: (key, nth, segment)."""
    step = size - overlap
    d = docs.select(key, tokens(text).alias("t")).where(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("t") - overlap - 1), F.lit(step))
    d = d.select(key, "t", F.posexplode(starts).alias("nth", "at"))
    return d.select(key, "nth", F.array_join(F.slice("t", F.col("at") + 1, size), " ").alias("segment"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, k: int, k1: float = 1.6, b: float = 0.75, extra: list[str] | None = None, most_terms: int = 2_000_000, task_rows: int = 1_000_000) -> DataFrame:
    """Best k documents of each query; every scored document if k is 0. Statistics are of all documents.

    Documents are cut into words twice, for their mean length and for their postings; only words that a query has are
    counted. The queries are broadcast while they hold ``most_terms`` words at most, else joined by word.
    Words are dealt by document before they meet the queries, so that with a broadcast no pair of a query and a document is
    shuffled: scores are summed up, and the best k of a task are found, where the document is.
    ``extra`` columns of the documents come along.
    """
    q = queries.select(query, F.explode(F.array_distinct(tokens(query_text))).alias("term"))
    shared = F.broadcast if q.count() <= most_terms else (lambda df: df)
    some = docs.where(F.col(text).isNotNull())
    stats = some.agg(F.count("*").alias("docs"), F.avg(F.size(tokens(text))).alias("mean"))  # one row
    words = some.select(key, *(extra or []), tokens(text).alias("_t")).select(key, *(extra or []), F.size("_t").alias("len"), F.explode("_t").alias("term"))
    words = words.join(shared(q.select("term").distinct()), "term", "left_semi")
    p = words.groupBy(key, *(extra or []), "len", "term").agg(F.count("*").alias("tf"))
    path = work_path(docs.sparkSession, "postings")
    p.write.parquet(path)
    p = docs.sparkSession.read.schema(p.schema).parquet(path)
    df = p.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query word
    met = df.join(q.groupBy("term").agg(F.count("*").alias("n")), "term").agg(F.sum(F.col("df") * F.col("n")).alias("n")).first()["n"]  # one number
    tasks = min(4096, -(-int(met or 0) // task_rows))  # of about so many meetings of a query and a document by a word
    w = p.join(shared(df), "term").crossJoin(F.broadcast(stats))
    if shared is F.broadcast:
        w = w.repartition(max(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
    idf = F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    w = w.select(key, *(extra or []), "term", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))).alias("w"))
    s = w.join(shared(q), "term").groupBy(query, key, *(extra or [])).agg(F.sum("w").alias("score"))
    return top(s, [query], [F.round("score", 9).desc(), F.col(key)], k) if k else s


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine_top(rows: DataFrame, key: str, vec: str, queries: DataFrame, query: str, k: int, block_rows: int = 4096) -> DataFrame:
    """Exact cosine over all rows for a stated set of queries: blocks of rows meet blocks of queries, each pair of
    blocks gives its best k, and these are merged. Vectors of another length than the most common one take no part."""
    kind = f"{query} long, {key} long, score double"
    first = rows.where(F.size(vec) > 0).groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if first is None:
        return rows.sparkSession.createDataFrame([], kind)
    clean = lambda df: df.where(F.size(vec) == first["d"]).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    a, b = clean(rows), clean(queries)
    na, nb = max(1, -(-a.count() // block_rows)), max(1, -(-b.count() // block_rows))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = a.select("id", "v", block(na).alias("i"), every(nb).alias("j"))
    right = b.select("id", "v", every(na).alias("i"), block(nb).alias("j"))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if x.num_rows and y.num_rows:
            ids, qids = x.column("id").to_numpy(), y.column("id").to_numpy()
            v, q = (np.stack(t.column("v").to_numpy(zero_copy_only=False)) for t in (x, y))
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            v, q = unit(v), unit(q)
            for n in range(len(qids)):
                s = v @ q[n]
                ok = np.flatnonzero(ids != qids[n])
                order = ok[np.lexsort((ids[ok], -np.round(s[ok], 9)))][:k]
                out.append(pa.table({query: np.full(len(order), qids[n]), key: ids[order], "score": s[order]}))
        return pa.concat_tables(out) if out else pa.table({query: pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, kind)
    return top(near, [query], [F.round("score", 9).desc(), F.col(key)], k)


def hybrid(a: DataFrame, b: DataFrame, query: str, key: str, k: int, wa: float = 0.55, wb: float = 0.45) -> DataFrame:
    j = a.select(query, key, F.col("score").alias("sa")).join(b.select(query, key, F.col("score").alias("sb")), [query, key], "full")
    j = j.withColumn("score", wa * F.coalesce("sa", F.lit(0.0)) + wb * F.coalesce("sb", F.lit(0.0)))
    return top(j, [query], [F.round("score", 9).desc(), F.col(key)], k).select(query, key, "score", "rank")


def freshness(age_days: Column, half_life: float, horizon: float) -> Column:
    return F.when(age_days > horizon, 0.0).otherwise(F.pow(F.lit(0.5), age_days / half_life))


def rerank(score: Column, fresh: Column, weight: Column, tags: Column, wanted: Column, links: Column) -> Column:
    """Score times freshness, source weight, tag factor (1 without tags, 0.8 without overlap) and authority."""
    hits = F.size(F.array_intersect(tags, wanted))
    factor = F.when(F.size(wanted) == 0, 1.0).when(hits == 0, 0.8).otherwise(1 + 0.15 * hits)
    return score * fresh * weight * factor * (1 + 0.03 * F.least(links, F.lit(10)))


def best_levels(levels: DataFrame, book: str, side: str, price: str, n: int) -> DataFrame:
    order = F.when(F.col(side) == "bid", -F.col(price)).otherwise(F.col(price))
    return top(levels, [book, side], [order, F.col("place")], n, "level")


def recall_memories(df: DataFrame, text: str, needle: str, ts: str, since, tags: str, wanted: list[str], n: int) -> DataFrame:
    d = df.where(F.contains(F.col(text), F.lit(needle)) & (F.col(ts) >= F.lit(since)) & F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted])))
    return d.orderBy(F.desc(ts)).limit(n)


def uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) from a hash of the row's key: the same on every run and every cluster."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def weighted_pick(df: DataFrame, key: str, weight: str, n: int, seed: int = 3) -> DataFrame:
    """n rows without replacement with chances by weight: the smallest -ln(u) / weight."""
    return df.where(F.col(weight) > 0).withColumn("race", -F.ln(uniform(seed, key)) / F.col(weight)).orderBy("race", key).limit(n)


def sign_code(vec: str, width: int, dim: int, seed: int = 11) -> Column:
    """+1/-1 code of a vector: signs of projections on fixed +1/-1 directions made from a hash of (row, column)."""
    rows = F.sequence(F.lit(0), F.lit(width - 1))
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    side = lambda i, j: F.when(F.pmod(F.xxhash64(F.lit(seed), i, j), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return F.transform(rows, lambda i: F.when(F.aggregate(F.transform(at, lambda j: F.get(vec, j).cast("double") * side(i, j)), F.lit(0.0), lambda a, x: a + x) >= 0, 1).otherwise(-1))
