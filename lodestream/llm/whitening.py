"""Embedding whitening by a covariance weighted with multiplicities.

Vectors become whole numbers x = floor(64 * c) + 1000000.  Equal x vectors are counted first, summed in each task before
the shuffle, so a vector that a third of all rows share is one row from there on.  Sums, the centred products and the
whitened values are taken once for each distinct vector, with its count (``weights="counts"``) or one
(``weights="one"``) as fit weight, and go back to the rows by a join on the vector itself, which Spark may split where
one vector is hot.  The driver sees d sums, then a d x d matrix, then one number; d is the vectors' length.

Sums, n * x - S and the squared deviation are exact whole numbers: 64-bit where they fit, Python's beyond that.  The
covariance is a product of centred blocks in double precision.

Defined results: a null vector, or one with a null or non-finite entry, takes no part, nor does one without entries;
vectors of another length than the most frequent one (of equally frequent ones, the longest) take no part; zero vectors
do take part; rows without id stay, repeated rows are rows of their own, other columns are left out; entries whose
64-fold is beyond +-2^62 count as that bound; directions without variance (eigenvalue under 1e-12 of the largest) give no
component, so a table of equal vectors gives no rows, like an empty one; a deviation beyond 38 digits is null.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, OFFSET = 64, 1_000_000
BOUND = float(1 << 62)
WIDE = pa.decimal128(38, 0)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x array<long>) of the rows that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("v IS NOT NULL AND size(v) > 0").where(~bad)
    x = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c * SCALE))).cast("long") + OFFSET)
    rows = rows.select("id", x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()  # two numbers
    return rows if len(sizes) < 2 else rows.where(F.size("x") == sizes[0]["d"])


def whole_matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    a = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def exact(x: np.ndarray, *factors: int) -> np.ndarray:
    """``x`` as 64-bit numbers if its entries times all factors stay below 2^62, else as Python's whole numbers."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)
    for f in factors:
        top *= max(1, abs(int(f)))
    return x if top < 1 << 62 else x.astype(object)


def vector_sums(batches):
    """Sums of each dimension in a task; dimension -1 holds the weight."""
    total, weight = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        w = b.column(1).to_numpy()
        n = int(w.sum())
        x = exact(whole_matrix(b.column(0), b.num_rows), n)
        s = [int(v) for v in (w.astype(x.dtype) @ x)]
        total = s if total is None else [p + q for p, q in zip(total, s, strict=True)]
        weight += n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([Decimal(v) for v in (weight, *total)], WIDE)], ["i", "s"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    top = max(abs(s) for s in sums)
    x = exact(x, n)
    if x.dtype != object and top >= 1 << 61:
        x = x.astype(object)
    return x * n - np.array(sums, dtype=x.dtype)


def products(make):
    """Partial sums of w * c_i * c_j over a task's blocks, a row for each i."""

    def work(batches):
        total = None
        for b in batches:
            if b.num_rows:
                c, w = make(b)
                g = (c * w[:, None]).T @ c
                total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "g"])

    return work


def gram(df: DataFrame, make, d: int) -> np.ndarray:
    """The d x d matrix of products, summed entry by entry in Spark."""
    parts = df.mapInArrow(products(make), "i int, g array<double>")
    sums = parts.select("i", F.posexplode("g").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((d, d))
    out[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    return (out + out.T) / 2


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32, weights: str = "counts") -> DataFrame:
    """(id, n, deviation decimal, whitened array, explained array, identity_error) of every row that takes part.

    The arrays go by component, by falling eigenvalue; ``n`` is the weight of the fit list.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights: 'counts' or 'one'")
    spark = df.sparkSession
    rows = whole_vectors(df, id_col, vec_col)
    named = rows.withColumn("h", F.xxhash64("x"))
    # the hash only spares comparisons of whole vectors; groups are made by the vector
    distinct = named.groupBy("h", "x").agg((F.count("*") if weights == "counts" else F.lit(1).cast("long")).alias("w"))
    distinct = written(distinct, "distinct-vectors")
    found = distinct.select("x", "w").mapInArrow(vector_sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    sums = {r["i"]: int(r["s"]) for r in found.collect()}  # a number for each dimension
    none = spark.createDataFrame([], "id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    if not sums:
        return none
    n, s = sums.pop(-1), [v for _, v in sorted(sums.items())]
    d = len(s)

    def offsets(b, n=n, s=s):
        return centred(whole_matrix(b.column(0), b.num_rows), n, s).astype(np.float64) / n, b.column(1).to_numpy()

    cov = gram(distinct.select("x", "w"), offsets, d) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-12 * max(e[0], 0)).sum())) if e[0] > 0 else 0
    if not k:
        return none
    to = u[:, :k] / np.sqrt(e[:k])

    def project(batches, n=n, s=s, to=to):
        for b in batches:
            if not b.num_rows:
                continue
            c = centred(whole_matrix(b.column(1), b.num_rows), n, s)
            wide = c if int(np.abs(c).max()) ** 2 * c.shape[1] < 1 << 62 else c.astype(object)
            dev = [int(v) for v in (wide * wide).sum(axis=1)]
            dev = pa.array([Decimal(v) if v < 10**38 else None for v in dev], WIDE)
            y = (c.astype(np.float64) / n) @ to
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), dev, pa.array(list(y), pa.list_(pa.float64()))], ["h", "x", "w", "deviation", "whitened"])

    once = written(distinct.mapInArrow(project, "h long, x array<long>, w long, deviation decimal(38,0), whitened array<double>"), "whitened-vectors")
    values = once.select("whitened", "w")
    y0 = values.mapInArrow(mean_parts, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    centre = np.array([r["s"] for r in sorted(y0, key=lambda r: r["i"])]) / n

    def about(b, centre=centre):
        return b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) - centre, b.column(1).to_numpy()

    error = float(np.abs(gram(values, about, k) / n - np.eye(k)).max())
    explained = F.array(*[F.lit(float(v)) for v in e[:k] / np.trace(cov)])
    back = named.join(once.select("h", "x", "deviation", "whitened"), ["h", "x"])
    return back.select("id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def mean_parts(batches):
    total = None
    for b in batches:
        if b.num_rows:
            y = b.column(1).to_numpy() @ b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            total = y if total is None else total + y
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "s"])


def op13_embedding_whitening(spark, sf_dir):
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = out.select("id", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return out.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
