"""Contrasts of series: states, coherence, fidelity of a null series, two-sample resampling, hashed term vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import uniform
from .stats import fluctuation, poisson_weight

PARTS = ("full", "first", "second", "stable", "unstable")


def state_contrast(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, quantile: float, scales: list[int], delta: float) -> DataFrame:
    """Fluctuation exponents of a series, of its halves, and of its calm and restless windows, and whether they differ.

    Windows of ``window`` rows are restless when their deviation is above its ``quantile``; rows after the last whole
    window have no state, and a series under two windows is calm.  A part under four times the largest scale gets none.
    """
    w, every = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    x = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(every))
    x = x.withColumn("_w", F.floor(F.col("_i") / window))
    sd = x.where(F.col("_w") < F.floor(F.col("_n") / window)).groupBy(*keys, "_w").agg(F.stddev_samp(value).alias("_sd"))
    sd = sd.join(sd.groupBy(*keys).agg(F.percentile("_sd", quantile).alias("_t")), keys)
    state = F.when((F.col("_n") < 2 * window) | (F.col("_sd") <= F.col("_t")), "stable").when(F.col("_sd") > F.col("_t"), "unstable")
    half = F.when(F.col("_i") < F.floor(F.col("_n") / 2), "first").otherwise("second")
    p = x.join(sd, [*keys, "_w"], "left").withColumn("part", F.explode(F.array_compact(F.array(F.lit("full"), half, state))))
    p = p.withColumn("_k", F.count("*").over(Window.partitionBy(*keys, "part"))).where(F.col("_k") >= 4 * max(scales))
    a = fluctuation(p.select(*keys, "part", "_i", value), [*keys, "part"], ["_i"], value, scales)
    out = a.groupBy(*keys).agg(*[F.max(F.when(F.col("part") == n, F.col("alpha"))).alias(n) for n in PARTS])
    out = out.withColumns({"delta_half": F.abs(F.col("first") - F.col("second")), "delta_state": F.abs(F.col("stable") - F.col("unstable"))})
    return out.withColumn("differs", F.coalesce(F.col("delta_half") > delta, F.lit(False)) | F.coalesce(F.col("delta_state") > delta, F.lit(False)))


def coherence(df: DataFrame, keys: list[str], order: list[str], a: str, b: str, segment: int = 64) -> DataFrame:
    """(keys, harmonic, coherence, segments): Welch's magnitude-squared coherence of two columns at frequency harmonic / segment.

    Segments overlap by half, lose their mean and get a Hann window; a key under two segments gives no rows.
    """
    half = segment // 2
    w, every = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(every))
    at = F.floor(F.col("_i") / half)
    e = x.select(*keys, "_i", "_n", F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), F.explode(F.array(at, at - 1)).alias("_s"))
    e = e.where((F.col("_s") >= 0) & (F.col("_s") * half + segment <= F.col("_n")))
    parts = e.groupBy(*keys, "_s").agg(F.array_sort(F.collect_list(F.struct("_i", "_a", "_b"))).alias("_p")).select(*keys, F.col("_p._a").alias("_a"), F.col("_p._b").alias("_b"))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)

    def spectra(batches):
        for t in batches:
            if not t.num_rows:
                continue
            u, v = (t.column(len(keys) + c).flatten().to_numpy().reshape(-1, segment) for c in (0, 1))
            u, v = (np.fft.rfft((z - z.mean(axis=1, keepdims=True)) * hann, axis=1) for z in (u, v))
            cross = u.conj() * v
            cols = [pa.array(list(z)) for z in (np.abs(u) ** 2, np.abs(v) ** 2, cross.real, cross.imag)]
            yield pa.RecordBatch.from_arrays([*t.columns[: len(keys)], *cols], [*keys, "aa", "bb", "re", "im"])

    kind = ", ".join([*(f"`{k}` {t}" for k, t in parts.select(*keys).dtypes), *(f"{c} array<double>" for c in ("aa", "bb", "re", "im"))])
    s = parts.mapInArrow(spectra, kind).select(*keys, F.posexplode(F.arrays_zip("aa", "bb", "re", "im")).alias("harmonic", "z"))
    m = s.groupBy(*keys, "harmonic").agg(*[F.avg(f"z.{c}").alias(c) for c in ("aa", "bb", "re", "im")], F.count("*").alias("segments")).where("segments > 1")
    return m.select(*keys, "harmonic", ((F.col("re") ** 2 + F.col("im") ** 2) / F.nullif(F.col("aa") * F.col("bb"), F.lit(0.0))).alias("coherence"), "segments")


def coherence_peak(c: DataFrame, keys: list[str], segment: int = 64) -> DataFrame:
    """The lowest frequency of the highest coherence of each key."""
    best = F.max_by("harmonic", F.struct("coherence", -F.col("harmonic")))
    return c.where("coherence IS NOT NULL").groupBy(*keys).agg((best / segment).alias("frequency"), F.max("coherence").alias("coherence"), F.max("segments").alias("segments"))


def null_fidelity(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, lags: int) -> DataFrame:
    """(keys, acf_rmse, distribution_error) of a null series ``y`` against ``x``: how far apart their autocorrelations
    at lags 1 to ``lags`` are, and the largest difference of equal ranks.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w, every = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    c = d.withColumns({f"_{n}": F.col(n) - F.avg(n).over(every) for n in (x, y)})
    c = c.withColumns({f"_{n}{k}": F.col(f"_{n}") * F.lag(f"_{n}", k).over(w) for n in (x, y) for k in range(1, lags + 1)})
    g = c.groupBy(*keys).agg(*[F.avg(F.col(f"_{n}") ** 2).alias(f"_v{n}") for n in (x, y)], *[F.avg(f"_{n}{k}").alias(f"_{n}{k}") for n in (x, y) for k in range(1, lags + 1)])
    apart = [F.pow(F.col(f"_{x}{k}") / (F.col(f"_v{x}") + 1e-30) - F.col(f"_{y}{k}") / (F.col(f"_v{y}") + 1e-30), 2.0) for k in range(1, lags + 1)]
    acf = g.select(*keys, F.sqrt(sum(apart[1:], apart[0]) / lags).alias("acf_rmse"))
    rank = lambda n: d.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(n)).alias("_r"), F.col(n).cast("double").alias(f"_{n}"))
    far = rank(x).join(rank(y), [*keys, "_r"]).groupBy(*keys).agg(F.max(F.abs(F.col(f"_{x}") - F.col(f"_{y}"))).alias("distribution_error"))
    return acf.join(far, keys)


def bootstrap_difference(df: DataFrame, keys: list[str], row: str, group: str, value: str, rounds: int = 200, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """(keys, difference, low, high) of the means of two groups (``group`` true or false), by a Poisson bootstrap.

    A row's weight in a round is a hash of its id and the round, so the rounds need no row to be moved and sums combine
    before the shuffle.  Rounds that leave a group without rows are not counted.
    """
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    d = d.withColumn("_u", uniform(seed, row, "_b")).withColumn("_w", F.when(F.col("_b") == 0, 1).otherwise(poisson_weight("_u")))
    mean = lambda c: F.sum(F.when(c, F.col("_w") * F.col(value))) / F.nullif(F.sum(F.when(c, F.col("_w"))), F.lit(0))
    s = d.groupBy(*keys, "_b").agg((mean(F.col(group)) - mean(~F.col(group))).alias("s"))
    at = s.groupBy(*keys).agg(F.max(F.when(F.col("_b") == 0, F.col("s"))).alias("difference"), F.array_sort(F.collect_list(F.when(F.col("_b") > 0, F.col("s")))).alias("_r"))
    n, tail = F.size("_r"), (1 - confidence) / 2
    low, high = F.floor(n * F.lit(tail)).cast("int") + 1, F.ceil(n * F.lit(1 - tail)).cast("int")
    return at.where(n >= rounds / 2).select(*keys, "difference", F.element_at("_r", low).alias("low"), F.element_at("_r", high).alias("high"))


def term_vectors(df: DataFrame, key: str, text: str, dimension: int = 384) -> DataFrame:
    """(key, place, weight): unit vectors of hashed words; a word adds to 16 places, by the byte pairs of its SHA-256."""
    words = df.select(key, F.explode(F.split(F.lower(text), r"\s+")).alias("word")).where("word <> ''").groupBy(key, "word").count()
    byte = lambda at: F.conv(F.substring(F.col("h"), at, F.lit(2)), 16, 10).cast("int")
    b = words.select(key, "count", F.sha2("word", 256).alias("h"), F.explode(F.sequence(F.lit(1), F.lit(61), F.lit(4))).alias("at"))
    v = b.groupBy(key, (byte(F.col("at")) % dimension).alias("place")).agg(F.sum(F.col("count") * byte(F.col("at") + 2)).alias("x")).where("x > 0")
    return v.select(key, "place", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))).alias("weight"))
