"""Linear quantile regressors (low, mid, high) fitted by majorisation: every pass is one aggregate over all rows.

The pinball loss of a quantile q is majorised at the residuals r of the last pass by squares with weights
1 / (eps + |r|); the next coefficients solve d x d normal equations whose sums Spark takes in one pass for all quantiles.
eps shrinks from pass to pass.  Of many rows, those far from all lines of a first fit on a sample only push by their
side: they are summed up once, the passes go over the rows near a line, and a last look at all rows finds whether one of
the others has changed its side, after which wider bands are taken.  Rows with a null or non-finite feature or target take no part in the fit; a prediction
takes 0 for a missing feature, and puts the quantiles of a row in order, so they never cross.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.sources.files import work_path


@dataclass(frozen=True)
class QuantileModel:
    features: tuple[str, ...]
    quantiles: tuple[float, ...]
    #: A row for each quantile: the constant, then a coefficient for each feature.
    coefficients: tuple[tuple[float, ...], ...]
    passes: int

    def predict(self, df: DataFrame, names: tuple[str, ...] = ("low", "mid", "high")) -> DataFrame:
        """``df`` with a column for each quantile, in order."""
        lines = F.array_sort(F.array(*[self.line(c) for c in self.coefficients]))
        return df.withColumns({n: lines[i] for i, n in enumerate(names)})

    def line(self, c: tuple[float, ...]) -> Column:
        out = F.lit(c[0])
        for f, b in zip(self.features, c[1:], strict=True):
            v = F.col(f).cast("double")
            out = out + F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v) * b
        return out


def sums_of(x: np.ndarray, y: np.ndarray, beta: np.ndarray, qs: tuple[float, ...], eps: float) -> np.ndarray:
    """For each quantile: weighted products, right side, loss."""
    own = []
    for c, q in zip(beta, qs, strict=True):
        r = y - x @ c
        w = 1 / (eps + np.abs(r))
        own.append(np.concatenate([((x * w[:, None]).T @ x).ravel(), x.T @ (w * y) + (2 * q - 1) * x.sum(axis=0), [np.where(r >= 0, q * r, (q - 1) * r).sum()]]))
    return np.stack(own)


def summed(of_batch):
    """A task's sum of what ``of_batch`` makes of features (with the constant) and targets, as numbered values."""

    def work(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x, y = matrix(b)
                total = of_batch(x, y) if total is None else total + of_batch(x, y)
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    return work


def matrix(b) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([np.ones(b.num_rows), *[c.to_numpy() for c in b.columns[:-1]]], axis=1), b.columns[-1].to_numpy()


def totals(z: DataFrame, of_batch, rows: int, cols: int) -> np.ndarray:
    """``summed`` over all tasks, as a table."""
    found = z.mapInArrow(summed(of_batch), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(rows * cols)
    flat[found.column("i").to_numpy()] = found.column("v").to_numpy()
    return flat.reshape(rows, cols)


def settled(sums_at, beta: np.ndarray, n: int, passes: int, tolerance: float, eps: float) -> tuple[np.ndarray, int]:
    """Passes until the loss a row settles; ``sums_at`` gives the sums at coefficients and eps."""
    d = beta.shape[1]
    last, done = np.inf, 0
    for done in range(1, passes + 1):
        flat = sums_at(beta, eps)
        loss = float(flat[:, -1].sum()) / n
        beta = np.stack([np.linalg.lstsq(f[: d * d].reshape(d, d), f[d * d : -1], rcond=None)[0] for f in flat])
        if eps <= 1e-7 and abs(last - loss) <= tolerance * max(loss, 1e-30):
            break
        last, eps = loss, max(1e-7, eps * 0.6)
    return beta, done


def first_fit(qs: tuple[float, ...], d: int, share: float, passes: int, tolerance: float):
    """Coefficients and half widths of bands that hold ``share`` of the rows, by quantile, of one task's rows."""

    def work(batches):
        parts = [matrix(b) for b in batches if b.num_rows]
        if not parts:
            return
        x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        beta, _ = settled(lambda c, eps: sums_of(x, y, c, qs, eps), np.zeros((len(qs), d)), len(y), passes, tolerance, 1.0)
        band = np.quantile(np.abs(y[:, None] - x @ beta.T), share, axis=0)
        flat = np.concatenate([beta, band[:, None]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    return work


def near_fit(z: DataFrame, beta: np.ndarray, band: np.ndarray, qs: tuple[float, ...], n: int, passes: int, tolerance: float) -> tuple[np.ndarray, int, int]:
    """Coefficients from the rows within the bands about the lines of ``beta``, the others by their sides; passes over those
    rows; how many of the others have changed their side."""
    d, up = beta.shape[1], np.array(qs)[:, None]

    def far(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = y[:, None] - x @ beta.T
        out = (np.abs(r) > band).all(axis=1)
        return out, r[out] > 0

    def sides(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, above = far(x, y)
        xy = np.concatenate([x, y[:, None]], axis=1)[out]
        return np.concatenate([above.T.astype(float) @ xy, (~above).T.astype(float) @ xy], axis=1)

    def close(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(~far(*matrix(b))[0]))

    path = work_path(z.sparkSession, "quantile-near")
    z.mapInArrow(close, z.schema).write.parquet(path)
    few = z.sparkSession.read.schema(z.schema).parquet(path)
    pushed = totals(z, sides, len(qs), 2 * (d + 1))
    above, below = pushed[:, : d + 1], pushed[:, d + 1 :]
    push = 2 * up * above[:, :d] + (2 * up - 2) * below[:, :d]

    def sums_at(c: np.ndarray, eps: float) -> np.ndarray:
        flat = totals(few, lambda x, y: sums_of(x, y, c, qs, eps), len(qs), d * d + d + 1)
        flat[:, d * d : -1] += push
        for f, a, b, q, line in zip(flat, above, below, qs, c, strict=True):
            f[-1] += q * (a[d] - a[:d] @ line) + (q - 1) * (b[d] - b[:d] @ line)
        return flat

    fit, done = settled(sums_at, beta, n, passes, tolerance, float(max(1e-7, band.max())))

    def crossed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, was = far(x, y)
        return np.array([float(((y[out, None] - x[out] @ fit.T > 0) != was).any(axis=1).sum())])

    return fit, done, int(totals(z, crossed, 1, 1)[0, 0])


def fit_quantiles(df: DataFrame, features: list[str], target: str, quantiles: tuple[float, ...] = (0.2, 0.5, 0.8), passes: int = 80, tolerance: float = 1e-9, sample: int = 200_000, share: float = 0.02, looks: int = 5) -> QuantileModel | None:
    """Fit all quantiles over all rows; None without rows.

    Over five times ``sample`` rows, the lines of about ``sample`` rows come first, of one task, and bands about them that
    hold ``share`` of the rows; if bands were too narrow in so many ``looks`` at all rows, passes go over all rows.
    """
    cols = [*features, target]
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    ok = F.lit(True)
    for c in rows.columns:
        ok &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.where(ok)
    m = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in rows.columns], *[F.stddev_pop(c).alias(f"s{c}") for c in rows.columns]).first()
    if not m["n"]:
        return None
    mean = np.array([m[f"m{c}"] for c in rows.columns])
    scale = np.array([m[f"s{c}"] or 1.0 for c in rows.columns])
    path = work_path(df.sparkSession, "quantile-rows")
    rows.select(*[((F.col(c) - float(a)) / float(b)).alias(c) for c, a, b in zip(rows.columns, mean, scale, strict=True)]).write.parquet(path)
    z = df.sparkSession.read.schema(", ".join(f"{c} double" for c in rows.columns)).parquet(path)
    d, n = len(features) + 1, m["n"]
    beta, done, crossed = np.zeros((len(quantiles), d)), 0, 1
    if n > 5 * sample:
        drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id(), *z.columns), F.lit(n)) < sample  # equal rows are drawn one by one
        found = z.where(drawn).coalesce(1).mapInArrow(first_fit(quantiles, d, share, passes, tolerance), "i int, v double").toArrow()
        flat = np.zeros(len(quantiles) * (d + 1))
        flat[found.column("i").to_numpy()] = found.column("v").to_numpy()
        beta, band = flat.reshape(-1, d + 1)[:, :d], flat.reshape(-1, d + 1)[:, d]
        for _ in range(looks):
            fit, more, crossed = near_fit(z, beta, band, quantiles, n, passes, tolerance)
            done += more
            if not crossed:
                beta = fit
                break
            band = 4 * band
    if crossed:
        beta = np.zeros((len(quantiles), d))
        every = lambda c, eps: totals(z, lambda x, y: sums_of(x, y, c, quantiles, eps), len(quantiles), d * d + d + 1)
        beta, more = settled(every, beta, n, passes, tolerance, 1.0)
        done += more
    out = []
    for c in beta:
        slope = c[1:] * scale[-1] / scale[:-1]
        out.append((float(mean[-1] + scale[-1] * c[0] - slope @ mean[:-1]), *map(float, slope)))
    return QuantileModel(tuple(features), tuple(quantiles), tuple(out), done)


def coverage(predicted: DataFrame, keys: list[str], target: str) -> DataFrame:
    """(keys, n, below, above): rows, and the shares of them under ``low`` and over ``high``."""
    return predicted.where(F.col(target).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(target) < F.col("low")).cast("int")).alias("below"), F.avg((F.col(target) > F.col("high")).cast("int")).alias("above"))
