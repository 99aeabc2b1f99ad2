"""Cubic splines through uneven points, on uniform grids, for series that no task holds whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .lags import join_null_safe, placed, prefix_sums, sliced

#: A knot this many places away moves a slope by less than 2^-60 of what a neighbour does.
REACH = 64


def slopes(t: np.ndarray, v: np.ndarray, first: bool, last: bool) -> np.ndarray:
    """Slopes at the knots of the spline with continuous second derivatives.

    At a true end of the series (``first``, ``last``) the third derivative runs through the knot next to it; at the end of
    a slice the slope is a guess, which dies out by half or more with each knot.
    """
    n = len(t)
    h, m = np.diff(t), np.diff(v) / np.diff(t)
    if n == 2:
        return np.array([m[0], m[0]])
    if n == 3 and first and last:
        # one parabola through all three
        c = (m[1] - m[0]) / (t[2] - t[0])
        return m[0] + c * (2 * t - t[0] - t[1])
    low, mid, high, right = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    low[1:-1], mid[1:-1], high[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    right[1:-1] = 3 * (h[1:] * m[:-1] + h[:-1] * m[1:])
    if first:
        d = t[2] - t[0]
        mid[0], high[0], right[0] = h[1], d, ((h[0] + 2 * d) * h[1] * m[0] + h[0] ** 2 * m[1]) / d
    else:
        right[0] = m[0]
    if last:
        d = t[-1] - t[-3]
        mid[-1], low[-1], right[-1] = h[-2], d, (h[-1] ** 2 * m[-2] + (2 * d + h[-1]) * h[-2] * m[-1]) / d
    else:
        right[-1] = m[-1]
    for i in range(1, n):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        right[i] -= f * right[i - 1]
    out = np.zeros(n)
    out[-1] = right[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        out[i] = (right[i] - high[i] * out[i + 1]) / mid[i]
    return out


def spline_grid(df: DataFrame, keys: list[str], t: str, value: str, step: float, size: int = 20_000) -> DataFrame:
    """(keys, nth, t, value): the spline of each series at first + nth * step, before its last point.

    Slices of ``size`` knots are solved by themselves with 64 knots more on each side, which gives the whole series'
    spline to the last bits.  Rows with a null or non-finite time or value are left out, of equal times the largest value
    counts; a series of one point gives no rows, two give a line and three a parabola.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    d = df.where(finite(t) & finite(value)).groupBy(*keys, F.col(t).cast("double").alias("_t")).agg(F.max(F.col(value).cast("double")).alias("_v"))
    d = placed(d, keys, ["_t"])
    ends = d.groupBy(*keys).agg(F.min("_t").alias("_begin"), F.count("*").alias("_count"))
    # slices go by place in all series, so a task has at most one slice's knots; series meet in a slice but are solved apart
    d = sliced(join_null_safe(d, ends, keys), REACH, REACH, size)
    kind = StructType([*df.select(*keys).schema]).add("nth", "long").add("t", "double").add("value", "double")

    def solve(t_: pa.Table) -> pa.Table:
        o = np.argsort(t_.column("_pos").to_numpy(), kind="stable")
        x, v, at, own, begin, count = (t_.column(c).to_numpy(zero_copy_only=False)[o] for c in ("_t", "_v", "_at", "_own", "_begin", "_count"))
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1] + 1) + 1), len(x)]
        nth, where, value_, row = [], [], [], []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j - i < 2:
                continue
            a, b, mine = x[i:j], v[i:j], np.flatnonzero(own[i:j])
            if not len(mine):
                continue
            k = slopes(a, b, at[i] == 0, at[j - 1] == count[i] - 1)
            # the grid from the first own knot up to the knot after the last own one
            hi = a[min(mine[-1] + 1, j - i - 1)]
            g = np.arange(np.ceil((a[mine[0]] - begin[i]) / step - 1e-9), np.ceil((hi - begin[i]) / step) + 1).astype(np.int64)
            p = begin[i] + g * step
            keep = (p >= a[mine[0]]) & (p < hi)
            g, p = g[keep], p[keep]
            q = np.clip(np.searchsorted(a, p, "right") - 1, 0, j - i - 2)
            h = a[q + 1] - a[q]
            s = (p - a[q]) / h
            y = (1 + 2 * s) * (1 - s) ** 2 * b[q] + s * (1 - s) ** 2 * h * k[q] + s * s * (3 - 2 * s) * b[q + 1] + s * s * (s - 1) * h * k[q + 1]
            nth.append(g), where.append(p), value_.append(y), row.append(np.full(len(g), o[i]))
        join = lambda parts, kind_: np.concatenate(parts) if parts else np.zeros(0, kind_)
        rows = pa.array(join(row, np.int64))
        return pa.table([*(t_.column(c).take(rows) for c in keys), pa.array(join(nth, np.int64)), pa.array(join(where, float)), pa.array(join(value_, float))], kind.names)

    return d.groupBy("_slice").applyInArrow(solve, kind)


def beats_to_grid(df: DataFrame, keys: list[str], order: list[str], beat: str, rate: float = 4.0) -> DataFrame:
    """Intervals between beats (seconds) as a series at ``rate`` a second: each interval stands at the time of its beat, the
    sum of the intervals so far.  Intervals that are null, not finite or not positive are left out."""
    b = F.col(beat).cast("double")
    d = df.where(b.isNotNull() & ~F.isnan(b) & (b > 0) & (b < float("inf"))).select(*keys, *order, b.alias("_beat"))
    times = prefix_sums(d, keys, order, {"_time": F.col("_beat")})
    return spline_grid(times, keys, "_time", "_beat", 1 / rate)
