"""Statistics over tables: drift, two-sample tests, effect sizes, corrections, resampling, scaling exponents, entropy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .search import uniform


def psi(reference: DataFrame, current: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """Population stability index over the reference's quantile bins; values outside them are dropped, shares clipped."""
    edges = reference.groupBy(*keys).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        d = df.join(edges, keys).where(F.col(value).isNotNull())
        last = F.size("edges")
        at = F.size(F.filter("edges", lambda e: e <= F.col(value)))
        at = F.when(F.col(value) == F.element_at("edges", -1), last - 1).otherwise(at)
        d = d.withColumn("bin", at).where((F.col("bin") > 0) & (F.col("bin") < last))
        total = F.sum("n").over(Window.partitionBy(*keys))
        return d.groupBy(*keys, "bin").agg(F.count("*").alias("n")).select(*keys, "bin", (F.col("n") / total).alias(name))

    every = edges.where(F.size("edges") > 1).select(*keys, F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    j = every.join(shares(reference, "p"), [*keys, "bin"], "left").join(shares(current, "q"), [*keys, "bin"], "left")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-6)) for c in ("p", "q"))
    out = j.groupBy(*keys).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    return edges.select(*keys).join(out, keys, "left").fillna(0.0, ["psi"])


def kolmogorov_smirnov(df: DataFrame, keys: list[str], group: Column, value: str) -> DataFrame:
    """Largest distance of two cumulative shares, and the asymptotic p-value. ``group`` is True for the first sample."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(group).alias("a"), F.count_if(~group).alias("b"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy(*keys)
    g = g.withColumn("n", F.sum("a").over(w)).withColumn("m", F.sum("b").over(w)).withColumn("dist", F.abs(F.sum("a").over(up) / F.col("n") - F.sum("b").over(up) / F.col("m")))
    s = g.groupBy(*keys).agg(F.max("dist").alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))
    en = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    x = (en + 0.12 + 0.11 / en) * F.col("d")
    s = s.withColumn("x", x)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * F.col("x") * F.col("x")))
    return s.select(*keys, "n", "m", "d", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("x") < 1e-3, 1.0).otherwise(terms))).alias("p"))


def two_samples(df: DataFrame, keys: list[str], group: Column, value: str) -> DataFrame:
    """Welch t with degrees of freedom, Cohen d, Hedges g, rank sum U and Cliff's delta, from moments and mid-ranks."""
    v = F.col(value)
    d = df.where(v.isNotNull()).withColumn("_g", group)
    per = d.groupBy(*keys, value).agg(F.count_if("_g").alias("a"), F.count_if(~F.col("_g")).alias("b"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("b").over(up), F.lit(0))
    u = per.withColumn("u", F.col("a") * (before + F.col("b") / 2)).groupBy(*keys).agg(F.sum("u").alias("u"))
    m = d.groupBy(*keys).agg(*[x for n, c in (("a", F.col("_g")), ("b", ~F.col("_g"))) for x in (F.count_if(c).alias(f"n{n}"), F.avg(F.when(c, v)).alias(f"m{n}"), F.var_samp(F.when(c, v)).alias(f"v{n}"))])
    se = F.col("va") / F.col("na") + F.col("vb") / F.col("nb")
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    out = m.join(u, keys)
    cohen = (F.col("ma") - F.col("mb")) / pooled
    return out.select(*keys, "na", "nb", ((F.col("ma") - F.col("mb")) / F.sqrt(se)).alias("t"), (se * se / (F.pow(F.col("va") / F.col("na"), 2) / (F.col("na") - 1) + F.pow(F.col("vb") / F.col("nb"), 2) / (F.col("nb") - 1))).alias("dof"), cohen.alias("cohen_d"), (cohen * (1 - 3 / (4 * (F.col("na") + F.col("nb")) - 9))).alias("hedges_g"), "u", (2 * F.col("u") / (F.col("na") * F.col("nb")) - 1).alias("cliff"))


def corrected(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg of the p-values of each family."""
    w = Window.partitionBy(*family)
    order = w.orderBy(p, tie)
    d = df.withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count("*").over(w))
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    down = w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)  # a frame that ends with the family is read anew for each row
    one = F.lit(1.0)
    d = d.withColumn("bonferroni", F.least(one, F.col(p) * F.col("_m"))).withColumn("holm", F.least(one, F.max(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(up)))
    return d.withColumn("bh", F.least(one, F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).drop("_r", "_m")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return mid - half, mid + half


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the curve from the rank sum, with the Hanley-McNeil standard error."""
    per = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b"))
    up = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    g = per.withColumn("u", F.col("a") * (F.coalesce(F.sum("b").over(up), F.lit(0)) + F.col("b") / 2)).groupBy(*keys).agg(F.sum("u").alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n0"))
    g = g.withColumn("auc", F.col("u") / (F.col("n1") * F.col("n0")))
    q1, q2 = F.col("auc") / (2 - F.col("auc")), 2 * F.col("auc") * F.col("auc") / (1 + F.col("auc"))
    se = F.sqrt((F.col("auc") * (1 - F.col("auc")) + (F.col("n1") - 1) * (q1 - F.col("auc") * F.col("auc")) + (F.col("n0") - 1) * (q2 - F.col("auc") * F.col("auc"))) / (F.col("n1") * F.col("n0")))
    return g.select(*keys, "n1", "n0", "auc", se.alias("se"))


def poisson_weight(u: str) -> Column:
    """Poisson(1) draw from a column of ``uniform``: resampling with replacement, row by row.  It takes a column's name, as
    an expression would be computed anew for each cut where it stands under a condition."""
    total, p, out = 0.0, 0.36787944117144233, None
    for k in range(8):
        total += p
        out = F.when(F.col(u) <= total, k) if out is None else out.when(F.col(u) <= total, k)
        p /= k + 1
    return out.otherwise(8)


def bootstrap_mean(df: DataFrame, keys: list[str], row: str, value: str, rounds: int = 200, seed: int = 5) -> DataFrame:
    """Mean, 95 % interval of resampled means, and a sign-flip p-value; draws hang on row and round only."""
    b = df.where(F.col(value).isNotNull()).select(*keys, row, value, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b"))
    b = b.withColumn("u", uniform(seed, row, "b")).withColumn("w", poisson_weight("u")).withColumn("s", F.when(uniform(seed + 1, row, "b") < 0.5, -1.0).otherwise(1.0))
    r = b.groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"), F.avg(F.col("s") * F.col(value)).alias("flip"))
    mean = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    j = r.join(mean, keys)
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    g = j.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), q.alias("q"), ((F.count_if(F.abs("flip") >= F.abs("mean")) + 1) / (F.count("*") + 1)).alias("p"))
    return g.select(*keys, "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p")


def autocovariances(df: DataFrame, keys: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """(keys, lag, rho) by lag products, for lags up to ``most``."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count(value).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.join(stats, keys).withColumn("_x", F.col(value) - F.col("_m"))
    d = d.withColumn("_l", F.array(*[F.lag("_x", k).over(w) for k in range(1, most + 1)]))
    g = d.select(*keys, "_x", "_v", "_n", F.posexplode("_l").alias("pos", "y")).groupBy(*keys, (F.col("pos") + 1).alias("lag"))
    return g.agg((F.sum(F.col("_x") * F.col("y")) / F.first("_n") / F.nullif(F.first("_v"), F.lit(0.0))).alias("rho"))


def effective_size(rho: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """n / (1 + 2 sum of rho up to the first that is not positive)."""
    w = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    r = rho.withColumn("_ok", F.min((F.col("rho") > 0).cast("int")).over(w)).groupBy(*keys).agg((1 + 2 * F.sum(F.when(F.col("_ok") == 1, F.col("rho")).otherwise(0.0))).alias("tau"))
    return r.join(sizes, keys).withColumn("effective", F.col("n") / F.col("tau"))


def _inversions(rank: np.ndarray) -> int:
    """Pairs i < j with rank[i] > rank[j] of distinct ranks below their number.

    Ranks are split by their bits from the highest on, so those of a block are in its places, and a one before a zero is a
    pair; the last 32 ranks are compared one by one.
    """
    n = len(rank)
    low = 5
    r = np.append(rank, np.arange(n, -(-n >> low << low))).astype(np.int32 if n < 2**31 - 64 else np.int64)
    total, n = 0, len(r)
    for bit in range(max(1, int(n - 1).bit_length()) - 1, low - 1, -1):
        half = 1 << bit
        whole = n // (2 * half) * 2 * half
        one = (r >> bit) & 1 == 1
        zero = np.flatnonzero(~one)
        blocks, rest = whole // (2 * half), min(half, n - whole)
        # where the zeros are, less where they would be without a one before them
        total += int(zero.sum()) - blocks * half * (half - 1) // 2 - half * half * blocks * (blocks - 1) - rest * (rest - 1) // 2 - rest * whole
        zeros, ones = r[zero], r[one]
        at = blocks * half
        r = np.concatenate([np.stack([zeros[:at].reshape(-1, half), ones[:at].reshape(-1, half)], 1).ravel(), zeros[at:], ones[at:]])
    last = np.ascontiguousarray((r & ((1 << low) - 1)).astype(np.int8).reshape(-1, 1 << low).T)
    return total + sum(int(np.count_nonzero(last[:-k] > last[k:])) for k in range(1, 1 << low))


def median_pair_slope(x: np.ndarray, y: np.ndarray, direct: int = 512) -> float | None:
    """Median of the slopes of all pairs of points with different x; None if there is no such pair.

    Above ``direct`` points few pairs are made: pairs up to a slope are counted as inversions, and two slopes about the
    median, first from a sample of pairs, then in proportion to the counts, close in on it until about as many pairs as
    points lie between them.  Those are listed; where they are too far apart to be found, the slope is bisected.
    """
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n = len(x)
    lead = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if n else np.zeros(0, np.int64)
    if len(lead) < 2:
        return None
    if n <= direct:
        i, j = np.triu_indices(n, 1)
        i, j = i[x[i] != x[j]], j[x[i] != x[j]]
        return float(np.median((y[j] - y[i]) / (x[j] - x[i])))
    size = np.diff(np.append(lead, n))
    pairs = (n * n - int((size.astype(np.int64) ** 2).sum())) // 2
    same = x[1:] == x[:-1]

    def sorted_by(m: float) -> np.ndarray:
        # equal z count as a slope not above m
        return n - 1 - np.argsort((y - m * x)[::-1], kind="stable")

    def below(m: float) -> int:
        z = y - m * x
        rank = np.empty(n, np.int64)
        rank[sorted_by(m)] = np.arange(n)
        # not among points of one x, which are sorted by y
        run = np.diff(np.flatnonzero(np.append(np.append(True, ~same | (z[1:] != z[:-1])), True)))
        return _inversions(rank) - int((run * (run - 1) // 2).sum())

    def between(lo: float, hi: float, count: int, reach: int = 512) -> np.ndarray | None:
        """The slopes above ``lo`` and up to ``hi``, in order: pairs that change places from one to the other."""
        first, rank = sorted_by(lo), np.empty(n, np.int64)
        rank[sorted_by(hi)] = np.arange(n)
        rank, out, found = rank[first], [], 0
        for d in range(1, min(reach, n)):
            at = np.flatnonzero(rank[:-d] > rank[d:])
            i, j = first[at], first[at + d]
            k = x[i] != x[j]
            i, j = i[k], j[k]
            out.append((y[j] - y[i]) / (x[j] - x[i]))
            found += len(i)
            if found >= count:
                break
        return np.sort(np.concatenate(out)) if found == count else None

    # no slope is outside those between neighbouring x
    gap = np.diff(x[lead])
    least, most = y[lead], y[np.append(lead[1:], n) - 1]
    lo, hi = ((least[1:] - most[:-1]) / gap).min(), ((most[1:] - least[:-1]) / gap).max()
    lo, hi = lo - 1e-9 * (1 + abs(lo)), hi + 1e-9 * (1 + abs(hi))
    ranks = (pairs + 1) // 2, pairs // 2 + 1
    counts = [0, pairs]

    def apart(lo: float, hi: float) -> bool:
        return hi - lo > 1e-13 * max(1.0, abs(lo), abs(hi))

    rng = np.random.default_rng(0)
    i, j = rng.integers(0, n, 20_000), rng.integers(0, n, 20_000)
    i, j = i[x[i] != x[j]], j[x[i] != x[j]]
    probes = list(np.quantile((y[j] - y[i]) / (x[j] - x[i]), [0.49, 0.51])) if len(i) else []
    wide, parted = 0.05, False
    while counts[1] - counts[0] > 2 * n and apart(lo, hi) and not parted:
        before = counts[1] - counts[0]
        for m in probes or [(lo + hi) / 2]:
            if not lo < m < hi:
                continue
            c = below(m)
            if c >= ranks[1]:
                hi, counts[1] = m, c
            elif c < ranks[0]:
                lo, counts[0] = m, c
            else:  # the two middle slopes lie on both sides
                parted = True
        share = (counts[1] - counts[0]) / before
        if share > 0.5:  # far from a straight line: halve the slopes
            probes = [] if probes else [lo + (hi - lo) * f for f in (0.25, 0.75)]
            continue
        wide = wide / 4 if share < 4 * wide else wide
        wide = max(wide, n / (counts[1] - counts[0]))
        f = (ranks[0] - counts[0]) / (counts[1] - counts[0])
        probes = [lo + (hi - lo) * min(1.0, max(0.0, f + s)) for s in (-wide, wide)]
    found = between(lo, hi, counts[1] - counts[0]) if counts[1] - counts[0] <= 2 * n else None
    if found is not None:
        return float((found[ranks[0] - counts[0] - 1] + found[ranks[1] - counts[0] - 1]) / 2)

    def nth(k: int, lo: float, hi: float) -> float:
        while apart(lo, hi):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if below(mid) >= k else (mid, hi)
        return (lo + hi) / 2

    middle = nth(ranks[0], lo, hi)
    return float(middle if pairs % 2 else (middle + nth(ranks[1], lo, hi)) / 2)


def theil_sen(df: DataFrame, keys: list[str], row: str, x: str, y: str) -> DataFrame:
    """Median of the slopes of all pairs of ln y on ln x, with r2 and a verdict over all ``used`` rows."""
    d = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*keys, row, F.ln(x).alias("lx"), F.ln(y).alias("ly"))
    kind = StructType([*(f for f in d.select(*keys).schema), StructField("slope", DoubleType())])
    names = kind.names

    def slope(t: pa.Table) -> pa.Table:
        m = median_pair_slope(t.column("lx").to_numpy(), t.column("ly").to_numpy())
        return pa.table([*(t.column(k).slice(0, 1) for k in keys), pa.array([m], pa.float64())], names)

    s = d.select(*keys, "lx", "ly").groupBy(*keys).applyInArrow(slope, kind)
    at = lambda name, *x: getattr(F, name)(*x).alias(f"_{name}{x[-1]}")
    base = d.groupBy(*keys).agg(F.count("*").alias("used"), (F.max("lx") - F.min("lx")).alias("span"), *[at(f, c) for f in ("avg", "median", "var_pop") for c in ("lx", "ly")], F.covar_pop("lx", "ly").alias("_cov"))
    m, c = F.col("slope"), F.col("_medianly") - F.col("slope") * F.col("_medianlx")
    # mean square of the residuals of the median line, from moments
    rest = F.col("_var_poply") - 2 * m * F.col("_cov") + m * m * F.col("_var_poplx") + F.pow(F.col("_avgly") - m * F.col("_avglx") - c, 2)
    enough = (F.col("used") >= 5) & (F.col("span") >= 0.5)
    r2 = F.when(F.col("_var_poply") * F.col("used") > 1e-10, 1 - rest / F.col("_var_poply")).otherwise(0.0)
    out = base.join(s, keys, "left").withColumn("gamma", F.when(enough, -F.col("slope"))).withColumn("r2", F.when(enough, r2))
    off = F.abs(F.col("gamma") - 1)
    # fixed values: the gates and the names of the verdicts
    verdict = F.when(F.col("used") < 5, "INSUFFICIENT_DATA").when(F.col("span") < 0.5, "INSUFFICIENT_RANGE").when(F.col("r2") < 0.3, "LOW_R2").when(off < 0.15, "METASTABLE").when(off < 0.30, "WARNING").when(off < 0.50, "CRITICAL").otherwise("COLLAPSE")
    return out.select(*keys, "used", "gamma", "r2", verdict.alias("verdict"))


def convergence(df: DataFrame, keys: list[str], order: list[str], value: str, target: float) -> DataFrame:
    """Whether the distance to a target falls along a series: its median slope, first and last distance.

    A series of fewer than three points is insufficient. All points of a key are in one task, as 16 bytes each.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, *order, F.abs(F.col(value) - target).alias("_d"))
    d = d.withColumn("_i", (F.row_number().over(w) - 1).cast("double")).select(*keys, "_i", "_d")
    kind = StructType([*(f for f in d.select(*keys).schema), StructField("slope", DoubleType())])
    names = kind.names

    def slope(t: pa.Table) -> pa.Table:
        m = median_pair_slope(t.column("_i").to_numpy(), t.column("_d").to_numpy())
        return pa.table([*(t.column(k).slice(0, 1) for k in keys), pa.array([m], pa.float64())], names)

    s = d.groupBy(*keys).applyInArrow(slope, kind)
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("_d", "_i").alias("first_distance"), F.max_by("_d", "_i").alias("last_distance")).join(s, keys)
    status = F.when(F.col("n") < 3, "INSUFFICIENT").when(F.col("slope") < 0, "CONVERGING").otherwise("NOT_CONVERGING")
    return g.select(*keys, "n", F.when(F.col("n") >= 3, F.col("slope")).alias("slope"), status.alias("status"), "first_distance", "last_distance")


def effect_sizes(df: DataFrame, keys: list[str], group: Column, value: str, z: float = 1.959963984540054) -> DataFrame:
    """Cohen d and Hedges g with the analytic interval of Hedges and Olkin, and Cliff's delta."""
    t = two_samples(df, keys, group, value)
    na, nb = F.col("na"), F.col("nb")
    half = lambda c: z * F.sqrt((na + nb) / (na * nb) + F.col(c) * F.col(c) / (2 * (na + nb)))
    d, g = F.col("cohen_d"), F.col("hedges_g")
    return t.select(*keys, d, (d - half("cohen_d")).alias("d_low"), (d + half("cohen_d")).alias("d_high"), g, (g - half("hedges_g")).alias("g_low"), (g + half("hedges_g")).alias("g_high"), "cliff")


def fluctuation(df: DataFrame, keys: list[str], order: list[str], value: str, scales: list[int]) -> DataFrame:
    """Detrended fluctuation exponent: slope of ln of the mean segment residual on ln of the scale."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.join(stats, keys).withColumn("_i", F.row_number().over(w) - 1).withColumn("_y", F.sum(F.col(value) - F.col("_m")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    d = d.select(*keys, "_i", "_y", "_n", F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale")).withColumn("seg", F.floor(F.col("_i") / F.col("scale")))
    d = d.where(((F.col("seg") + 1) * F.col("scale") <= F.col("_n")) & (F.col("_n") >= 2 * F.col("scale"))).withColumn("x", F.col("_i") - F.col("seg") * F.col("scale"))
    r = d.groupBy(*keys, "scale", "seg").agg(F.sqrt(F.greatest(F.lit(0.0), F.var_pop("_y") * (1 - F.coalesce(F.pow(F.corr("x", "_y"), 2), F.lit(0.0))))).alias("rms"))
    f = r.groupBy(*keys, "scale").agg(F.avg("rms").alias("f")).where("f > 0")
    return f.groupBy(*keys).agg(F.regr_slope(F.ln("f"), F.ln("scale")).alias("alpha"), F.count("*").alias("scales"))


def multifractal(df: DataFrame, keys: list[str], order: list[str], value: str, scales: list[int], qs: list[float]) -> DataFrame:
    """Generalised exponents h(q): (keys, q, h); q = 0 takes the mean of logarithms."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.join(stats, keys).withColumn("_i", F.row_number().over(w) - 1).withColumn("_y", F.sum(F.col(value) - F.col("_m")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    d = d.select(*keys, "_i", "_y", "_n", F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale"))
    full = F.floor(F.col("_n") / F.col("scale")) * F.col("scale")
    d = d.select(*keys, "_y", "_n", "scale", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_i").alias("p")), F.struct(F.lit(1).alias("side"), (F.col("_n") - 1 - F.col("_i")).alias("p")))).alias("s"), full.alias("_full")).where("s.p < _full AND _n >= 4 * scale")
    d = d.withColumn("seg", F.floor(F.col("s.p") / F.col("scale"))).withColumn("x", F.col("s.p") - F.col("seg") * F.col("scale"))
    r = d.groupBy(*keys, "scale", "s.side", "seg").agg((F.var_pop("_y") * (1 - F.coalesce(F.pow(F.corr("x", "_y"), 2), F.lit(0.0)))).alias("f2")).where("f2 > 1e-20")
    r = r.select(*keys, "scale", "f2", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    f = r.groupBy(*keys, "scale", "q").agg(F.when(F.first("q") == 0, 0.5 * F.avg(F.ln("f2"))).otherwise(F.ln(F.avg(F.pow("f2", F.col("q") / 2))) / F.first("q")).alias("lf"))
    return f.groupBy(*keys, "q").agg(F.regr_slope("lf", F.ln("scale")).alias("h"))


def rescaled_range(df: DataFrame, keys: list[str], order: list[str], value: str, widths: list[int]) -> DataFrame:
    """Hurst exponent from block ranges of mean-removed running sums over block sd, kept within 0 and 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    d = d.select(*keys, value, "_i", "_n", F.explode(F.array(*[F.lit(x) for x in widths])).alias("width")).withColumn("blk", F.floor(F.col("_i") / F.col("width"))).where((F.col("blk") + 1) * F.col("width") <= F.col("_n"))
    b = Window.partitionBy(*keys, "width", "blk")
    d = d.withColumn("_c", F.sum(F.col(value)).over(b.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_m", F.avg(value).over(b)).withColumn("_k", F.row_number().over(b.orderBy("_i")))
    d = d.withColumn("_z", F.col("_c") - F.col("_k") * F.col("_m"))
    r = d.groupBy(*keys, "width", "blk").agg(((F.max("_z") - F.min("_z")) / F.nullif(F.stddev_pop(value), F.lit(0.0))).alias("rs"))
    g = r.groupBy(*keys, "width").agg(F.avg("rs").alias("rs")).where("rs > 0").groupBy(*keys).agg(F.regr_slope(F.ln("rs"), F.ln("width")).alias("h"))
    return g.withColumn("hurst", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("h")))).drop("h")


def box_dimension(cells: DataFrame, keys: list[str], row: str, col: str, sizes: list[int]) -> DataFrame:
    """Box-counting dimension of occupied cells of a grid."""
    d = cells.select(*keys, row, col, F.explode(F.array(*[F.lit(s) for s in sizes])).alias("s"))
    n = d.groupBy(*keys, "s").agg(F.count_distinct(F.floor(F.col(row) / F.col("s")), F.floor(F.col(col) / F.col("s"))).alias("n"))
    return n.groupBy(*keys).agg((-F.regr_slope(F.ln("n"), F.ln("s"))).alias("dimension"))


def entropy(df: DataFrame, keys: list[str], cols: list[str], name: str) -> DataFrame:
    """Base-2 entropy of the joint values of ``cols``."""
    w = Window.partitionBy(*keys)
    g = df.groupBy(*keys, *cols).agg(F.count("*").alias("_c")).withColumn("_p", F.col("_c") / F.sum("_c").over(w))
    return g.groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias(name))


def transfer_entropy(df: DataFrame, keys: list[str], order: list[str], source: str, target: str, bins: int = 6) -> DataFrame:
    """H(y', y) + H(y, x) - H(y) - H(y', y, x) over equal-width bins; never below 0."""
    w = Window.partitionBy(*keys)

    def binned(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / (hi - lo) * bins))).otherwise(0)

    d = df.withColumn("_x", binned(source)).withColumn("_y", binned(target)).withColumn("_z", F.lead("_y").over(w.orderBy(*order))).where("_z IS NOT NULL")
    parts = [(["_z", "_y"], "a"), (["_y", "_x"], "b"), (["_y"], "c"), (["_z", "_y", "_x"], "e")]
    out = None
    for cols, n in parts:
        h = entropy(d, keys, cols, n)
        out = h if out is None else out.join(h, keys)
    return out.select(*keys, F.greatest(F.lit(0.0), F.col("a") + F.col("b") - F.col("c") - F.col("e")).alias("te"))


def null_verdict(observed: DataFrame, nulls: DataFrame, keys: list[str], stat: str) -> DataFrame:
    """Mean, sd, z and central 95 % of a null's statistics, and whether the observed one lies outside."""
    q = F.percentile(stat, F.array(F.lit(0.025), F.lit(0.975)))
    n = nulls.groupBy(*keys).agg(F.avg(stat).alias("mean"), F.stddev_samp(stat).alias("sd"), q.alias("q"))
    j = observed.join(n, keys)
    return j.select(*keys, stat, "mean", "sd", ((F.col(stat) - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("z"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.when((F.col(stat) < F.col("q")[0]) | (F.col(stat) > F.col("q")[1]), "separable").otherwise("not separable").alias("verdict"))


def shuffled(df: DataFrame, keys: list[str], order: list[str], row: str, value: str, rounds: int, seed: int = 9) -> DataFrame:
    """Surrogates (keys, round, i, value): values dealt anew to positions by a hashed order."""
    w = Window.partitionBy(*keys, "round")
    d = df.select(*keys, *order, row, value, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    return d.select(*keys, "round", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), row, "round"), row)).alias("i"), value)


def shuffled_autocovariances(df: DataFrame, keys: list[str], row: str, value: str, rounds: int, seed: int = 9, bits: int = 5) -> DataFrame:
    """(keys, round, rho): the lag-1 autocovariance of ``shuffled`` values over their variance.

    Mean and variance are the series' own.  The order of a round is cut by the first ``bits`` of the hash: each slice is a
    group, told by one number, and slices meet by their first and last value, so a round of a series is no task.
    """
    nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*keys)).cast("long")  # a row a series
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count(value).alias("_n")).withColumn("_k", nth)
    d = df.join(stats.select(*keys, "_m", "_k"), keys).select("_k", F.col(row).alias("_row"), (F.col(value) - F.col("_m")).alias("_x"))
    d = d.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_h", F.xxhash64(F.lit(seed), "_row", "round"))
    part = F.shiftright("_h", 64 - bits) + (1 << bits - 1)
    d = d.select(((F.col("_k") * (rounds + 1) + F.col("round")) * (1 << bits) + part).alias("_g"), "_h", "_row", "_x")

    def slice_sum(t: pa.Table) -> pa.Table:
        h = t.column("_h").to_numpy()
        o = np.argsort(h, kind="stable")
        if (h[o][1:] == h[o][:-1]).any():
            o = pc.sort_indices(t, [("_h", "ascending"), ("_row", "ascending")]).to_numpy()
        x, there = t.column("_x").to_numpy()[o], t.column("_x").is_valid().to_numpy()[o]
        both = there[1:] & there[:-1]
        end = lambda i: float(x[i]) if there[i] else None
        total = float((x[1:][both] * x[:-1][both]).sum()) if both.any() else None
        return pa.table([t.column("_g").slice(0, 1), *(pa.array([v], pa.float64()) for v in (total, end(0), end(-1)))], ["_g", "_s", "_first", "_last"])

    s = d.groupBy("_g").applyInArrow(slice_sum, "_g long, _s double, _first double, _last double")
    s = s.withColumn("_kr", F.shiftright("_g", bits)).withColumn("_before", F.lag("_last").over(Window.partitionBy("_kr").orderBy("_g")))  # a row a slice
    s = s.groupBy("_kr").agg(F.sum("_s").alias("_s"), F.sum(F.col("_first") * F.col("_before")).alias("_e"))
    s = s.select(F.floor(F.col("_kr") / (rounds + 1)).alias("_k"), (F.col("_kr") % (rounds + 1)).cast("int").alias("round"), "_s", "_e")
    total = F.when(F.col("_s").isNotNull() | F.col("_e").isNotNull(), F.coalesce("_s", F.lit(0.0)) + F.coalesce("_e", F.lit(0.0)))
    return s.join(stats, "_k").select(*keys, "round", (total / F.col("_n") / F.nullif("_v", F.lit(0.0))).alias("rho"))


def circular_shift(df: DataFrame, keys: list[str], order: list[str], value: str, rounds: int, seed: int = 9) -> DataFrame:
    w = Window.partitionBy(*keys)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    d = d.select(*keys, value, "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    by = F.pmod(F.xxhash64(F.lit(seed), *keys, "round"), F.col("_n"))
    return d.select(*keys, "round", (F.pmod(F.col("_i") + by, F.col("_n")) + 1).alias("i"), value)


def power_law(df: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    d = df.where(F.col(value) >= least)
    return d.groupBy(*keys).agg((1 + F.count("*") / F.nullif(F.sum(F.ln(F.col(value) / least)), F.lit(0.0))).alias("exponent"), F.count("*").alias("n"))


def branching_ratio(df: DataFrame, keys: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """Mean over lags of the k-th root of sum(x_t x_t+k) / sum(x_t^2), for positive slopes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = F.col(value)
    d = df.withColumn("_l", F.array(*[F.struct(F.lit(k).alias("k"), F.lead(value, k).over(w).alias("y")) for k in range(1, most + 1)]))
    g = d.select(*keys, x.alias("x"), F.explode("_l").alias("l")).where("l.y IS NOT NULL").groupBy(*keys, "l.k").agg((F.sum(F.col("x") * F.col("l.y")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("r")).where("r > 0")
    return g.groupBy(*keys).agg(F.avg(F.pow("r", 1 / F.col("k"))).alias("ratio"))


def half_overlapping(df: DataFrame, keys: list[str], order: list[str], windows: int) -> DataFrame:
    """(keys, win, ...): rows of each of ``windows`` windows that overlap by half."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    half = F.greatest(F.lit(1), F.floor(F.col("_n") / (windows + 1)))
    at = F.floor(F.col("_i") / half)
    d = d.withColumn("win", F.explode(F.array(at - 1, at)))
    return d.where((F.col("win") >= 0) & (F.col("win") < windows)).drop("_i", "_n")


def spectrum_slope(df: DataFrame, keys: list[str], order: list[str], value: str, segment: int = 64) -> DataFrame:
    """Slope of ln power on ln frequency of the averaged periodogram of half-overlapping, mean-removed, tapered segments.

    Segments are bounded; each goes through one FFT in an Arrow batch, and powers are averaged in Spark.
    """
    import numpy as np
    import pyarrow as pa

    w = Window.partitionBy(*keys).orderBy(*order)
    half = segment // 2
    d = df.withColumn("_i", F.row_number().over(w) - 1)
    d = d.select(*keys, "_i", F.col(value).cast("double").alias("_v"), F.explode(F.array(F.floor(F.col("_i") / half) - 1, F.floor(F.col("_i") / half))).alias("seg")).where("seg >= 0")
    s = d.groupBy(*keys, "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("x")).where(F.size("x") == segment)
    taper = np.hanning(segment)

    def power(batches):
        for b in batches:
            x = b.column(b.num_columns - 1)
            m = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, segment)
            p = np.abs(np.fft.rfft((m - m.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(p), pa.list_(pa.float64()))], [*b.schema.names[:-1], "p"])

    kind = ", ".join(f"{c} {t}" for c, t in s.drop("x").dtypes) + ", p array<double>"
    p = s.mapInArrow(power, kind).select(*keys, F.posexplode("p").alias("f", "p")).where("f > 0").groupBy(*keys, "f").agg(F.avg("p").alias("p")).where("p > 0")
    return p.groupBy(*keys).agg((-F.regr_slope(F.ln("p"), F.ln("f"))).alias("gamma"), F.count("*").alias("bins"))
