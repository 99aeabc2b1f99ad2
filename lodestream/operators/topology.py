"""Topology of weighted graphs: spanning forests, components by threshold, barcodes, transport curvature of edges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.sources.files import with_checkpoints

from .panels import components

#: Units of a block, whose correlations with another block have 32 MB, and values of a block that are dense, 64 MB.
BLOCK, DENSE = 2048, 8_000_000
#: Rows of a block that are correlated at a time, a megabyte an array.
STRIP = 64


def spanning_forest(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(a, b, weight) of the minimum spanning forest of undirected edges (a, b, weight), by rounds of Boruvka.

    In each round every component takes its lightest edge to another one (ties by the smaller, then the larger end, so
    all weights are distinct), and components that took edges become one.  Components halve at least, so there are
    log2 of the vertices rounds at most.  Loops, nulls and non-finite weights are left out; of parallel edges the lightest
    counts.  The weights of the forest are the lengths of the bars of the components' barcode.
    """
    spark = edges.sparkSession
    with_checkpoints(spark)
    e = edges.where("a <> b AND weight IS NOT NULL AND NOT isnan(weight) AND abs(weight) < double('inf')")
    e = e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("weight").alias("weight"))
    # ca, cb: the components of the ends
    live = e.select("a", "b", "weight", F.col("a").alias("ca"), F.col("b").alias("cb")).checkpoint()
    taken = None
    for _ in range(most_rounds):
        if not live.limit(1).count():
            break
        offer = F.struct("weight", "a", "b", "ca", "cb")
        both = live.select(F.col("ca").alias("c"), offer.alias("o")).union(live.select(F.col("cb").alias("c"), offer.alias("o")))
        best = both.groupBy("c").agg(F.min("o").alias("o")).select("o.*").distinct().checkpoint()
        picked = best.select("a", "b", "weight")
        taken = picked if taken is None else taken.union(picked)
        joined = components(best.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        at = lambda side: joined.select(F.col("v").alias(f"c{side}"), F.col("component").alias(f"n{side}"))  # noqa: E731, B023
        live = live.join(at("a"), "ca", "left").join(at("b"), "cb", "left")
        live = live.select("a", "b", "weight", F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb")).where("ca <> cb").checkpoint()
    else:
        raise RuntimeError(f"the forest has not settled after {most_rounds} rounds")
    return spark.createDataFrame([], e.schema) if taken is None else taken


def threshold_curve(edges: DataFrame, nodes: int, thresholds: list[float]) -> DataFrame:
    """(threshold, edges, components, euler, bar) of a weighted graph of ``nodes`` vertices, for each threshold.

    Edges up to the threshold count; ``components`` is the number of vertices less the forest's edges among them, so one
    forest answers all thresholds; ``euler`` is vertices - edges + components; ``bar`` is the threshold less the mean
    weight of the edges, 0 at least, and 0 without edges.
    """
    up_to = lambda df: reached(df, thresholds)
    own = up_to(edges.where("a <> b")).groupBy("threshold").agg(F.count("*").alias("edges"), F.avg("weight").alias("mean"))
    return curve_of(own, spanning_forest(edges), nodes, thresholds)


def reached(df: DataFrame, thresholds: list[float]) -> DataFrame:
    t = F.array(*[F.lit(float(x)) for x in thresholds])
    return df.withColumn("threshold", F.explode(F.filter(t, lambda x: F.col("weight") <= x)))


def curve_of(own: DataFrame, forest: DataFrame, nodes: int, thresholds: list[float]) -> DataFrame:
    """A threshold curve from (threshold, edges, mean) of the edges and the forest."""
    trees = reached(forest, thresholds).groupBy("threshold").agg(F.count("*").alias("trees"))
    every = forest.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    out = every.join(own, "threshold", "left").join(trees, "threshold", "left").fillna(0, ["edges", "trees"])
    out = out.withColumn("components", F.lit(nodes) - F.col("trees")).withColumn("euler", F.lit(nodes) - F.col("edges") + F.col("components"))
    return out.select("threshold", "edges", "components", "euler", F.coalesce(F.greatest(F.lit(0.0), F.col("threshold") - F.col("mean")), F.lit(0.0)).alias("bar"))


def two_sided_forest(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of a lightest forest of edges between rows and columns, by Prim; infinity is no edge."""
    rows, cols = w.shape
    across, key = np.ascontiguousarray(w.T), np.full(rows + cols, np.inf)
    frm, free = np.zeros(rows + cols, np.int64), np.ones(rows + cols, bool)
    ends, start = [], 0
    for _ in range(rows + cols):
        v = int(key.argmin())
        if key[v] == np.inf:
            start += int(free[start:].argmax())
            v = start
        else:
            ends.append((int(frm[v]), v) if v >= rows else (v, int(frm[v])))
        key[v], free[v] = np.inf, False
        side, line = (slice(rows, None), w[v]) if v < rows else (slice(0, rows), across[v - rows])
        better = np.flatnonzero((line < key[side]) & free[side])
        key[side][better] = line[better]
        frm[side][better] = v
    a, b = (np.array(ends, np.int64).reshape(-1, 2) - [0, rows]).T
    return a, b, w[a, b]


def correlation_weights(x: np.ndarray, y: np.ndarray, seen_x: np.ndarray, seen_y: np.ndarray, least: int) -> np.ndarray:
    """Correlation distances, to nine digits, of the rows of x and y over the columns both have, NaN being a null among
    what is seen; infinity for fewer than ``least`` columns or no variance."""
    ox, oy = seen_x & ~np.isnan(x), seen_y & ~np.isnan(y)
    px, py = ox.astype(float), oy.astype(float)
    wild_x, wild_y = np.isinf(x), np.isinf(y)  # not a number, or infinite
    x, y = np.where(ox & ~wild_x, x, 0.0), np.where(oy & ~wild_y, y, 0.0)
    n, sx, sy = px @ py.T, x @ py.T, px @ y.T
    less = lambda q, s, t: np.subtract(q, np.divide(np.multiply(s, t, out=t), n, out=t), out=t)
    qx, qy = (x * x) @ py.T, px @ (y * y).T
    vx, vy = less(qx, sx, sx.copy()), less(qy, sy, sy.copy())
    c = less(x @ y.T, sx, sy)
    # what little is left of a difference is taken anew, about the pair's own means
    qx *= 1e-7
    qy *= 1e-7
    i, j = np.nonzero(((vx <= qx) | (vy <= qy)) & (n > 0))
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        both = ox[a] & oy[b]

        def about(z):
            first = np.take_along_axis(z, both.argmax(axis=1)[:, None], 1)
            z = np.where(both, z - first, 0.0)  # equal values are zeros
            return np.where(both, z - (z.sum(axis=1) / both.sum(axis=1))[:, None], 0.0)

        u, v = about(x[a]), about(y[b])
        vx[a, b], vy[a, b], c[a, b] = (u * u).sum(axis=1), (v * v).sum(axis=1), (u * v).sum(axis=1)
    good = (vx > 0) & (vy > 0)
    good &= (n if np.array_equal(seen_x, ox) and np.array_equal(seen_y, oy) else seen_x.astype(float) @ seen_y.T.astype(float)) >= least
    w = np.divide(c, np.sqrt(np.multiply(vx, vy, out=vx), out=vx), out=c)
    np.clip(w, -1, 1, out=w)
    np.sqrt(np.multiply(np.subtract(1, w, out=w), 0.5, out=w), out=w)
    np.round(w, 9, out=w)
    good &= ~np.isnan(w)
    if wild_x.any() or wild_y.any():
        good &= (wild_x.astype(float) @ py.T + px @ wild_y.T.astype(float)) == 0
    w[~good] = np.inf
    return w


def correlation_curve(panel: DataFrame, unit: str, ts: str, value: str, thresholds: list[float], least: int = 3, block: int = BLOCK) -> DataFrame:
    """``threshold_curve`` of the units as vertices, edges being the correlation distances, to nine digits, of each two over
    the times both have; pairs with fewer than ``least`` times or without variance have none.

    Units are dealt to blocks by a hash, fewer to one where times are many, and each pair of blocks is a group, so a unit
    Units are dealt to blocks by a hash, fewer to one where times are many, and each pair of blocks is a group, so a unit
    moves once a block and no pair is a row.  A group gives the numbers and sums of its edges up to each threshold and its
    own lightest forest: the forest of all these has the components of all edges at each threshold.

    Block 0 is met first.  At a threshold at which both ends of an edge reach one unit of it anyway, the edge joins nothing,
    so groups of other blocks give only the forest of the edges below that.
    """
    spark = panel.sparkSession
    with_checkpoints(spark)
    p = panel.where(F.col(unit).isNotNull()).select(F.col(unit).alias("u"), F.col(ts).cast("timestamp").cast("long").alias("t") if dict(panel.dtypes)[ts] in ("timestamp", "date") else F.col(ts).alias("t"), F.col(value).cast("double").alias("v"))
    size = p.agg(F.count_distinct("u").alias("units"), F.count_distinct("t").alias("times")).first()
    size_of = max(1, min(block, DENSE // max(1, size["times"])))
    blocks = max(1, -(-size["units"] // size_of))
    one = p.where("t IS NOT NULL").groupBy("u").agg(F.collect_list("t").alias("t"), F.collect_list(F.coalesce(F.when(F.isnan("v"), float("inf")).otherwise(F.col("v")), F.lit(float("nan")))).alias("v"))
    one = one.withColumn("_own", F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int"))
    one = one.checkpoint() if blocks > 1 else one
    steps = sorted(float(x) for x in thresholds)
    columns = {"threshold": "double", "edges": "long", "total": "double", "a": dict(panel.dtypes)[unit], "b": dict(panel.dtypes)[unit], "weight": "double", "below": "double"}

    def pairs(g: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """The units of both blocks, the weights of their edges up to the last threshold, and numbers and sums of edges."""
        times = np.unique(np.concatenate(g["t"].to_list()))

        def side(own):
            q = g[g["_own"] == own].reset_index(drop=True)
            x, seen = np.full((len(q), len(times)), np.nan), np.zeros((len(q), len(times)), bool)
            for r, (t, v) in enumerate(zip(q["t"], q["v"], strict=True)):
                at = np.searchsorted(times, t)
                x[r, at], seen[r, at] = v, True
            known = np.isfinite(x)
            mean = np.where(known, x, 0.0).sum(axis=1) / np.maximum(1, known.sum(axis=1))
            return q, x - mean[:, None], seen

        i, j = int(g["_i"].iloc[0]), int(g["_j"].iloc[0])
        qa, x, seen_x = side(i)
        qb, y, seen_y = side(j)
        w = np.full((len(qa), len(qb)), np.inf)
        found, total = np.zeros(len(steps), np.int64), np.zeros(len(steps))
        with np.errstate(all="ignore"):
            for at in range(0, len(qa), STRIP):
                part = correlation_weights(x[at : at + STRIP], y, seen_x[at : at + STRIP], seen_y, least)
                if i == j:
                    part[np.arange(at, at + len(part))[:, None] >= np.arange(len(qb))] = np.inf  # each pair once
                place = np.zeros(part.shape, np.int8)
                for step in steps:
                    place += part > step
                part[place == len(steps)] = np.inf
                place, flat = place.ravel(), np.where(np.isinf(part), 0.0, part).ravel()
                found += np.bincount(place, minlength=len(steps))[: len(steps)].cumsum()
                total += np.bincount(place, flat, len(steps))[: len(steps)].cumsum()
                w[at : at + STRIP] = part
        # of a block with itself the rows and columns are the same units, each pair being an edge from row to column
        return qa, qb, np.minimum(w, w.T) if i == j else w, found, total

    def rows(found, total, ua, ub, w) -> pd.DataFrame:
        a, b, weight = two_sided_forest(w)
        edges = pd.DataFrame({"a": ua[a], "b": ub[b], "weight": weight}).drop_duplicates()
        sums = pd.DataFrame({"threshold": steps, "edges": found, "total": total})
        return pd.concat([sums, edges], ignore_index=True).reindex(columns=list(columns)).astype({"edges": "Int64"})

    def met_first(hub: dict) -> Callable[[pd.DataFrame], pd.DataFrame]:
        """``hub`` has the weight from which on a unit of block 0 reaches the chosen one."""

        def meet(g: pd.DataFrame) -> pd.DataFrame:
            qa, qb, w, found, total = pairs(g)
            out = rows(found, total, qa["u"].to_numpy(), qb["u"].to_numpy(), w)
            if not g["_j"].iloc[0]:
                return out
            via = np.array([hub[u] for u in qa["u"]]).reshape(-1, 1)
            reached = np.searchsorted(steps, np.maximum(w, via).min(axis=0, initial=np.inf))
            below = pd.DataFrame({"a": qb["u"], "below": np.array([-np.inf, *steps])[reached]})
            return pd.concat([out, below], ignore_index=True).reindex(columns=list(columns)).astype({"edges": "Int64"})

        return meet

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        qa, qb, w, found, total = pairs(g)
        w[w > np.maximum(qa["below"].to_numpy()[:, None], qb["below"].to_numpy()[None, :])] = np.inf
        some = np.isfinite(w)
        r, c = (np.flatnonzero(some.any(axis=k)) for k in (1, 0))
        return rows(found, total, qa["u"].to_numpy()[r], qb["u"].to_numpy()[c], w[np.ix_(r, c)])

    def groups(of, f, n):
        met = of.repartition(min(n, 512), "_i", "_j").groupBy("_i", "_j")
        return met.applyInPandas(f, ", ".join(f"{c} {kind}" for c, kind in columns.items())).checkpoint()

    others = F.explode(F.sequence(F.lit(1), F.lit(blocks - 1)))
    at_home = one.select("*", F.lit(0).alias("_i"), F.col("_own").alias("_j"))
    if blocks == 1:
        met = groups(at_home, met_first({}), 1)
    else:
        block = one.where("_own = 0").toPandas()  # a block of units, bounded as any group
        ends, hub = hub_of(*pairs(block.assign(_i=0, _j=0))[1:3], steps[0]) if len(block) else ([], {})
        to_all = one.where("_own = 0").withColumn("_other", others).select("u", "t", "v", "_own", F.lit(0).alias("_i"), F.col("_other").alias("_j"))
        met = groups(at_home.unionByName(to_all), met_first(hub), blocks)
        below = met.where("below IS NOT NULL").select(F.col("a").alias("u"), "below")
        rest = one.where("_own > 0").join(below, "u", "left").withColumn("below", F.coalesce("below", F.lit(steps[-1]))).withColumn("_other", others)
        rest = rest.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other")
        met = met.unionByName(groups(rest, meet, blocks * (blocks - 1) // 2))
    own = met.where("threshold IS NOT NULL").groupBy("threshold").agg(F.sum("edges").alias("edges"), F.try_divide(F.sum("total"), F.sum("edges")).alias("mean"))
    edges = met.where("weight IS NOT NULL").select("a", "b", "weight")
    if blocks > 1 and ends:
        edges = edges.union(spark.createDataFrame(ends, edges.schema))
    return curve_of(own, spanning_forest(edges), size["units"], thresholds)


def hub_of(units: pd.DataFrame, w: np.ndarray, near: float) -> tuple[list[tuple], dict]:
    """Edges of a lightest forest of a block of units with weights ``w``, and the weight from which on each unit reaches the
    one that has most edges up to ``near``."""
    u = units["u"].tolist()
    ends = sorted({(float(x), *sorted((int(i), int(j)))) for i, j, x in zip(*two_sided_forest(w), strict=True)})
    top = int((w <= near).sum(axis=0).argmax())
    home, members, via = list(range(len(u))), [[i] for i in range(len(u))], np.full(len(u), np.inf)
    via[top] = -np.inf
    for x, i, j in ends:
        i, j = home[i], home[j]
        if i == j:
            continue
        if home[top] == j:
            i, j = j, i
        if home[top] == i:
            via[members[j]] = x
        for k in members[j]:
            home[k] = i
        members[i] += members[j]
    return [(u[i], u[j], x) for x, i, j in ends], dict(zip(u, via.tolist(), strict=True))


def topology_score(curve: DataFrame) -> DataFrame:
    """(long_bars, entropy, area, score) of a threshold curve: bars over their median, entropy of their shares, area under
    the Euler curve by trapezoids; the score adds the share of long bars, entropy and area."""
    w = Window.partitionBy(F.lit(1)).orderBy("threshold")  # a row a threshold
    c = curve.withColumn("strip", (F.col("euler") + F.lag("euler").over(w)) / 2 * (F.col("threshold") - F.lag("threshold").over(w)))
    g = c.agg(F.count("*").alias("n"), F.coalesce(F.sum("strip"), F.lit(0.0)).alias("area"), F.median("bar").alias("m"), F.sum("bar").alias("total"), F.collect_list("bar").alias("bars"))
    entropy = -F.aggregate(F.filter("bars", lambda x: x > 0), F.lit(0.0), lambda a, x: a + x / F.col("total") * F.ln(x / F.col("total")))
    long = F.size(F.filter("bars", lambda x: x > F.col("m")))
    g = g.select(long.alias("long_bars"), entropy.alias("entropy"), "area", "n")
    return g.select("long_bars", "entropy", "area", (F.col("long_bars") / F.greatest("n", F.lit(1)) + F.col("entropy") + F.col("area")).alias("score"))


def correlation_distance(corr: Column) -> Column:
    return F.sqrt(0.5 * (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))))


def edge_curvature(edges: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(a, b, curvature) of each undirected edge: 1 - the mean hop distance between the walks that start at its ends.

    A walk stays with probability ``alpha`` and else goes to a neighbour.  The ends being neighbours, their neighbourhoods
    are at most three hops apart, so no longer path is looked for.  Of the pairs of a neighbour of a and one of b, the equal ones, the adjacent ones
    and those with a common neighbour are found by joins on edges, the rest is 3 hops apart.  There are as many pairs as the
    product of the degrees, and a vertex joins all pairs of its neighbours: it is meant for graphs of bounded degrees.

    Where no vertex is in both columns the graph is bipartite, and a neighbour of a and one of b are 1 or 3 hops apart.
    The adjacent ones are then counted along two edges, as y of N(b) adjoins as many of N(a) as y and a have neighbours in
    common, and the pairs are not listed.

    With n(a) neighbours the pairs weigh alpha or (1 - alpha) / n(a) a side.  Loops and parallel edges count once.
    """
    with_checkpoints(edges.sparkSession)
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct().toDF("u", "v").checkpoint()
    degree = both.groupBy("u").agg(F.count("*").alias("k"))
    degrees = lambda df: df.join(degree.select(F.col("u").alias("a"), F.col("k").alias("ka")), "a").join(degree.select(F.col("u").alias("b"), F.col("k").alias("kb")), "b")
    plain = edges.where("a <> b").select("a", "b")
    if not plain.select(F.col("a").alias("v")).intersect(plain.select(F.col("b").alias("v"))).limit(1).count():
        e = both.join(plain.select(F.col("a").alias("u")).distinct(), "u", "left_semi").toDF("a", "b")
        steps = e.join(e.select(F.col("a").alias("y"), "b"), "b").repartition("a")  # by the start alone: what follows needs no other shuffle
        steps = steps.withColumn("met", F.count("*").over(Window.partitionBy("a", "y")))
        out = degrees(steps.groupBy("a", "b").agg(F.sum("met").alias("adjacent")))
        hops = 3 - 2 * F.col("adjacent") / (F.col("ka") * F.col("kb"))
        side = lambda k: 2 * (F.col(k) - 1) / F.col(k)
        work = alpha * (1 - alpha) * (side("ka") + side("kb")) + (1 - alpha) * (1 - alpha) * hops
        # a stays and b stays: one hop
        return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (1 - alpha * alpha - work).alias("curvature"))
    e = both.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))
    near = lambda end, name: both.select(F.col("u").alias(end), F.col("v").alias(name))
    # pairs (x, y), x a neighbour of a and y one of b; a itself is among b's neighbours and b among a's
    pairs = e.join(near("a", "x"), "a").join(near("b", "y"), "b")
    one = both.select(F.col("u").alias("x"), F.col("v").alias("y"), F.lit(1).alias("hop1"))
    two = both.select(F.col("u").alias("m"), F.col("v").alias("x")).join(both.select(F.col("u").alias("m"), F.col("v").alias("y")), "m").where("x <> y").select("x", "y").distinct().withColumn("hop2", F.lit(2))
    d = F.when(F.col("x") == F.col("y"), 0).otherwise(F.coalesce("hop1", "hop2", F.lit(3)))
    far = pairs.join(one, ["x", "y"], "left").join(two, ["x", "y"], "left").groupBy("a", "b").agg(F.sum(d).alias("pairs_hops"))
    # from a end itself to a neighbour of the other end: 0 for the end, 1 for a common neighbour, else 2
    common = e.join(near("a", "x"), "a").join(both.select(F.col("u").alias("b"), F.col("v").alias("x")), ["b", "x"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    out = e.join(far, ["a", "b"]).join(common, ["a", "b"], "left").fillna(0, ["common"])
    out = degrees(out)
    side = lambda k: (F.col("common") + 2 * (F.col(k) - 1 - F.col("common"))) / F.col(k)
    work = alpha * alpha + alpha * (1 - alpha) * (side("ka") + side("kb")) + (1 - alpha) * (1 - alpha) * F.col("pairs_hops") / (F.col("ka") * F.col("kb"))
    return out.select("a", "b", (1 - work).alias("curvature"))
