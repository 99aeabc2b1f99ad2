"""Graphs and matrices over panels: curvature, components, motifs, transitions, grids, balances."""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.sources.files import with_checkpoints


def correlation_graph(corr: DataFrame, threshold: float) -> DataFrame:
    return corr.where(F.abs("corr") >= threshold).select("a", "b", F.abs("corr").alias("weight"))


def forman_curvature(edges: DataFrame) -> DataFrame:
    """4 - deg(a) - deg(b) for each undirected edge (a, b)."""
    deg = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("k"))
    e = edges.join(deg.select(F.col("v").alias("a"), F.col("k").alias("ka")), "a").join(deg.select(F.col("v").alias("b"), F.col("k").alias("kb")), "b")
    return e.select("a", "b", (4 - F.col("ka") - F.col("kb")).alias("curvature"))


def simplex_projection(df: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Euclidean projection of each key's values on weights that are not negative and sum to one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), item)
    d = df.withColumn("_k", F.row_number().over(w)).withColumn("_c", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_t", (F.col("_c") - 1) / F.col("_k"))
    theta = F.max_by(F.when(F.col(value) > F.col("_t"), F.col("_t")), F.when(F.col(value) > F.col("_t"), F.col("_k"))).over(Window.partitionBy(*keys))
    return d.select(*keys, item, F.greatest(F.lit(0.0), F.col(value) - theta).alias("weight"))


def topology_proxy(corr: DataFrame, n: Column) -> DataFrame:
    """Participation ratio n^2 / sum(corr^2) / n times 1 + sd of |corr| over pairs; the full matrix has both triangles and ones."""
    g = corr.agg(F.sum(F.col("corr") * F.col("corr")).alias("s"), F.stddev_pop(F.abs("corr")).alias("sd"), n.alias("n"))
    return g.select(((F.col("n") * F.col("n")) / (F.col("n") + 2 * F.col("s")) / F.col("n") * (1 + F.col("sd"))).alias("score"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(v, component) of undirected edges (a, b): the smallest vertex that can be reached.

    Large-star and small-star steps alternate until nothing changes, some multiple of log2 of the vertices also on long
    paths; should ``most_rounds`` not be enough, an error says so and no labels are given.
    """
    with_checkpoints(edges.sparkSession)
    cut = lambda df: df.checkpoint()
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b")))
        e = cut(step.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.union(e.select("b", "b")).distinct().toDF("v", "component")
        mark = now
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


def triangle_tables() -> tuple[np.ndarray, np.ndarray]:
    """How many feed-forward loops and 3-cycles a triangle (u, v, w) has, by the arcs of uv, uw and vw: 1 goes on, 2 goes back."""
    loops, cycles = np.zeros((4, 4, 4), np.int64), np.zeros((4, 4, 4), np.int64)
    for kinds in product(range(4), repeat=3):
        arc = lambda x, y: bool(kinds[x + y - 1] & (1 if x < y else 2))  # noqa: E731, B023
        loops[kinds] = sum(arc(a, b) and arc(b, c) and arc(a, c) for a, b, c in permutations(range(3)))
        cycles[kinds] = (arc(0, 1) and arc(1, 2) and arc(2, 0)) + (arc(0, 2) and arc(2, 1) and arc(1, 0))
    return loops, cycles


def motifs(edges: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Feed-forward loops, directed 3-cycles and mutual pairs of distinct edges (src, dst).

    Each pair of neighbours is kept once, at its vertex of fewer neighbours (ties by number), so a vertex keeps the root of
    twice the pairs at most.  A vertex sends each of those the ones that come after it, as one list, and the triangles are
    what both lists have, found ``most`` entries at a time; no path of two edges is a row.
    """
    with_checkpoints(edges.sparkSession)
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("m"))
    pairs = e.groupBy("a", "b").agg(F.bit_or("m").alias("m")).checkpoint()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("k"))
    at = lambda c: degree.select(F.col("v").alias(c), F.col("k").alias(f"k{c}"))
    p = pairs.join(at("a"), "a").join(at("b"), "b")
    turn = (F.col("kb") < F.col("ka")) | ((F.col("kb") == F.col("ka")) & (F.col("b") < F.col("a")))
    back = F.when(F.col("m") == 3, 3).otherwise(3 - F.col("m"))
    own = F.when(turn, F.struct(F.col("b").alias("u"), F.col("ka").alias("k"), F.col("a").alias("v"), back.alias("m"))).otherwise(F.struct(F.col("a").alias("u"), F.col("kb").alias("k"), F.col("b").alias("v"), F.col("m")))
    near = p.select(own.alias("o")).select("o.*").groupBy("u").agg(F.array_sort(F.collect_list(F.struct("k", "v", "m"))).alias("l")).checkpoint()
    part = lambda l, c: F.transform(l, lambda x: x[c])  # noqa: E731, E741
    sent = near.select("l", F.posexplode("l").alias("i", "x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("m1"), F.slice("l", F.col("i") + 2, F.size("l")).alias("l")).where(F.size("l") > 0)
    met = sent.select("u", "m1", part("l", "v").alias("w2"), part("l", "m").alias("m2")).join(near.select("u", part("l", "v").alias("w3"), part("l", "m").alias("m3")), "u").drop("u")
    loops, cycles = triangle_tables()

    def count(batches):
        found = [0, 0]
        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            ends = np.cumsum(col("w2").value_lengths().to_numpy().astype(np.int64) + col("w3").value_lengths().to_numpy())
            start = 0
            while start < b.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
                m1, w2, m2, w3, m3 = (col(c).slice(start, stop - start) for c in ("m1", "w2", "m2", "w3", "m3"))
                row2, row3 = (np.repeat(np.arange(stop - start), w.value_lengths().to_numpy()) for w in (w2, w3))
                names, code = np.unique(np.concatenate([flat(w2), flat(w3)]), return_inverse=True)
                place = np.concatenate([row2, row3]) * len(names) + code
                _, i, j = np.intersect1d(place[: len(row2)], place[len(row2) :], assume_unique=True, return_indices=True)
                kinds = (m1.to_numpy()[row2[i]], flat(m2)[i], flat(m3)[j])
                found[0] += int(loops[kinds].sum())
                found[1] += int(cycles[kinds].sum())
                start = stop
        yield pa.RecordBatch.from_arrays([pa.array([n]) for n in found], ["f", "c"])

    n = met.mapInArrow(count, "f long, c long").agg(F.coalesce(F.sum("f"), F.lit(0)).alias("feed_forward"), F.coalesce(F.sum("c"), F.lit(0)).alias("cycles"))
    return n.crossJoin(F.broadcast(pairs.agg(F.count_if(F.col("m") == 3).alias("mutual"))))  # one row each


def degree_distance(a: DataFrame, b: DataFrame, node: str) -> DataFrame:
    """Mean absolute difference of two degree sequences, sorted and joined by rank; degrees are counted first."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        deg = df.groupBy(node).agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
        w = Window.partitionBy(F.lit(1)).orderBy(F.desc("k"))  # a row for each degree
        return deg.withColumn("hi", F.sum("n").over(w)).select(F.explode(F.sequence(F.col("hi") - F.col("n") + 1, F.col("hi"))).alias("rank"), F.col("k").alias(name))

    j = ranked(a, "x").join(ranked(b, "y"), "rank", "full").fillna(0, ["x", "y"])
    return j.agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("distance"), F.count("*").alias("n"))


def edge_persistence(edges: DataFrame, window: str, total: int) -> DataFrame:
    return edges.groupBy("src", "dst").agg((F.count_distinct(window) / total).alias("persistence"))


def block_profile(cells: DataFrame, keys: list[str], r: str, c: str, value: str, factors: list[int]) -> DataFrame:
    """Mean and sd of block means for each block size."""
    d = cells.select(*keys, r, c, value, F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor"))
    b = d.groupBy(*keys, "factor", F.floor(F.col(r) / F.col("factor")).alias("_r"), F.floor(F.col(c) / F.col("factor")).alias("_c")).agg(F.avg(value).alias("m"))
    return b.groupBy(*keys, "factor").agg(F.count("*").alias("blocks"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))


def effective_information(states: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Entropy of the mean transition row minus the mean entropy of rows, in bits."""
    w = Window.partitionBy(*keys).orderBy(*order)
    t = states.withColumn("_f", F.lag(state).over(w)).where("_f IS NOT NULL").groupBy(F.col("_f").alias("f"), F.col(state).alias("t")).agg(F.count("*").alias("n"))
    t = t.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("f")))
    rows = t.groupBy("f").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.sum("n").alias("visits"))
    k = rows.agg(F.count("*").alias("k"), F.avg("h").alias("row_h"), F.avg((F.col("visits") >= 5).cast("int")).alias("coverage"))  # one row
    mean = t.groupBy("t").agg(F.sum("p").alias("s")).crossJoin(F.broadcast(k)).withColumn("q", F.col("s") / F.col("k"))
    return mean.agg((-F.sum(F.col("q") * F.log2("q"))).alias("mean_h"), F.first("row_h").alias("row_h"), F.first("coverage").alias("coverage")).select((F.col("mean_h") - F.col("row_h")).alias("ei"), "coverage")


def quasi_potential(points: DataFrame, keys: list[str], x: str, y: str, bins: int, diffusion: float = 1.0) -> DataFrame:
    """-D ln of the share of points in each cell of a bins x bins grid."""
    w = Window.partitionBy(*keys)

    def at(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / (hi - lo) * bins))).otherwise(0).cast("int")

    g = points.withColumn("i", at(x)).withColumn("j", at(y)).groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    return g.withColumn("potential", -diffusion * F.ln(F.col("n") / F.sum("n").over(w)))


def energy_balance(df: DataFrame, keys: list[str], order: list[str], energy: str, power_in: str, power_out: str, dt: float, tolerance: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    e = F.abs(F.col(energy) - F.lag(energy).over(w) - (F.col(power_in) - F.col(power_out)) * dt)
    g = df.withColumn("_e", e).groupBy(*keys).agg(F.max("_e").alias("error"), F.max(F.abs(energy)).alias("scale"))
    return g.withColumn("balanced", F.col("error") <= tolerance * F.greatest("scale", F.lit(1e-12)))


def feature_divergence(df: DataFrame, keys: list[str], order: list[str], price: str, features: list[str]) -> DataFrame:
    """Cosine of (change of price, 0, ...) with the changes of the features, all as z-scores of their changes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    cols = [price, *features]
    d = df.withColumns({f"_{c}": F.col(c) - F.lag(c).over(w) for c in cols}).where(F.col(f"_{price}").isNotNull())
    s = d.groupBy(*keys).agg(*[f(f"_{c}").alias(f"{n}{c}") for c in cols for n, f in (("m_", F.avg), ("s_", F.stddev_pop))])
    d = d.join(s, keys)
    z = {c: F.coalesce((F.col(f"_{c}") - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in cols}
    norm = F.sqrt(sum((z[c] * z[c] for c in features), F.lit(0.0)))
    return d.withColumn("cosine", F.coalesce(F.signum(z[price]) * z[features[0]] / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))


def temporal_features(cells: DataFrame, run: str, step: str, cell: list[str], value: str) -> DataFrame:
    """For each run: mean and sd of the step changes, smoothness, energy, and mean recurrence (cosine of a step with the one before)."""
    w = Window.partitionBy(run, *cell).orderBy(step)
    v, p = F.col(value), F.lag(value).over(w)
    d = cells.withColumn("_p", p)
    s = d.groupBy(run, step).agg(F.avg(F.abs(v - F.col("_p"))).alias("change"), F.avg(v * v).alias("energy"), (F.sum(v * F.col("_p")) / F.nullif(F.sqrt(F.sum(F.when(F.col("_p").isNotNull(), v * v))) * F.sqrt(F.sum(F.col("_p") * F.col("_p"))), F.lit(0.0))).alias("cosine"))
    g = s.groupBy(run).agg(F.avg("change").alias("change"), F.stddev_samp("change").alias("volatility"), F.avg("energy").alias("energy"), F.avg("cosine").alias("recurrence"))
    return g.withColumn("smoothness", 1 / (1 + F.col("change")))


def early_warning(steps: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Variance ratio and range growth of the second half against the first, lag-1 autocorrelation, and a class."""
    w = Window.partitionBy(run)
    d = steps.withColumn("_i", F.row_number().over(w.orderBy(step)) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_l", F.lag(value).over(w.orderBy(step)))
    late = F.col("_i") >= F.col("_n") / 2
    a, b = F.when(~late, F.col(value)), F.when(late, F.col(value))
    g = d.groupBy(run).agg((F.var_pop(b) / F.nullif(F.var_pop(a), F.lit(0.0))).alias("variance_ratio"), ((F.max(b) - F.min(b)) / F.nullif(F.max(a) - F.min(a), F.lit(0.0))).alias("range_growth"), F.corr(value, "_l").alias("memory"), F.skewness(value).alias("skew"))
    score = F.least(F.lit(1.0), (F.greatest(F.lit(0.0), F.coalesce(F.col("variance_ratio"), F.lit(1.0)) - 1) + F.greatest(F.lit(0.0), F.coalesce("memory", F.lit(0.0)))) / 2)
    return g.withColumn("score", score).withColumn("class", F.when(F.col("score") > 0.6, "critical").when(F.col("score") > 0.3, "warning").otherwise("stable"))


def grid_connectivity(cells: DataFrame, keys: list[str], r: str, c: str, value: str) -> DataFrame:
    """Active share (above mean plus sd), and mean number of active right and lower neighbours of active cells."""
    stats = cells.groupBy(*keys).agg((F.avg(value) + F.stddev_pop(value)).alias("_t"))
    on = cells.join(stats, keys).withColumn("on", (F.col(value) > F.col("_t")).cast("int"))
    share = on.groupBy(*keys).agg(F.avg("on").alias("active"))
    a = on.where("on = 1").select(*keys, F.col(r).alias("r"), F.col(c).alias("c"))
    near = a.select(*keys, "r", "c", F.explode(F.array(F.struct((F.col("r") + 1).alias("r2"), F.col("c").alias("c2")), F.struct(F.col("r").alias("r2"), (F.col("c") + 1).alias("c2")))).alias("s")).select(*keys, "r", "c", "s.*")
    hit = near.join(a.select(*keys, F.col("r").alias("r2"), F.col("c").alias("c2"), F.lit(1).alias("hit")), [*keys, "r2", "c2"], "left")
    g = hit.groupBy(*keys).agg((2 * F.avg(F.coalesce("hit", F.lit(0)))).alias("neighbours"))
    return share.join(g, keys, "left")
