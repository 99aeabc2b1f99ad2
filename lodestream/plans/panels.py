"""Queries on graphs and grids (M rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.operators import joins as J
from lodestream.operators import panels as M

from .joining import edges, panel
from .registry import query, table, ticks
from .summing import r

CORR = """p AS (SELECT event_type AS asset, time_bucket(INTERVAL 6 HOUR, ts) AS b, avg(value) AS v FROM events GROUP BY ALL), c AS (SELECT x.asset AS a, y.asset AS b, corr(x.v, y.v) AS corr FROM p x JOIN p y ON x.b = y.b AND x.asset < y.asset GROUP BY ALL)"""
#: Users, joined to the user of the next event of the same type.
GRAPH = "e AS (SELECT DISTINCT * FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"


def corr(spark, d):
    return J.pairwise_correlation(panel(spark, d), "asset", "ts", "v")


def graph(spark, d):
    then = F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("src"), then.alias("dst")).where("dst IS NOT NULL").distinct()


@query(f"WITH {CORR} SELECT a, b, round(abs(corr), 6) AS weight FROM c WHERE abs(corr) >= 0.02")
def m1_correlation_graph(spark, d):
    return r(M.correlation_graph(corr(spark, d), 0.02))


@query("""WITH e AS (SELECT DISTINCT user_id AS a, event_id % 50 AS b FROM events), k AS (SELECT v, count(*) AS k FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) GROUP BY v) SELECT a, b, 4 - x.k - y.k AS curvature FROM e JOIN k x ON a = x.v JOIN k y ON b = y.v""")
def m3_forman_curvature(spark, d):
    return M.forman_curvature(edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("""WITH x AS (SELECT c_nationkey AS k, c_custkey AS i, c_acctbal / 10000 AS v FROM customer), y AS (SELECT *, row_number() OVER w AS n, (sum(v) OVER (PARTITION BY k ORDER BY v DESC, i ROWS UNBOUNDED PRECEDING) - 1) / row_number() OVER w AS t FROM x WINDOW w AS (PARTITION BY k ORDER BY v DESC, i)),
z AS (SELECT k, arg_max(t, n) AS theta FROM y WHERE v > t GROUP BY k) SELECT k, i, round(greatest(0, v - theta), 6) AS weight FROM x JOIN z USING (k)""")
def m3_simplex_projection(spark, d):
    x = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("i"), (F.col("c_acctbal") / 10000).alias("v"))
    return r(M.simplex_projection(x, ["k"], "i", "v"))


@query(f"WITH {CORR}, g AS (SELECT sum(corr * corr) AS s, stddev_pop(abs(corr)) AS sd, 5 AS n FROM c) SELECT round(n * n / (n + 2 * s) / n * (1 + sd), 6) AS score FROM g")
def m4_topology_proxy(spark, d):
    return r(M.topology_proxy(corr(spark, d), F.lit(5)))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT o_custkey AS a, 10000000000 + o_orderkey AS b FROM orders), e AS (SELECT a, b FROM n UNION SELECT b, a FROM n), w AS (SELECT DISTINCT a AS v, a AS c FROM e UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.v) SELECT v, min(c) AS component FROM w GROUP BY v""")
def m5_components(spark, d):
    o = table(spark, d, "orders")
    return M.components(o.select(F.col("o_custkey").cast("long").alias("a"), (10_000_000_000 + F.col("o_orderkey")).alias("b")).distinct())


@query(f"""WITH {GRAPH}, x AS (SELECT * FROM e WHERE src <> dst), p AS (SELECT a.src AS a, b.dst AS c FROM x a JOIN x b ON a.dst = b.src AND a.src <> b.dst)
SELECT (SELECT count(*) FROM p JOIN x ON x.src = p.a AND x.dst = p.c) AS feed_forward, (SELECT count(*) FROM p JOIN x ON x.src = p.c AND x.dst = p.a) // 3 AS cycles, (SELECT count(*) FROM x a JOIN x b ON a.src = b.dst AND a.dst = b.src) // 2 AS mutual""")
def m7_motifs(spark, d):
    return M.motifs(graph(spark, d))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY count(*) DESC) AS k, count(*) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), b AS (SELECT row_number() OVER (ORDER BY count(*) DESC) AS k, count(*) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) SELECT round(avg(abs(coalesce(x, 0) - coalesce(y, 0))), 6) AS distance, count(*) AS n FROM a FULL JOIN b USING (k)""")
def m8_degree_distance(spark, d):
    o = table(spark, d, "orders")
    return r(M.degree_distance(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey"))


@query("SELECT user_id % 20 AS src, event_id % 20 AS dst, round(count(DISTINCT CAST(ts AS DATE)) / 30, 6) AS persistence FROM events GROUP BY ALL")
def m8_edge_persistence(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("src"), (F.col("event_id") % 20).alias("dst"), F.to_date("ts").alias("day"))
    return r(M.edge_persistence(e, "day", 30))


@query("""WITH c AS (SELECT l_returnflag AS k, l_partkey % 64 AS i, l_suppkey % 64 AS j, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), e AS (SELECT *, unnest([2, 4, 8]) AS factor FROM c), b AS (SELECT k, factor, i // factor AS x, j // factor AS y, avg(v) AS m FROM e GROUP BY ALL) SELECT k, factor, count(*) AS blocks, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd FROM b GROUP BY k, factor""")
def m10_block_profile(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), (F.col("l_partkey") % 64).alias("i"), (F.col("l_suppkey") % 64).alias("j")).agg(F.avg("l_quantity").alias("v"))
    return r(M.block_profile(c, ["k"], "i", "j", "v", [2, 4, 8]))


@query("""WITH s AS (SELECT user_id, ts, event_id, CAST(least(4, floor(value / 25)) AS INT) AS st FROM events), f AS (SELECT lag(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, st AS t FROM s), n AS (SELECT f, t, count(*) AS n FROM f WHERE f IS NOT NULL GROUP BY ALL), p AS (SELECT f, t, n, n / sum(n) OVER (PARTITION BY f) AS p FROM n),
h AS (SELECT f, -sum(p * log2(p)) AS h, sum(n) AS v FROM p GROUP BY f), m AS (SELECT t, sum(p) / (SELECT count(*) FROM h) AS q FROM p GROUP BY t) SELECT round((SELECT -sum(q * log2(q)) FROM m) - avg(h), 6) AS ei, round(avg(CAST(v >= 5 AS INT)), 6) AS coverage FROM h""")
def m12_effective_information(spark, d):
    s = table(spark, d, "events").withColumn("st", F.least(F.lit(4), F.floor(F.col("value") / 25)).cast("int"))
    return r(M.effective_information(s, ["user_id"], ["ts", "event_id"], "st"))


@query("""WITH x AS (SELECT event_type AS k, value AS x, CAST(user_id AS DOUBLE) AS y FROM events), b AS (SELECT k, CAST(least(7, floor((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 8)) AS INT) AS i, CAST(least(7, floor((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) * 8)) AS INT) AS j FROM x WINDOW w AS (PARTITION BY k)), g AS (SELECT k, i, j, count(*) AS n FROM b GROUP BY ALL)
SELECT k, i, j, n, round(-ln(n / sum(n) OVER (PARTITION BY k)), 6) AS potential FROM g""")
def m13_quasi_potential(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("k"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    return r(M.quasi_potential(x, ["k"], "x", "y", 8))


@query("""WITH x AS (SELECT event_type AS k, abs(value - lag(value) OVER w - (user_id - event_id % 10) * 0.1) AS e, abs(value) AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT k, round(max(e), 5) AS error, max(s) AS scale, max(e) <= 0.5 * greatest(max(s), 1e-12) AS balanced FROM x GROUP BY k""")
def m15_energy_balance(spark, d):
    t = ticks(spark, d).withColumn("k", F.col("symbol")).withColumn("o", F.col("event_id") % 10)
    return M.energy_balance(t, ["k"], ["ts", "event_id"], "price", "user_id", "o", 0.1, 0.5).withColumn("error", F.round("error", 5))


@query("""WITH x AS (SELECT event_type AS k, event_id, value - lag(value) OVER w AS p, CAST(user_id - lag(user_id) OVER w AS DOUBLE) AS f, CAST(event_id % 10 - lag(event_id % 10) OVER w AS DOUBLE) AS g FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), s AS (SELECT k, avg(p) AS mp, stddev_pop(p) AS sp, avg(f) AS mf, stddev_pop(f) AS sf, avg(g) AS mg, stddev_pop(g) AS sg FROM x WHERE p IS NOT NULL GROUP BY k)
SELECT event_id, round(coalesce(sign((p - mp) / sp) * ((f - mf) / sf) / nullif(sqrt(((f - mf) / sf) ** 2 + ((g - mg) / sg) ** 2), 0), 0), 6) AS cosine FROM x JOIN s USING (k) WHERE p IS NOT NULL""")
def m16_feature_divergence(spark, d):
    t = ticks(spark, d).withColumn("f", F.col("user_id").cast("double")).withColumn("g", (F.col("event_id") % 10).cast("double"))
    return r(M.feature_divergence(t, ["symbol"], ["ts", "event_id"], "price", ["f", "g"]).select("event_id", "cosine"))


CELLS = "c AS (SELECT event_type AS run, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INT) AS step, user_id % 20 AS cell, avg(value) AS v FROM events GROUP BY ALL)"


def cells(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.unix_date(F.to_date("ts")).alias("step"), (F.col("user_id") % 20).alias("cell")).agg(F.avg("value").alias("v"))


@query(f"""WITH {CELLS}, x AS (SELECT *, lag(v) OVER (PARTITION BY run, cell ORDER BY step) AS p FROM c), s AS (SELECT run, step, avg(abs(v - p)) AS change, avg(v * v) AS energy, sum(v * p) / nullif(sqrt(sum(v * v) FILTER (p IS NOT NULL)) * sqrt(sum(p * p)), 0) AS cosine FROM x GROUP BY ALL)
SELECT run, round(avg(change), 6) AS change, round(stddev_samp(change), 6) AS volatility, round(avg(energy), 5) AS energy, round(avg(cosine), 6) AS recurrence, round(1 / (1 + avg(change)), 6) AS smoothness FROM s GROUP BY run""")
def w21_temporal_features(spark, d):
    return r(M.temporal_features(cells(spark, d), "run", "step", ["cell"], "v"), 6, energy=5)


@query(f"""WITH {CELLS}, s AS (SELECT run, step, avg(v) AS m FROM c GROUP BY ALL), x AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run) AS n, lag(m) OVER w AS l FROM s WINDOW w AS (PARTITION BY run ORDER BY step)),
g AS (SELECT run, var_pop(m) FILTER (i >= n / 2) / nullif(var_pop(m) FILTER (i < n / 2), 0) AS vr, (max(m) FILTER (i >= n / 2) - min(m) FILTER (i >= n / 2)) / nullif(max(m) FILTER (i < n / 2) - min(m) FILTER (i < n / 2), 0) AS rg, corr(m, l) AS mem FROM x GROUP BY run),
k AS (SELECT *, least(1, (greatest(0, coalesce(vr, 1) - 1) + greatest(0, coalesce(mem, 0))) / 2) AS score FROM g) SELECT run, round(vr, 6) AS variance_ratio, round(rg, 6) AS range_growth, round(mem, 6) AS memory, round(score, 6) AS score, CASE WHEN score > 0.6 THEN 'critical' WHEN score > 0.3 THEN 'warning' ELSE 'stable' END AS class FROM k""")
def w20_early_warning(spark, d):
    s = cells(spark, d).groupBy("run", "step").agg(F.avg("v").alias("m"))
    return r(M.early_warning(s, "run", "step", "m").drop("skew"))


@query("""WITH c AS (SELECT l_returnflag AS k, l_partkey % 32 AS r, l_suppkey % 10 AS c, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), t AS (SELECT k, avg(v) + stddev_pop(v) AS t FROM c GROUP BY k), o AS (SELECT c.*, CAST(v > t AS INT) AS o FROM c JOIN t USING (k)), a AS (SELECT k, r, c FROM o WHERE o = 1),
n AS (SELECT a.k, (EXISTS (SELECT 1 FROM a b WHERE b.k = a.k AND b.r = a.r + 1 AND b.c = a.c))::INT + (EXISTS (SELECT 1 FROM a b WHERE b.k = a.k AND b.r = a.r AND b.c = a.c + 1))::INT AS n FROM a) SELECT k, round(avg(o), 6) AS active, (SELECT round(avg(n), 6) FROM n WHERE n.k = o.k) AS neighbours FROM o GROUP BY k""")
def m14_grid_connectivity(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), (F.col("l_partkey") % 32).alias("i"), (F.col("l_suppkey") % 10).alias("j")).agg(F.avg("l_quantity").alias("v"))
    return r(M.grid_connectivity(x, ["k"], "i", "j", "v"))
