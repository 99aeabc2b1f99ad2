"""Queries on labels, splits and models (N rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import modelling as N

from .registry import query, table, ticks
from .summing import RETURNS, r, returns
from .timing import HOURS, hours


@query("""WITH x AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events), f AS (SELECT unnest(range(5)) AS fold), b AS (SELECT fold, fold * (n // 5) + least(fold, n % 5) AS lo, (fold + 1) * (n // 5) + least(fold + 1, n % 5) AS hi FROM f, (SELECT count(*) AS n FROM events))
SELECT CAST(fold AS INT) AS fold, pos, CASE WHEN pos >= lo AND pos < hi THEN 'test' ELSE 'train' END AS role FROM x, b WHERE (pos >= lo AND pos < hi) OR ((pos + 6 <= lo OR pos >= hi) AND NOT (pos >= lo - 20 AND pos < hi + 20))""")
def n1_purged_folds(spark, d):
    # a row's label ends six positions on, so the end is known once positions are
    e = N.global_position(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], "p").withColumn("end", F.col("p") + 6)
    return N.purged_folds(e, ["ts", "event_id"], "end", 5, 20)


@query("""WITH x AS (SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), s AS (SELECT symbol, unnest(range(0, (any_value(n) - 50 - 20) // 20 + 1)) AS split FROM x GROUP BY symbol)
SELECT symbol, split, i, CASE WHEN i < split * 20 + 50 THEN 'train' ELSE 'test' END AS role FROM x JOIN s USING (symbol) WHERE i >= split * 20 AND i < split * 20 + 70""")
def n2_walk_forward(spark, d):
    return N.walk_forward(ticks(spark, d), ["symbol"], ["ts", "event_id"], 50, 20).select("symbol", "split", "i", "role")


@query("""WITH x AS (SELECT event_type AS symbol, abs(value - 50) AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events), y AS (SELECT *, pow(0.5, age / 100.0) AS w FROM x WHERE age < 2000), z AS (SELECT symbol, s, sum(w) OVER (PARTITION BY symbol ORDER BY s, age ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY symbol) AS share FROM y)
SELECT symbol, round(min(s), 6) AS width FROM z WHERE share >= 1 - 0.1 - 1e-12 GROUP BY symbol""")
def n4_conformal_width(spark, d):
    return r(N.conformal_width(ticks(spark, d).withColumn("e", F.col("price") - 50), ["symbol"], ["ts", "event_id"], "e", 0.1, 100.0))


@query()
def n5_regimes(spark, d):
    """Mixture of three regimes over rolling features, named by their mean volatility."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(-19, 0)
    x = ticks(spark, d).select("symbol", "event_id", F.avg("price").over(w).alias("trend"), F.coalesce(F.stddev_pop("price").over(w), F.lit(0.0)).alias("vol"))
    v = VectorAssembler(inputCols=["trend", "vol"], outputCol="features").transform(x)
    m = GaussianMixture(k=3, seed=1, maxIter=10).fit(v)
    return N.label_by_profile(m.transform(v).select("symbol", "event_id", "vol", "prediction"), "prediction", "vol", ["calm", "normal", "wild"]).groupBy("regime").agg(F.count("*").alias("n"), F.avg("vol").alias("vol"))


@query()
def n6_scenarios(spark, d):
    """Paths with drift and sd of the observed hourly log changes."""
    h = hours(spark, d).withColumn("x", F.ln(F.greatest("close", F.lit(1.0))))
    m = h.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()  # two numbers
    p = N.scenarios(spark, 200, 50, 0.0, float(m["s"] or 0.0) / 50)
    return p.where("step = 50").agg(F.percentile("price", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.count("*").alias("n"))


@query(f"""WITH h AS ({HOURS}), s AS (SELECT unnest(['fast', 'slow']) AS name, unnest([1, 6]) AS n), a AS (SELECT name, symbol, b, close, coalesce(sign(close - CASE WHEN name = 'fast' THEN lag(close, 1) OVER w ELSE lag(close, 6) OVER w END), 0) AS sig FROM (SELECT s.name, h.symbol, h.b, h.close FROM h, s) WINDOW w AS (PARTITION BY name, symbol ORDER BY b)),
p AS (SELECT *, coalesce(lag(sig) OVER w, 0) AS pos, abs(coalesce(lag(sig) OVER w, 0) - coalesce(lag(sig, 2) OVER w, 0)) AS turn, coalesce(close - lag(close) OVER w, 0) AS dp FROM a WINDOW w AS (PARTITION BY name, symbol ORDER BY b)) SELECT name, symbol, round(sum(pos * dp - 0.01 * turn), 4) AS pnl, count(*) FILTER (turn > 0) AS trades FROM p GROUP BY name, symbol""")
def n7_batch_evaluation(spark, d):
    s = spark.createDataFrame([("fast", 1), ("slow", 6)], "name string, span int")
    return r(N.evaluate(hours(spark, d), ["symbol"], ["bucket"], "close", s, 0.01), 4)


@query()
def n8_linear_probe(spark, d):
    """Held-out accuracy of a linear probe of labels from vectors, against the share of the largest class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    held = F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0
    m = LogisticRegression(maxIter=20, regParam=0.01).fit(e.where(~held))
    return m.transform(e.where(held)).agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT symbol, ts, event_id, least(1, greatest(-1, ret)) AS p FROM ({RETURNS}) WHERE ret IS NOT NULL), c AS (SELECT *, sum(p) OVER w AS c, sum(CAST(p >= 0 AS INT)) OVER w AS isl FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) - c AS dd, sum(CAST(p < 0 AS INT)) OVER (PARTITION BY symbol, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS losses FROM c)
SELECT event_id, round(dd, 5) AS drawdown, CAST(losses AS BIGINT) AS losses, max(CAST(dd > 3.0000001 OR losses >= 4 AS INT)) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) = 1 AS halted FROM g""")
def n9_guardrails(spark, d):
    x = returns(spark, d).withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("ret"))))
    return r(N.guardrails(x, ["symbol"], ["ts", "event_id"], "p", 3.0000001, 4, 10).select("event_id", "drawdown", "losses", "halted"), 5)
