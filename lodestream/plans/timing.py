"""Queries on resampling and time alignment (T rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import resample as R

from .registry import query, table, ticks

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(c: str):
    return F.date_format(c, STAMP)


def s(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


HOURS = "SELECT event_type AS symbol, date_trunc('hour', ts) AS b, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(sum(user_id) AS DOUBLE) AS volume, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL"


def hours(spark, d):
    t = ticks(spark, d).withColumn("size", F.col("user_id").cast("double"))
    return R.bars(t, 3600, ["symbol"], "ts", "event_id", "price", "size")


@query(f"""WITH l AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS b, arg_max(value, (ts, event_id)) AS price, arg_max(user_id, (ts, event_id)) AS user_id FROM events GROUP BY ALL),
g AS (SELECT symbol, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM l GROUP BY symbol)
SELECT symbol, {s("b")} AS bucket, last_value(price IGNORE NULLS) OVER w AS price, last_value(user_id IGNORE NULLS) OVER w AS user_id FROM g LEFT JOIN l USING (symbol, b) WINDOW w AS (PARTITION BY symbol ORDER BY b ROWS UNBOUNDED PRECEDING)""")
def t1_ticks_to_last(spark, d):
    out = R.ticks_to_last(ticks(spark, d), 3600, ["symbol"], "ts", "event_id", ["price", "user_id"])
    return out.withColumn("bucket", stamp("bucket"))


@query(f"SELECT symbol, {s('b')} AS bucket, open, high, low, close, volume, n FROM ({HOURS})")
def t2_ohlcv_bars(spark, d):
    return hours(spark, d).withColumn("bucket", stamp("bucket"))


@query(f"""SELECT symbol, {s("date_trunc('day', b) + INTERVAL 1 DAY")} AS bucket, arg_min(open, b) AS open, max(high) AS high, min(low) AS low, arg_max(close, b) AS close, sum(volume) AS volume, CAST(sum(n) AS BIGINT) AS n
FROM ({HOURS}) GROUP BY symbol, date_trunc('day', b)""")
def t3_coarser_bars(spark, d):
    return R.coarser_bars(hours(spark, d), 86400, ["symbol"], label="right").withColumn("bucket", stamp("bucket"))


@query(f"""WITH h AS ({HOURS}), g AS (SELECT symbol, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM h GROUP BY symbol),
j AS (SELECT g.symbol, g.b, close, coalesce(volume, 0) AS volume, close IS NULL AS filled, row_number() OVER (PARTITION BY g.symbol ORDER BY g.b) AS i FROM g LEFT JOIN h USING (symbol, b)),
k AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER up AS ai, last_value(close IGNORE NULLS) OVER up AS av,
 first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER dn AS bi, first_value(close IGNORE NULLS) OVER dn AS bv FROM j
 WINDOW up AS (PARTITION BY symbol ORDER BY b ROWS UNBOUNDED PRECEDING), dn AS (PARTITION BY symbol ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, {s("b")} AS bucket, round(CASE WHEN close IS NOT NULL THEN close ELSE av + (bv - av) * (i - ai) / (bi - ai) END, 6) AS close, volume, filled FROM k""")
def t4_normalised_bars(spark, d):
    h = hours(spark, d).select("symbol", "bucket", "close", "volume")
    full = R.grid(h, ["symbol"], "bucket", 3600).join(h, ["symbol", "bucket"], "left").withColumn("filled", F.col("close").isNull()).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    out = R.interpolate(full, ["symbol"], ["bucket"], ["close"])
    return out.select("symbol", stamp("bucket").alias("bucket"), F.round("close", 6).alias("close"), "volume", "filled")


@query(f"""WITH e AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS b, value AS b0, value * 0.5 AS b1, CAST(user_id AS DOUBLE) AS a0, user_id * 0.25 AS a1 FROM events),
g AS (SELECT symbol, b, avg(b0) AS b0, avg(b1) AS b1, avg(a0) AS a0, avg(a1) AS a1 FROM e GROUP BY ALL), r AS (SELECT symbol, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM g GROUP BY symbol),
m AS (SELECT r.symbol, r.b, b0, coalesce((b0 + b1 - a0 - a1) / nullif(b0 + b1 + a0 + a1, 0), 0) AS imbalance, (b0 * (a0 + a1) + a0 * (b0 + b1)) / nullif(b0 + b1 + a0 + a1, 0) AS micro FROM r LEFT JOIN g USING (symbol, b))
SELECT symbol, {s("b")} AS bucket, round(imbalance, 6) AS imbalance, round(coalesce(last_value(micro IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY b ROWS UNBOUNDED PRECEDING),
 first_value(micro IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 4) AS micro FROM m""")
def t5_order_book(spark, d):
    t = ticks(spark, d).select("symbol", "ts", F.col("price").alias("b0"), (F.col("price") * 0.5).alias("b1"), F.col("user_id").cast("double").alias("a0"), (F.col("user_id") * 0.25).alias("a1"))
    out = R.order_book(t, 3600, ["symbol"], "ts", ["b0", "b1"], ["a0", "a1"])
    return out.select("symbol", stamp("bucket").alias("bucket"), F.round("imbalance", 6).alias("imbalance"), F.round("micro", 4).alias("micro"))


TEN = "SELECT DISTINCT event_type AS symbol, time_bucket(INTERVAL 10 MINUTE, ts) AS b FROM events"


@query(f"""WITH h AS ({TEN}), g AS (SELECT symbol, unnest(generate_series(min(b), max(b), INTERVAL 10 MINUTE)) AS b FROM h GROUP BY symbol), m AS (SELECT * FROM g ANTI JOIN h USING (symbol, b)),
r AS (SELECT *, epoch(b) - 600 * row_number() OVER (PARTITION BY symbol ORDER BY b) AS run FROM m)
SELECT symbol, {s("min(b)")} AS start, {s("max(b) + INTERVAL 10 MINUTE")} AS "end", count(*) AS buckets FROM r GROUP BY symbol, run""")
def t6_gaps(spark, d):
    h = ticks(spark, d).select("symbol", R.bucket("ts", 600).alias("b"))
    return R.gaps(h, ["symbol"], "b", 600).select("symbol", stamp("start").alias("start"), stamp("end").alias("end"), "buckets")


@query("""WITH o AS (SELECT event_id, value AS v, 0 AS p FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, value * 2, 1 FROM events WHERE event_id % 2 = 0)
SELECT event_id, arg_max(v, p) AS v FROM o GROUP BY event_id""")
def t7_backfill(spark, d):
    e = table(spark, d, "events")
    return R.backfill(e.where("event_id % 3 <> 0").select("event_id", F.col("value").alias("v")), e.where("event_id % 2 = 0").select("event_id", (F.col("value") * 2).alias("v")), ["event_id"])


@query("""WITH m AS (SELECT o_orderpriority AS indicator, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS v FROM orders GROUP BY ALL),
g AS (SELECT indicator, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY indicator)
SELECT indicator, CAST(last_day(month) AS VARCHAR) AS period_end, last_value(v IGNORE NULLS) OVER (PARTITION BY indicator ORDER BY month ROWS UNBOUNDED PRECEDING) AS v, CAST(last_day(month) + 10 AS VARCHAR) AS available_at FROM g LEFT JOIN m USING (indicator, month)""")
def t8_mixed_frequency(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("indicator"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    out = R.monthly_last(o, ["indicator"], "ts", "v", 10)
    return out.select("indicator", F.col("period_end").cast("string").alias("period_end"), "v", F.col("available_at").cast("string").alias("available_at"))


@query(f"""WITH r AS (SELECT event_type AS symbol, ts AS t, avg(value) AS v FROM events GROUP BY ALL), g AS (SELECT symbol, unnest(generate_series(min(date_trunc('hour', t)), max(date_trunc('hour', t)), INTERVAL 1 HOUR)) AS t FROM r GROUP BY symbol),
a AS (SELECT g.symbol, g.t, r.t AS at_, r.v AS av FROM g ASOF JOIN r ON g.symbol = r.symbol AND g.t >= r.t), b AS (SELECT g.symbol, g.t, r.t AS bt, r.v AS bv FROM g ASOF JOIN r ON g.symbol = r.symbol AND g.t <= r.t)
SELECT symbol, {s("t")} AS ts, round(CASE WHEN at_ = t THEN av ELSE av + (bv - av) * (epoch_us(t) - epoch_us(at_)) / (epoch_us(bt) - epoch_us(at_)) END, 6) AS price FROM a JOIN b USING (symbol, t)""")
def t9_uniform_grid(spark, d):
    out = R.uniform_grid(ticks(spark, d), ["symbol"], "ts", "price", 3600)
    return out.select("symbol", stamp("ts").alias("ts"), F.round("price", 6).alias("price"))


@query("""WITH o AS (SELECT event_id, ts, value AS price, 0 AS p FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, ts, value + 1, 1 FROM events WHERE event_id % 3 = 0)
SELECT event_id, arg_max(price, p) AS price, max(p) AS live FROM o WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_id""")
def t10_merge_streams(spark, d):
    t = ticks(spark, d).select("event_id", "ts", "price")
    out = R.merge_streams(t.where("event_id % 4 <> 0"), t.where("event_id % 3 = 0").withColumn("price", F.col("price") + 1), ["event_id"], "2024-01-05", "2024-01-20", "ts")
    return out.select("event_id", "price", "live")
