"""Queries on streams (ST rows): files are streamed to their end and compared with what a batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import folds as O
from lodestream.streaming import backlog as B
from lodestream.streaming import jobs as S
from lodestream.streaming import keyed as K

from .registry import query, table, ticks
from .summing import r
from .timing import s, stamp


@query("SELECT event_id, user_id, event_type, value + 2 AS value FROM events")
def st1_materialise(spark, d):
    """Three versions of each event at one time: the last one is stored, once."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    e = e.withColumn("version", F.explode(F.array(*[F.lit(v) for v in (1, 0, 2)]))).withColumn("value", F.col("value") + F.col("version"))
    return S.materialise(S.feed(e, "ts"), ["event_id"], ["ts", "version"]).select("event_id", "user_id", "event_type", "value")


LATE, EXPIRE, IDLE = "6 hours", "1 day", "4 days"
#: Row i of a key is two moments, 2 i before and 2 i + 1 after it counts; the last moment is the stream's end.
BACKLOG = """WITH e AS (SELECT user_id, event_type AS source, event_id, epoch_us(ts) AS ev, epoch_us(ts) + CASE WHEN event_id % 7 = 0 THEN 3 * 86400 ELSE event_id % 60 END * 1000000 AS arr FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arr, event_id) AS i FROM e), fin AS (SELECT user_id, max(i) + 1 AS i, (SELECT max(arr) // 1000 * 1000 FROM e) - 3600000000 AS now FROM o GROUP BY user_id),
x AS (SELECT user_id, i, arr AS now, source, ev, arr FROM o UNION ALL SELECT user_id, i, now, NULL, NULL, NULL FROM fin), s AS (SELECT DISTINCT user_id, source AS s FROM e),
g AS (SELECT x.user_id, i, now, max(CASE WHEN source = s THEN ev END) OVER up AS new1, max(CASE WHEN source = s THEN arr END) OVER up AS last1, max(CASE WHEN source = s THEN ev END) OVER low AS new0, max(CASE WHEN source = s THEN arr END) OVER low AS last0 FROM x JOIN s ON x.user_id = s.user_id
WINDOW up AS (PARTITION BY x.user_id, s ORDER BY i ROWS UNBOUNDED PRECEDING), low AS (PARTITION BY x.user_id, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT user_id, 2 * i AS p, coalesce(min(new0) FILTER (now - last0 <= 4 * 86400000000) - 6 * 3600000000, max(new0)) AS low FROM g GROUP BY ALL UNION ALL SELECT user_id, 2 * i + 1, coalesce(min(new1) FILTER (now - last1 <= 4 * 86400000000) - 6 * 3600000000, max(new1)) FROM g GROUP BY user_id, i),
w AS (SELECT user_id, p, max(low) OVER (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS wm FROM m), b AS (SELECT o.*, wm FROM o JOIN w ON o.user_id = w.user_id AND p = 2 * i),
k AS (SELECT b.*, CASE WHEN ev < wm - 86400000000 THEN 'expired' WHEN ev <= wm THEN 'late' ELSE 'in order' END AS status FROM b), r AS (SELECT k.user_id, event_id, ev, status, CASE WHEN status = 'late' THEN 2 * i + 0.5 ELSE min(p) END AS p FROM k JOIN w ON k.user_id = w.user_id AND w.wm >= ev AND w.p > 2 * i WHERE status <> 'expired' GROUP BY k.user_id, event_id, ev, status, i)"""


@query(f"""{BACKLOG} SELECT user_id, event_id, status, row_number() OVER (PARTITION BY user_id ORDER BY p, ev, event_id) AS position FROM r UNION ALL SELECT user_id, event_id, status, NULL FROM k WHERE status = 'expired'""")
def st2_backlog(spark, d):
    """Each user's events of several types, every seventh three days late, in the order in which they may go on."""
    delay = F.when(F.col("event_id") % 7 == 0, 3 * 86400).otherwise(F.col("event_id") % 60)
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", F.timestamp_micros(F.unix_micros("ts") + delay * 1_000_000).alias("arrival"))
    out = B.released(S.feed(e, "arrival", batches=3), "user_id", "event_type", "ts", "arrival", "event_id", LATE, EXPIRE, IDLE)
    return S.drain(out, provider=S.ROCKS)


@query("SELECT event_type, count(*) AS n, round(avg(event_id % 60 * 1000000), 3) AS lag FROM events GROUP BY ALL")
def st3_lag(spark, d):
    e = table(spark, d, "events").withColumn("arrival", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 60 * 1_000_000))
    return r(S.lag_by_source(e, "event_type", "ts", "arrival"), 3)


@query(f"""WITH w AS (SELECT event_type AS symbol, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS st, ts, value FROM events, (SELECT unnest([0, 1]) AS k)) SELECT symbol, {s("st")} AS start, round(avg(value), 6) AS mean, count(*) AS n FROM w GROUP BY symbol, st HAVING st + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def st4_sliding_mean(spark, d):
    out = S.drain(S.sliding_mean(S.feed(ticks(spark, d), "ts"), ["symbol"], "ts", "price", "1 hour", "30 minutes", "2 hours"))
    return r(out.select("symbol", stamp("start").alias("start"), "mean", "n"))


@query("""WITH x AS (SELECT l_suppkey AS book, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, l_partkey % 50 AS price, l_quantity - 10 AS qty, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), sn AS (SELECT * FROM x WHERE seq % 97 = 0), l AS (SELECT book, max(seq) AS s FROM sn GROUP BY book),
u AS (SELECT x.* FROM x JOIN l USING (book) WHERE seq >= s AND (seq % 97 <> 0 OR seq = s)), g AS (SELECT book, side, price, arg_max(qty, (seq, qty)) AS qty FROM u GROUP BY ALL) SELECT * FROM g WHERE qty > 0""")
def st5_book_state(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("book"), F.when(F.col("l_linenumber") % 2 == 0, "bid").otherwise("ask").alias("side"), (F.col("l_partkey") % 50).alias("price"), (F.col("l_quantity") - 10).alias("qty"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return S.book_state(x.where("seq % 97 <> 0"), x.where("seq % 97 = 0"), "book", "side", "price", "qty", "seq")


@query("""WITH x AS (SELECT l_suppkey AS book, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, (l_partkey % 50)::DOUBLE AS price, l_quantity - 10 AS qty, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), l AS (SELECT book, max(seq) AS s FROM x WHERE seq % 97 = 0 GROUP BY book),
u AS (SELECT x.* FROM x JOIN l USING (book) WHERE seq >= s), g AS (SELECT book, side, price, arg_max(qty, (seq, qty)) AS qty FROM u GROUP BY ALL) SELECT * FROM g WHERE qty > 0""")
def st5_book_levels(spark, d):
    """Books fed in three batches, as their levels stand at the end."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("book"), F.when(F.col("l_linenumber") % 2 == 0, "bid").otherwise("ask").alias("side"), (F.col("l_partkey") % 50).alias("price"), (F.col("l_quantity") - 10).alias("qty"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    x = x.withColumn("snapshot", F.col("seq") % 97 == 0)
    out = S.drain(K.book_levels(S.feed(x, "seq", batches=3), "book", "side", "price", "qty", "seq", "snapshot"), "update", S.ROCKS)
    return out.groupBy("book", "side", "price").agg(F.max_by("qty", F.struct("seq", "batch")).alias("qty")).where("qty > 0")


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS book, l_orderkey AS seq FROM lineitem), y AS (SELECT book, seq, lag(seq) OVER (PARTITION BY book ORDER BY seq) AS b FROM x) SELECT book, b + 1 AS "from", seq - 1 AS "to" FROM y WHERE seq > b + 1""")
def st5_sequence_gaps(spark, d):
    return S.sequence_gaps(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_orderkey").alias("seq")).distinct(), "book", "seq")


@query("""WITH o AS (SELECT event_type AS symbol, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT symbol, n, round(sum(CASE WHEN i = 1 THEN 1 ELSE 0.1::DOUBLE END * pow(0.9::DOUBLE, n - i) * v), 6) AS mean FROM o GROUP BY symbol, n""")
def st6_running_means(spark, d):
    stream = S.running_means(S.feed(ticks(spark, d).select("symbol", "event_id", "price", "ts"), "ts"), "symbol", ["ts", "event_id"], "price", 0.1)
    from lodestream.sources.files import work_path

    out, marks = work_path(spark, "means"), work_path(spark, "marks")
    stream.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("symbol").agg(F.max(F.struct("n", "mean")).alias("m"))
    return last.select("symbol", "m.n", F.round("m.mean", 6).alias("mean"))


@query("SELECT event_id, user_id FROM events")
def st7_once_each(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return S.drain(S.once_each(S.feed(e.union(e), "ts"), ["event_id"], "ts", "40 days")).select("event_id", "user_id")


@query("SELECT sha256(props) AS digest, count(*) AS failures, min(event_id) AS \"first\", count(*) >= 5 AS toxic FROM events WHERE value < 30 GROUP BY sha256(props)")
def st8_dead_letters(spark, d):
    return S.dead_letters(table(spark, d, "events"), "event_id", "props", F.col("value") < 30, 5)


@query("SELECT event_id, round(quantile_cont(value, 0.95) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2047 PRECEDING AND CURRENT ROW), 6) AS p95 FROM events")
def st9_rolling_percentile(spark, d):
    return O.rolling_percentile(ticks(spark, d), ["symbol"], ["ts", "event_id"], "price", 0.95).select("event_id", F.round("p", 6).alias("p95"))


@query("""WITH o AS (SELECT event_id % 3 AS part, value, row_number() OVER (PARTITION BY event_id % 3 ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY event_id % 3) AS seen FROM events)
SELECT part, seen, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM o WHERE back <= 2048 GROUP BY part, seen""")
def st9_latency_windows(spark, d):
    """The last 2,048 values of three streams, as they stand after the last batch."""
    e = table(spark, d, "events").select((F.col("event_id") % 3).alias("part"), "ts", "event_id", "value")
    out = S.drain(K.latency_windows(S.feed(e, "ts", batches=3), "part", "ts", "event_id", "value"), "update", S.ROCKS)
    last = out.groupBy("part").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("part", "batch")]), "seen").alias("r"))
    return r(last.select("part", "r.*"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS t, 2.0::DOUBLE AS tokens, true AS ok FROM events UNION ALL SELECT user_id, event_id, i, t, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1 FROM (SELECT o.user_id, o.event_id, o.i, o.t, least(2.0::DOUBLE, tokens + coalesce((o.t - f.t) * (1.0::DOUBLE / 36000), 0)) AS have FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
SELECT user_id, event_id, ok AS allowed, round(tokens, 6) AS tokens FROM f WHERE i > 0""")
def st10_buckets(spark, d):
    """Every request against a bucket that refills in ten hours a token."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return r(S.drain(K.token_buckets(S.feed(e, "ts", batches=3), "user_id", "ts", "event_id", 1 / 36000, 2), provider=S.ROCKS))


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS t, 3.0::DOUBLE AS tokens, true AS ok FROM events UNION ALL SELECT user_id, i, t, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1 FROM (SELECT o.user_id, o.i, o.t, least(3.0::DOUBLE, tokens + coalesce((o.t - f.t) * (1.0::DOUBLE / 3600), 0)) AS have FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
SELECT user_id, CAST(count(*) FILTER (i > 0 AND ok) AS INT) AS allowed, CAST(count(*) FILTER (NOT ok) AS INT) AS refused FROM f GROUP BY user_id""")
def st10_token_bucket(spark, d):
    e = table(spark, d, "events").withColumn("sec", F.unix_micros("ts") / 1e6)
    return O.token_bucket(e, "user_id", ["ts", "event_id"], "sec", 1 / 3600, 3)


@query(f"SELECT event_id, {s('ts')} AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def st11_replay(spark, d):
    return S.replay(table(spark, d, "events").select("event_id", "ts"), "ts", "2024-01-20").withColumn("ts", stamp("ts"))


@query(f"""WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, {s("min(ts)")} AS start, {s("max(ts) + INTERVAL 2 HOUR")} AS "end", count(*) AS n FROM y GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 3 HOUR FROM events)""")
def st12_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", "ts")
    out = S.drain(S.sessions(S.feed(e, "ts"), ["user_id"], "ts", "2 hours", "3 hours"))
    return out.select("user_id", stamp("start").alias("start"), stamp("end").alias("end"), "n")


@query(f"SELECT event_type, {s('b')} AS bucket, count(*) AS n, round(avg(user_id), 6) AS mean, max(user_id) AS worst FROM (SELECT *, date_trunc('day', ts) AS b FROM events) GROUP BY event_type, b")
def st13_freshness(spark, d):
    g = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("bucket")).agg(F.count("*").alias("n"), F.avg("user_id").alias("mean"), F.max("user_id").alias("worst"))
    return r(g.withColumn("bucket", stamp("bucket")))
