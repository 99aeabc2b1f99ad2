"""Queries on sources and sinks (S rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators.primitives import bucket
from lodestream.sources import files as S

from .registry import query, table, ticks
from .summing import r
from .timing import HOURS, hours, s, stamp


@query("SELECT event_id, event_type AS symbol, value AS price FROM events WHERE event_id % 10 <> 0")
def s1_tick_csv(spark, d):
    path = S.work_path(spark, "csv")
    t = ticks(spark, d)
    t.select("event_id", "symbol", F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("price").cast("string")).alias("price")).write.option("header", True).csv(path)
    return S.read_tick_csv(spark, path, "event_id long, symbol string, price double", ["event_id", "price"])[0]


@query("SELECT event_id % 10 = 0 AND event_id % 20 <> 0 AS malformed, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY ALL")
def s2_quarantined_csv(spark, d):
    path = S.work_path(spark, "csv")
    t = ticks(spark, d)
    p = F.when(F.col("event_id") % 20 == 0, None).when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("price").cast("string"))
    t.select("event_id", "symbol", p.alias("price")).write.option("header", True).csv(path)
    bad = S.read_tick_csv(spark, path, "event_id long, symbol string, price double", ["event_id", "price"])[1]
    return bad.groupBy(F.col("_corrupt").isNotNull().alias("malformed")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def s3_parquet_columns(spark, d):
    return S.read_columns(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("SELECT event_id, value AS latency_ms, event_type AS phase FROM events")
def s4_session_log(spark, d):
    path = S.work_path(spark, "log")
    table(spark, d, "events").select("event_id", F.col("value").alias("latency_ms"), F.col("event_type").alias("phase")).write.json(path)
    return S.read_json_lines(spark, path, "event_id long, latency_ms double, phase string")


@query("SELECT CAST(user_id AS VARCHAR) AS session, count(*) AS n FROM events WHERE event_id % 3 > 0 GROUP BY ALL")
def s5_sessions(spark, d):
    path = S.work_path(spark, "sessions")
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), "event_id", F.when(F.col("event_id") % 3 > 0, "OK").otherwise("FAILED").alias("status"))
    e.repartition("session").write.partitionBy("session").json(path)
    return S.read_sessions(spark, path, "event_id long, status string").groupBy("session").agg(F.count("*").alias("n"))


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, count(*) AS n, count(CASE WHEN o_orderkey % 7 > 0 THEN 1 END) AS present FROM orders GROUP BY CAST(o_orderdate AS DATE)")
def s6_economic_csv(spark, d):
    path = S.work_path(spark, "eco")
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice").cast("string")).otherwise(".").alias("value"))
    o.write.option("header", True).csv(path)
    return S.read_economic_csv(spark, path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.count("value").alias("present"))


@query(f"SELECT symbol, CAST(epoch_ms(b) AS BIGINT) AS open_time, close FROM ({HOURS})")
def s7_candles(spark, d):
    c = F.array(F.unix_millis("bucket").cast("string"), *[F.col(x).cast("string") for x in ("open", "high", "low", "close")])
    j = hours(spark, d).groupBy("symbol", F.to_date("bucket").alias("day")).agg(F.to_json(F.collect_list(c)).alias("candles"))
    return S.candle_closes(j, "symbol", "candles")


@query("""WITH x AS (SELECT event_type AS k, event_id, ts, value - 5 AS v, CASE WHEN event_id % 9 > 0 THEN props END AS p, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS t FROM events)
SELECT k, event_id, 'time' AS error FROM x WHERE ts < t UNION ALL SELECT k, event_id, 'sign:v' FROM x WHERE v <= 0 UNION ALL SELECT k, event_id, 'null:p' FROM x WHERE p IS NULL""")
def s8_contract_errors(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("k"), "event_id", "ts", (F.col("value") - 5).alias("v"), F.when(F.col("event_id") % 9 > 0, F.col("props")).alias("p"))
    return S.contract_errors(e, ["k"], "ts", "event_id", ["v"], ["p"])


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) AS micros FROM events")
def s9_epoch_units(spark, d):
    sec = F.unix_seconds("ts")
    e = table(spark, d, "events").withColumn("x", F.when(F.col("event_id") % 4 == 0, sec).when(F.col("event_id") % 4 == 1, sec * 1000).when(F.col("event_id") % 4 == 2, sec * 1_000_000).otherwise(sec * 1_000_000_000))
    return e.select("event_id", S.epoch_to_timestamp("x").alias("micros"))


@query("SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY event_type, CAST(ts AS DATE)")
def s10_partitioned_write(spark, d):
    path = S.work_path(spark, "ticks")
    S.write_partitioned(ticks(spark, d).withColumn("day", F.to_date("ts")), path, ["day"])
    return spark.read.parquet(path).where("day < '2024-01-10'").groupBy("symbol", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT true AS equal, count(*) AS n FROM events")
def s11_sink_integrity(spark, d):
    path = S.work_path(spark, "sink")
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    e.write.parquet(path)
    a, b = S.fingerprint(e, e.columns), S.fingerprint(spark.read.parquet(path), e.columns)
    return a.join(b.select(F.col("n").alias("m"), F.col("a").alias("x"), F.col("b").alias("y")), F.col("a") == F.col("x")).select(((F.col("b") == F.col("y")) & (F.col("n") == F.col("m"))).alias("equal"), "n")


@query("""SELECT CAST(event_id AS VARCHAR) AS "key", '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS value FROM events""")
def s12_publish_json(spark, d):
    path = S.work_path(spark, "broker")
    S.publish_json(table(spark, d, "events").select("user_id", "event_id"), path, "event_id")
    return spark.read.schema("key string, value string").json(path)


@query(f"SELECT event_type AS symbol, user_id % 5 AS venue, {s('min(ts)')} AS \"first\", {s('max(ts)')} AS \"last\", count(*) AS n FROM events GROUP BY event_type, user_id % 5")
def s13_batch_notice(spark, d):
    g = S.batch_notice(ticks(spark, d).withColumn("venue", F.col("user_id") % 5), ["symbol", "venue"], "ts")
    return g.withColumn("first", stamp("first")).withColumn("last", stamp("last"))


@query("""WITH h AS (SELECT sha256(concat_ws(chr(31), o_orderkey, o_orderstatus)) AS h FROM orders) SELECT count(*) AS n, CAST(CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS a, CAST(CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS b FROM h""")
def s14_fingerprint(spark, d):
    return S.fingerprint(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"])


@query("""WITH h AS (SELECT o_orderpriority AS g, o_orderkey || ':' || sha256(o_orderkey || '-' || o_custkey) AS line FROM orders) SELECT g, sha256(string_agg(line, chr(10) ORDER BY line)) AS root FROM h GROUP BY g""")
def s15_merkle_root(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey", F.sha2(F.concat_ws("-", "o_orderkey", "o_custkey"), 256).alias("h"))
    return S.merkle_root(o, "g", "o_orderkey", "h")


@query("SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY ALL")
def s16_latest_versions(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return S.latest_versions(o, ["o_custkey"], "version")


@query(f"""SELECT event_type AS symbol, {s("time_bucket(INTERVAL 12 HOUR, ts)")} AS bucket, CASE WHEN date_diff('day', time_bucket(INTERVAL 12 HOUR, ts), TIMESTAMP '2024-02-01') <= 7 THEN 'hot' WHEN date_diff('day', time_bucket(INTERVAL 12 HOUR, ts), TIMESTAMP '2024-02-01') <= 14 THEN 'warm' WHEN date_diff('day', time_bucket(INTERVAL 12 HOUR, ts), TIMESTAMP '2024-02-01') <= 21 THEN 'cold' ELSE 'drop' END AS tier, round(avg(value), 6) AS mean, count(*) AS n
FROM events GROUP BY event_type, time_bucket(INTERVAL 12 HOUR, ts)""")
def s17_retention_rollup(spark, d):
    g = ticks(spark, d).groupBy("symbol", bucket("ts", 43200).alias("b")).agg(F.avg("price").alias("mean"), F.count("*").alias("n"))
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("b"))
    return r(g.select("symbol", stamp("b").alias("bucket"), S.retention_tier(age, 7, 14, 21).alias("tier"), "mean", "n"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(regr_slope(value, epoch(date_trunc('second', ts)) - 1704067200), 9) AS slope, count(*) FILTER (value > 80) AS above FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY event_type""")
def s18_audit_trend(spark, d):
    path = S.work_path(spark, "audit")
    table(spark, d, "events").select("event_type", (F.unix_seconds("ts") - 1704067200).alias("t"), "value", F.date_format("ts", "yyyy-MM-dd").alias("day")).write.json(path)
    log = S.read_json_lines(spark, path, "event_type string, t long, value double, day string").where("day >= '2024-01-05' AND day < '2024-01-25'")
    g = log.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.regr_slope("value", "t").alias("slope"), F.count_if(F.col("value") > 80).alias("above"))
    return r(g, 6, slope=9)
