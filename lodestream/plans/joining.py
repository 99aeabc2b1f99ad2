"""Queries on joins and sets (J and U rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import joins as J
from lodestream.operators import setops as U
from lodestream.operators.primitives import bucket

from .registry import query, table, ticks
from .timing import s, stamp

MACRO = """macro AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS v FROM orders GROUP BY ALL),
mm AS (SELECT ((month - DATE '1990-01-01') % 900) AS k, v FROM macro), m AS (SELECT TIMESTAMP '2024-01-01' + to_hours(CAST(k AS BIGINT)) AS period_end, TIMESTAMP '2024-01-01' + to_hours(CAST(k + 7 AS BIGINT)) AS available_at, max(v) AS v FROM mm GROUP BY k)"""


def macro(spark, d):
    """Monthly order counts, placed on hours of the ticks' month, available seven hours later."""
    o = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("v"))
    k = F.pmod(F.date_diff("month", F.lit("1990-01-01").cast("date")), F.lit(900))
    at = lambda n: F.timestamp_seconds(F.lit(1704067200) + (F.col("k") + n) * 3600)
    return o.groupBy(k.alias("k")).agg(F.max("v").alias("v")).select(at(0).alias("period_end"), at(7).alias("available_at"), "v", F.lit(1).alias("one"))


@query(f"""WITH {MACRO}, a AS (SELECT event_id, ts, m.period_end, m.available_at, m.v FROM events ASOF LEFT JOIN m ON ts >= m.period_end)
SELECT event_id, CASE WHEN available_at <= ts THEN {s("period_end")} END AS matched, CASE WHEN available_at <= ts THEN v END AS v FROM a""")
def j1_join_without_leakage(spark, d):
    # One macro series for all ticks: the ticks are cut into days, and each day takes the series along.
    t = ticks(spark, d).select("event_id", "ts", F.lit(1).alias("one"))
    out = J.join_without_leakage(t, macro(spark, d), ["one"], "ts", "period_end", "available_at", ["v"], slice_seconds=86400)
    return out.select("event_id", stamp("period_end_matched").alias("matched"), "v")


@query(f"""WITH c AS (SELECT DISTINCT time_bucket(INTERVAL 6 HOUR, ts) AS b FROM events),
p AS (SELECT event_type, date_trunc('hour', ts) AS b, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL)
SELECT {s("c.b")} AS ts, x.v AS click, y.v AS view FROM c ASOF LEFT JOIN (SELECT * FROM p WHERE event_type = 'click') x ON c.b >= x.b ASOF LEFT JOIN (SELECT * FROM p WHERE event_type = 'view') y ON c.b >= y.b""")
def j2_align_calendar(spark, d):
    t = ticks(spark, d)
    p = t.groupBy("symbol", bucket("ts", 3600).alias("ts")).agg(F.max_by("price", F.struct("ts", "event_id")).alias("v")).withColumn("one", F.lit(1))
    c = t.select(bucket("ts", 21600).alias("ts")).distinct().withColumn("one", F.lit(1))
    frames = {k: p.where(F.col("symbol") == k).drop("symbol") for k in ("click", "view")}
    return J.align_to_calendar(frames, c, ["one"], "ts", "v").select(stamp("ts").alias("ts"), "click", "view")


@query(f"""WITH p AS (SELECT user_id % 10 AS k, event_type, date_trunc('day', ts) AS b, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL),
f AS (SELECT k, b, max(v) FILTER (event_type = 'click') AS market, max(v) FILTER (event_type = 'view') AS news FROM p WHERE event_type IN ('click', 'view') GROUP BY k, b),
g AS (SELECT k, unnest(generate_series(min(b), max(b), INTERVAL 1 DAY)) AS b FROM f GROUP BY k),
h AS (SELECT g.k, g.b, last_value(market IGNORE NULLS) OVER w AS market, last_value(news IGNORE NULLS) OVER w AS news FROM g LEFT JOIN f USING (k, b) WINDOW w AS (PARTITION BY g.k ORDER BY g.b ROWS UNBOUNDED PRECEDING))
SELECT k, {s("b")} AS bucket, market, news FROM h WHERE market IS NOT NULL OR news IS NOT NULL""")
def j3_fusion(spark, d):
    t = ticks(spark, d).withColumn("k", F.col("user_id") % 10)
    out = J.fuse({"market": t.where("symbol = 'click'"), "news": t.where("symbol = 'view'")}, 86400, ["k"], "ts", "event_id", "price")
    return out.select("k", stamp("bucket").alias("bucket"), "market", "news")


@query("""WITH a AS (SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) // 5 AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT p, CAST(m AS VARCHAR) AS period, n, c AS consensus, n - c AS surprise FROM a LEFT JOIN b USING (m)""")
def j4_consensus(spark, d):
    o = table(spark, d, "orders").withColumn("m", F.trunc("o_orderdate", "month"))
    a = o.groupBy(F.col("o_orderpriority").alias("p"), "m").agg(F.count("*").alias("n"))
    b = o.where("o_orderstatus = 'F'").groupBy("m").agg(F.expr("count(*) div 5").alias("consensus"))
    return J.with_consensus(a, b, ["m"]).select("p", F.col("m").cast("string").alias("period"), "n", "consensus", (F.col("n") - F.col("consensus")).alias("surprise"))


@query(f"""WITH p AS (SELECT event_type AS name, time_bucket(INTERVAL 3 HOUR, ts) AS b, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL), f AS (SELECT b FROM p GROUP BY b HAVING count(DISTINCT name) = (SELECT count(DISTINCT name) FROM p))
SELECT name, {s("b")} AS ts, v FROM p SEMI JOIN f USING (b)""")
def j5_common_times(spark, d):
    t = ticks(spark, d).groupBy(F.col("symbol").alias("name"), bucket("ts", 10800).alias("ts")).agg(F.max_by("price", F.struct("ts", "event_id")).alias("v"))
    return J.common_times(t, "name", "ts").select("name", stamp("ts").alias("ts"), "v")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j6_new_rows(spark, d):
    """Orders that are not stored among those of returned lines."""
    stored = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.new_rows(table(spark, d, "orders"), stored, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""WITH p AS (SELECT c_nationkey AS k, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS position FROM customer GROUP BY ALL), l AS (SELECT s_nationkey AS k, CAST(max(abs(s_acctbal)) AS DOUBLE) * 2 AS lim FROM supplier GROUP BY ALL)
SELECT k, position, lim, abs(position) - lim AS excess FROM p JOIN l USING (k) WHERE abs(position) > lim""")
def j7_limit_breaches(spark, d):
    p = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("position"))
    lim = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.max(F.abs("s_acctbal")) * 2).alias("lim"))
    return J.limit_breaches(p, lim, ["k"], "position", "lim")


@query(f"""WITH q AS (SELECT event_id AS ask, event_type AS symbol, ts - INTERVAL 1 HOUR AS ask_ts FROM events WHERE event_id % 7 = 0)
SELECT ask, {s("e.ts")} AS matched, e.value AS price FROM q ASOF LEFT JOIN events e ON q.symbol = e.event_type AND q.ask_ts >= e.ts""")
def j8_snapshot_before(spark, d):
    t = ticks(spark, d)
    asks = t.where("event_id % 7 = 0").select("symbol", F.col("event_id").alias("ask"), F.expr("ts - interval 1 hour").alias("ask_ts"))
    return J.snapshot_before(t, asks, ["symbol"], "ts", "ask_ts", ["price"]).select("ask", stamp("ts_matched").alias("matched"), "price")


@query("""WITH a AS (SELECT user_id AS k, round(sum(value), 4) AS v FROM events WHERE event_id % 10 <> 1 GROUP BY ALL), b AS (SELECT user_id AS k, round(sum(value), 4) AS v FROM events WHERE event_id % 10 <> 2 GROUP BY ALL)
SELECT k, a.v AS offline, b.v AS online, CASE WHEN b.v IS NULL THEN 'inserted' WHEN a.v IS NULL THEN 'dropped' WHEN abs(a.v - b.v) > 0.5 THEN 'drifted' ELSE 'equal' END AS status FROM a FULL JOIN b USING (k)""")
def j9_feature_parity(spark, d):
    e = table(spark, d, "events")
    f = lambda r: e.where(f"event_id % 10 <> {r}").groupBy(F.col("user_id").alias("k")).agg(F.round(F.sum("value"), 4).alias("v"))
    return J.parity(f(1), f(2), ["k"], "v", 0.5)


@query("""WITH p AS (SELECT event_type AS asset, time_bucket(INTERVAL 6 HOUR, ts) AS b, avg(value) AS v FROM events GROUP BY ALL)
SELECT x.asset AS a, y.asset AS b, round(corr(x.v, y.v), 6) AS corr, count(*) AS n FROM p x JOIN p y ON x.b = y.b AND x.asset < y.asset GROUP BY ALL""")
def j10_pairwise_correlation(spark, d):
    return J.pairwise_correlation(panel(spark, d), "asset", "ts", "v").withColumn("corr", F.round("corr", 6))


def panel(spark, d, seconds: int = 21600):
    """(asset, ts, v): mean price of each symbol in each bucket."""
    return ticks(spark, d).groupBy(F.col("symbol").alias("asset"), bucket("ts", seconds).alias("ts")).agg(F.avg("price").alias("v"))


@query("""SELECT c_custkey, s_suppkey FROM customer, supplier WHERE abs(c_acctbal - s_acctbal) <= 25""")
def j11_within_tolerance(spark, d):
    c, s_ = table(spark, d, "customer"), table(spark, d, "supplier")
    return J.within_tolerance(c.select("c_custkey", "c_acctbal"), s_.select("s_suppkey", "s_acctbal"), "c_acctbal", "s_acctbal", 25.0).select("c_custkey", "s_suppkey")


@query("""WITH e AS (SELECT event_id, value AS p, list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS path FROM events),
h AS (SELECT *, list_filter(list_transform(path, lambda x: CASE WHEN x >= p * (1 + 300 * 1e-4) THEN 1 WHEN x <= p * (1 - 200 * 1e-4) THEN -1 ELSE 0 END), lambda x: x <> 0) AS hit FROM e)
SELECT event_id, CAST(CASE WHEN len(hit) > 0 THEN hit[1] ELSE sign(path[-1] - p) END AS INT) AS label FROM h""")
def j12_triple_barrier(spark, d):
    return J.triple_barrier(ticks(spark, d), ["symbol"], ["ts", "event_id"], "price", 300.0, 200.0, 12).select("event_id", "label")


EDGES = "e AS (SELECT DISTINCT user_id AS src, event_id % 50 AS dst FROM events)"


def edges(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 50).alias("dst")).distinct()


@query(f"""WITH {EDGES}, o AS (SELECT src AS node, count(*) AS r FROM e GROUP BY src), b AS (SELECT dst AS node, count(*) AS k FROM e GROUP BY dst)
SELECT node, coalesce(r, 0) AS "references", coalesce(k, 0) AS backlinks, round(1 + 0.03 * least(coalesce(r, 0) + coalesce(k, 0), 10), 6) AS authority FROM o FULL JOIN b USING (node)""")
def j13_reference_degrees(spark, d):
    return J.reference_degrees(edges(spark, d)).withColumn("authority", F.round("authority", 6))


@query(f"""WITH {EDGES} SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e)""")
def j13_orphans(spark, d):
    """Registered customers that no event refers to."""
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return J.orphans(nodes, edges(spark, d), "node")


@query("SELECT s_suppkey AS id, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def u1_union_by_name(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return U.union_frames([a, b])


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def u2_keep_last(spark, d):
    return U.keep_last(table(spark, d, "events").drop("props"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash, count(*) AS copies FROM documents WHERE text IS NOT NULL AND n_chars + doc_id > 500 GROUP BY sha256(text)")
def u3_content_dedup(spark, d):
    docs = table(spark, d, "documents").withColumn("ttl", F.col("n_chars"))
    return U.content_dedup(U.unexpired(docs, "doc_id", "ttl", 500), "doc_id", "text")


@query("""WITH old AS (SELECT doc_id AS doc, doc_id * 10 + lang_n AS seg, n_chars AS v FROM (SELECT *, length(lang) AS lang_n FROM documents)), new AS (SELECT doc_id AS doc, doc_id * 10 + 3 AS seg, n_chars * 2 AS v FROM documents WHERE doc_id % 4 = 0)
SELECT seg, doc, v FROM old WHERE doc NOT IN (SELECT doc FROM new) UNION ALL SELECT seg, doc, v FROM new""")
def u4_segment_maintenance(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select((F.col("doc_id") * 10 + F.length("lang")).alias("seg"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("v"))
    new = docs.where("doc_id % 4 = 0").select((F.col("doc_id") * 10 + 3).alias("seg"), F.col("doc_id").alias("doc"), (F.col("n_chars") * 2).alias("v"))
    return U.replace_segments(old, new, "doc")


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{3,5}')) AS id FROM documents), r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{3,5}')) AS id FROM benchmark)
SELECT id, 'unregistered' AS status FROM t ANTI JOIN r USING (id) UNION ALL SELECT id, 'unmentioned' FROM r ANTI JOIN t USING (id)""")
def u5_mentions(spark, d):
    ids = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,5}"), 0)).alias("id"))
    return U.mentions(table(spark, d, "documents"), "text", ids, "id", "[A-Z][a-z]{3,5}")
