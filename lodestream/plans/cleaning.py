"""Queries on cleaning, scaling, quality and predicates (F rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import clean as C

from .registry import query, table, ticks
from .timing import s, stamp

HOLES = "SELECT DISTINCT event_type AS symbol, ts, event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS price FROM events"


@query(f"""WITH e AS ({HOLES}), j AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS i FROM e),
k AS (SELECT *, last_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER up AS ai, last_value(price IGNORE NULLS) OVER up AS av, first_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER dn AS bi, first_value(price IGNORE NULLS) OVER dn AS bv
 FROM j WINDOW up AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING), dn AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN price IS NOT NULL THEN price WHEN ai IS NULL THEN bv WHEN bi IS NULL THEN av ELSE av + (bv - av) * (i - ai) / (bi - ai) END, 6) AS price FROM k""")
def f1_clean_frame(spark, d):
    t = ticks(spark, d).withColumn("price", F.when(F.col("event_id") % 5 != 0, F.col("price"))).drop("user_id")
    return C.clean_frame(t.union(t), ["symbol"], ["ts", "event_id"], ["price"]).select("event_id", F.round("price", 6).alias("price"))


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value FROM events")
def f2_scale_column(spark, d):
    return C.scale(table(spark, d, "events").select("event_id", "value"), ["value"]).withColumn("value", F.round("value", 6))


@query("""SELECT c_custkey, c_nationkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def f3_scale_all(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return C.scale(c, C.numeric_columns(c, ["c_custkey", "c_nationkey"]), "minmax").withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("""SELECT p_partkey, round(-1 + (p_retailprice - lo) / (hi - lo) * 2, 6) AS p_retailprice FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""")
def f4_indicator_range(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return C.scale(p, ["p_retailprice"], "indicator", -1.0, 1.0).withColumn("p_retailprice", F.round("p_retailprice", 6))


@query(f"SELECT event_type AS symbol, {s('h')} AS ts, arg_max(value, event_id) AS price FROM (SELECT *, date_trunc('hour', ts) AS h FROM events) GROUP BY ALL")
def f5_last_per_time(spark, d):
    t = ticks(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))
    return C.last_per_time(t, ["symbol"], "ts", "event_id").select("symbol", stamp("ts").alias("ts"), "price")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, value FROM events WHERE event_id % 7 <> 0 AND json_extract(props, '$.k') IS NOT NULL")
def f6_coerce(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.get_json_object("props", "$.k")).alias("k"), F.col("value").cast("string").alias("value"), F.lit(None).cast("string").alias("empty"))
    return C.coerce(e, ["k", "value"])


GATED = """g AS (SELECT event_id, value, row_number() OVER (PARTITION BY event_type, h ORDER BY event_id) > 1 AS dup, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, count(value) OVER w AS n
FROM (SELECT *, date_trunc('minute', ts) AS h FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY h, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
r AS (SELECT event_id, dup, n >= 8 AND abs(value - m) / nullif(sd, 0) > 3 AS spike, value < 1 OR value > 150 AS rng FROM g)"""


def gated(spark, d):
    t = ticks(spark, d).withColumn("ts", F.date_trunc("minute", "ts"))
    return C.quality_gate(t, ["symbol"], "ts", "event_id", "price", 8, 3.0, 1.0, 150.0)


@query(f"WITH {GATED} SELECT event_id, concat_ws(',', CASE WHEN dup THEN 'duplicate' END, CASE WHEN spike THEN 'spike' END, CASE WHEN rng THEN 'range' END) AS reasons FROM r WHERE dup OR spike OR rng")
def f7_quality_gate(spark, d):
    return gated(spark, d).where(F.size("reasons") > 0).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {GATED} SELECT count(*) AS total, count(*) FILTER (dup OR spike OR rng) AS quarantined, count(*) FILTER (dup) AS duplicate, count(*) FILTER (spike) AS spike, count(*) FILTER (rng) AS range,
round(count(*) FILTER (dup OR spike OR rng) / count(*), 6) AS ratio, count(*) FILTER (dup OR spike OR rng) / count(*) <= 0.1 AS ok FROM r""")
def f8_quality_summary(spark, d):
    return C.quality_summary(gated(spark, d), 0.1).withColumn("ratio", F.round("ratio", 6))


def _profile_sql(t: str, cols: list[str]) -> str:
    long = " UNION ALL ".join(f'SELECT \'{c}\' AS "column", CAST({c} AS DOUBLE) AS v FROM {t}' for c in cols)
    return f"""WITH l AS ({long}), f AS (SELECT "column", v, count(*) AS c FROM l WHERE v IS NOT NULL GROUP BY ALL), m AS (SELECT "column", v AS mode, c AS mode_n FROM f QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY c DESC, v) = 1)
SELECT "column", count(v) AS n, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS q2, round(quantile_cont(v, 0.75), 4) AS q3, any_value(mode) AS mode, any_value(mode_n) AS mode_n
FROM l LEFT JOIN m USING ("column") GROUP BY "column" """


@query(_profile_sql("part", ["p_size", "p_retailprice"]))
def f9_profile(spark, d):
    out = C.profile(table(spark, d, "part"), ["p_size", "p_retailprice"]).withColumnRenamed("distinct", "distinct_n")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "q1", "q2", "q3")})


@query("SELECT p_partkey, regexp_replace(regexp_replace(upper(trim(p_type)) || 'USD', '[\\s_:\\-/]+', '', 'g'), '^(.+)(USDT|USD|EUR)$', '\\1/\\2') AS symbol FROM part")
def f10_canonical_symbol(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", C.canonical_symbol(F.concat(F.lit(" "), "p_type", F.lit("-usd ")), ["USDT", "USD", "EUR"]).alias("symbol"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(28,8)) / 0.25, 0) * 0.25 AS DOUBLE) AS price, concat_ws(',', CASE WHEN l_quantity < 5 THEN 'small' END, CASE WHEN l_extendedprice > 50000 THEN 'large' END) AS issues FROM lineitem""")
def f11_round_to_step(spark, d):
    li = table(spark, d, "lineitem")
    rules = C.violations({"small": F.col("l_quantity") < 5, "large": F.col("l_extendedprice") > 50000})
    return li.select("l_orderkey", "l_linenumber", C.round_to_step(F.col("l_extendedprice"), 0.25).alias("price"), F.array_join(rules, ",").alias("issues"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'missing' END, CASE WHEN o_orderstatus = 'P' THEN 'restricted' END, CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'expired' END) AS issues FROM orders""")
def f12_license_screen(spark, d):
    o = table(spark, d, "orders")
    rules = C.violations({"missing": F.col("o_orderpriority") == "4-NOT SPECIFIED", "restricted": F.col("o_orderstatus") == "P", "expired": F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp")})
    return o.select("o_orderkey", F.array_join(rules, ",").alias("issues"))


def _redact_sql(c: str) -> str:
    for name, p in C.REDACTIONS.items():
        c = f"regexp_replace({c}, '{p}', '[{name}]', 'g')"
    return c


@query(f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")
def f13_redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", C.redact(F.col("text")).alias("text"))


@query("SELECT event_id, '***' AS secret_key, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def f14_redact_keys(spark, d):
    m = F.create_map(F.lit("api_key"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", C.redact_map(m, "(?i)(password|secret|token|_key)").alias("m")).select("event_id", F.col("m")["api_key"].alias("secret_key"), F.col("m")["k"].alias("k"))


@query("SELECT doc_id, left(sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 16) AS hash FROM documents")
def f15_text_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", C.text_hash(F.col("text")).alias("hash"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS hash FROM orders""")
def f16_json_fingerprint(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.canonical_json_hash(["o_orderstatus", "o_orderkey", "o_custkey"]).alias("hash"))


@query("""WITH g AS (SELECT user_id AS session, count(*) AS n, bool_and(value IS NOT NULL AND props IS NOT NULL) AS complete, CAST(epoch(max(ts)) - epoch(min(ts)) AS DOUBLE) AS span0, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS span FROM events GROUP BY ALL)
SELECT session, n, complete, span, n >= 20 AND complete AND span >= 900 AS ok FROM g""")
def f17_session_gates(spark, d):
    return C.session_gates(table(spark, d, "events").withColumnRenamed("user_id", "session"), "session", "ts", ["value", "props"])


@query("""WITH l AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, l_linenumber AS place, l_extendedprice AS price, l_quantity - 3 AS qty FROM lineitem),
b AS (SELECT *, lag(price) OVER (PARTITION BY l_orderkey, side ORDER BY place, price) AS p FROM l), i AS (SELECT l_orderkey, place, concat_ws(',', CASE WHEN price < 0 THEN 'negative' END, CASE WHEN qty <= 0 THEN 'empty' END, CASE WHEN CASE WHEN side = 'bid' THEN price > p ELSE price < p END THEN 'order' END) AS issues FROM b)
SELECT * FROM i WHERE issues <> ''""")
def f18_book_issues(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "bid").otherwise("ask").alias("side"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("p")).alias("at"), F.col("l_linenumber").alias("place"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") - 3).alias("qty"))
    return C.book_issues(li, "l_orderkey", "side", "at", "price", "qty").select("l_orderkey", "place", F.array_join("issues", ",").alias("issues"))


@query("""WITH x AS (SELECT doc_id, regexp_split_to_array(text, '\\.[ \\t\\n\\r\\f\\v]+') AS a FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, unnest(range(len(a))) AS nth, unnest(a) AS sentence FROM x),
z AS (SELECT doc_id, nth, CASE WHEN regexp_matches(lower(sentence), 'licensed|license') THEN 'license' WHEN regexp_matches(lower(sentence), 'stupid|idiot|trash') THEN 'abuse' END AS tier FROM y) SELECT doc_id, CAST(nth AS INT) AS nth, tier FROM z WHERE tier IS NOT NULL""")
def f19_claim_spans(spark, d):
    return C.claim_spans(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text", {"license": "licensed|license", "abuse": "stupid|idiot|trash"}).select("doc_id", "nth", "tier")
