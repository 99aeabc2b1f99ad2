"""Queries on aggregations (G rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions.scalars import ratio
from lodestream.operators import aggregates as A

from .registry import query, table, ticks
from .timing import s, stamp


def r(df, digits=6, **cols):
    """Round columns: those of a sum of many large numbers to fewer digits."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"} | {c: F.round(c, n) for c, n in cols.items()})


@query(f"""WITH e AS (SELECT event_type AS k, date_trunc('hour', ts) AS b, value, user_id FROM events), g AS (SELECT k, b, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, count(DISTINCT user_id) AS u FROM e GROUP BY ALL), h AS (SELECT k, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM g GROUP BY k)
SELECT k AS symbol, {s("b")} AS bucket, coalesce(n, 0) AS n, round(coalesce(m, 0), 6) AS mean, round(coalesce(sd, 0), 6) AS sd, coalesce(u, 0) AS sources FROM h LEFT JOIN g USING (k, b)""")
def g1_news_buckets(spark, d):
    return r(A.news_buckets(ticks(spark, d), ["symbol"], "ts", "price", "user_id", 3600)).withColumn("bucket", stamp("bucket"))


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT event_type) AS sources FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)")
def g2_latest_snapshot(spark, d):
    return r(A.latest_snapshot(ticks(spark, d), ["ts", "event_id"], "price", "symbol"))


@query(f"""WITH e AS (SELECT event_type AS symbol, date_trunc('day', ts) AS b, greatest(-5, least(5, value / 10 - 3)) AS sc, greatest(0, CAST(user_id AS DOUBLE) - 3) AS v, user_id FROM events),
g AS (SELECT symbol, b, sum(sc * v) AS sv, sum(v) AS v, avg(sc) AS m, count(DISTINCT user_id) AS sources FROM e GROUP BY ALL)
SELECT symbol, {s("b")} AS bucket, round(m, 6) AS mean, sources, round(CASE WHEN v > 0 THEN sv / v ELSE 0 END, 6) AS weighted, round(m - lag(m) OVER (PARTITION BY symbol ORDER BY b), 6) AS momentum FROM g""")
def g3_weighted_sentiment(spark, d):
    t = ticks(spark, d).withColumn("score", F.col("price") / 10 - 3).withColumn("vol", F.col("user_id").cast("double") - 3)
    return r(A.weighted_sentiment(t, ["symbol"], "ts", "score", "vol", "user_id", 86400)).withColumn("bucket", stamp("bucket"))


@query(f"""WITH g AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) AS b, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'view') AS "view" FROM events GROUP BY ALL), h AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 2 HOUR)) AS b FROM g),
f AS (SELECT b, last_value(click IGNORE NULLS) OVER w AS click, last_value("view" IGNORE NULLS) OVER w AS "view" FROM h LEFT JOIN g USING (b) WINDOW w AS (ORDER BY b ROWS UNBOUNDED PRECEDING))
SELECT {s("b")} AS bucket, round(click, 6) AS click, round("view", 6) AS "view", round(click - lag(click) OVER (ORDER BY b), 6) AS click_change, round("view" - lag("view") OVER (ORDER BY b), 6) AS view_change FROM f""")
def g4_pivot_metrics(spark, d):
    return r(A.pivot_metrics(ticks(spark, d), "ts", "symbol", "price", ["click", "view"], 7200)).withColumn("bucket", stamp("bucket"))


@query("""WITH f AS (SELECT l_orderkey, l_extendedprice / l_quantity AS p, l_quantity AS q, o_totalprice / 40 AS bench, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0),
g AS (SELECT l_orderkey, sum(p * q) / sum(q) AS vwap, sum(q) AS filled, any_value(bench) AS bench, any_value(side) AS side FROM f GROUP BY ALL)
SELECT l_orderkey, round(vwap + 1e-8, 6) AS vwap, filled, round(CASE WHEN side = 'sell' THEN -1 ELSE 1 END * (vwap - bench) + 1e-8, 6) AS slippage, round(CASE WHEN side = 'sell' THEN -1 ELSE 1 END * (vwap - bench) * filled + 1e-8, 6) AS shortfall, round(least(1, filled / 100), 6) AS fill_rate FROM g""")
def g5_execution_quality(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 40).alias("bench"), F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), F.lit(100.0).alias("target"))
    f = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_quantity").alias("q")).join(o, "l_orderkey")
    out = A.execution_quality(f, "l_orderkey", "p", "q", "bench", "side", "target")
    # the same small shift here and in the SQL: exact halves round alike whatever the order of sums was
    return r(out.withColumns({c: F.col(c) + 1e-8 for c in ("vwap", "slippage", "shortfall")}), 6)


@query("SELECT event_type AS symbol, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS worst FROM events GROUP BY ALL")
def g6_latency_summary(spark, d):
    return r(A.latency_summary(ticks(spark, d), ["symbol"], "price")).withColumn("worst", F.col("worst"))


@query("""SELECT o_orderpriority AS p, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS breaches, count(*) FILTER (o_orderstatus = 'P') AS flagged, count(*) FILTER (o_totalprice > 200000) = 0 AS healthy FROM orders GROUP BY ALL""")
def g7_compliance(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("breaches"), F.count_if(F.col("o_orderstatus") == "P").alias("flagged"))
    return g.withColumn("healthy", F.col("breaches") == 0)


@query("""SELECT event_type AS symbol, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END), 3) AS buy, round(sum(CASE WHEN event_id % 2 = 1 THEN value ELSE 0 END), 3) AS sell, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) / sum(value), 6) AS imbalance FROM events GROUP BY ALL""")
def g8_imbalance(spark, d):
    even = F.col("event_id") % 2 == 0
    return r(A.imbalance(ticks(spark, d), ["symbol"], F.when(even, F.col("price")).otherwise(0.0), F.when(~even, F.col("price")).otherwise(0.0)), 6, buy=3, sell=3)


@query("SELECT event_id, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS delta FROM events")
def g8_cumulative_delta(spark, d):
    p = F.when(F.col("event_id") % 2 == 0, F.col("price")).otherwise(-F.col("price"))
    return r(A.cumulative_delta(ticks(spark, d), ["symbol"], ["ts", "event_id"], p), 4).select("event_id", "delta")


@query("""WITH x AS (SELECT lang, toxic, CAST(n_chars > 1500 AS INT) AS p FROM labels JOIN documents USING (doc_id)), g AS (SELECT lang, avg(p) AS rate, avg(p) FILTER (toxic = 1) AS tpr FROM x GROUP BY lang)
SELECT round(max(rate) - min(rate), 6) AS parity_gap, round(max(tpr) - min(tpr), 6) AS opportunity_gap FROM g""")
def g9_fairness(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("p")), "doc_id")
    return r(A.fairness(x, "lang", "p", "toxic"))


@query("""WITH x AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), g AS (SELECT l_returnflag, avg(abs(y - p)) AS mae, avg((y - p) ** 2) AS mse, avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) AS mape,
avg(CASE WHEN abs(y) + abs(p) > 0 THEN 2 * abs(y - p) / (abs(y) + abs(p)) ELSE 0 END) AS smape, var_pop(y) AS v FROM x GROUP BY ALL)
SELECT l_returnflag, round(mae, 3) AS mae, round(mse, 0) AS mse, round(sqrt(mse), 3) AS rmse, round(mape, 6) AS mape, round(smape, 6) AS smape, round(1 - mse / v, 6) AS r2 FROM g""")
def g10_regression_errors(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return r(A.regression_errors(x, ["l_returnflag"], "y", "p"), 6, mae=3, mse=0, rmse=3)


RETURNS = "SELECT event_type AS symbol, ts, event_id, value / lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS ret FROM events"


def returns(spark, d):
    from pyspark.sql import Window

    t = ticks(spark, d)
    before = F.lag("price").over(Window.partitionBy("symbol").orderBy("ts", "event_id"))
    return t.withColumn("_before", before).withColumn("ret", ratio(F.col("price"), F.col("_before")) - 1).drop("_before").where("ret IS NOT NULL")


@query(f"""WITH x AS (SELECT * FROM ({RETURNS}) WHERE ret IS NOT NULL), q AS (SELECT symbol, quantile_cont(ret, 1 - 0.95) AS q FROM x GROUP BY ALL)
SELECT symbol, round(-any_value(q), 6) AS var, round(-avg(ret), 6) AS es FROM x JOIN q USING (symbol) WHERE ret <= q GROUP BY symbol""")
def g11_tail_risk(spark, d):
    return r(A.tail_risk(returns(spark, d), ["symbol"], "ret", 0.95))


@query(f"""WITH x AS (SELECT *, least(1, greatest(-1, ret)) AS x FROM ({RETURNS}) WHERE ret IS NOT NULL), c AS (SELECT *, sum(x) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM x),
t AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS top FROM c)
SELECT symbol, round(max(top - c), 6) AS drawdown, count(x) AS n, round(avg(x) / stddev_samp(x), 6) AS sharpe, round((abs(avg(x) / stddev_samp(x)) * sqrt(252) - (sqrt(2 * ln(50)) - (ln(ln(50)) + ln(4 * pi())) / (2 * sqrt(2 * ln(50))))) * sqrt((count(x) - 1) / (count(x) - 2)), 5) AS deflated FROM t GROUP BY symbol""")
def g12_sharpe_drawdown(spark, d):
    x = returns(spark, d).withColumn("x", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("ret"))))
    return r(A.sharpe_drawdown(x, ["symbol"], ["ts", "event_id"], "x"), deflated=5)


@query("SELECT c_custkey, round(greatest(-0.5, least(0.5, coalesce((c_acctbal / 10000) / nullif(abs(c_nationkey - 3.0), 0), 0) * 0.5)) + 1e-11, 9) AS size FROM customer")
def g13_kelly_size(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.round(A.kelly_size(F.col("c_acctbal") / 10000, F.abs(F.col("c_nationkey") - 3.0), F.lit(0.5), 0.5) + 1e-11, 9).alias("size"))


@query("""WITH x AS (SELECT c_nationkey AS p, c_acctbal AS e, 0.01 * (c_custkey % 7) AS v FROM customer), y AS (SELECT *, sum(abs(e)) OVER (PARTITION BY p) AS g FROM x)
SELECT p, round(sum(abs(e) * v), 3) AS risk, count(*) FILTER (abs(e) / nullif(g, 0) > 0.2) AS concentrated, round(sum(e), 2) AS net, round(sum(abs(e) * v) * 1.6448536269514722, 3) AS var, round(sum(abs(e) * v) * 3, 3) AS stress FROM y GROUP BY p""")
def g14_portfolio_risk(spark, d):
    x = table(spark, d, "customer").select(F.col("c_nationkey").alias("p"), F.col("c_acctbal").alias("e"), (F.lit(0.01) * (F.col("c_custkey") % 7)).alias("v"))
    return r(A.portfolio_risk(x, "p", "e", "v"), 3, net=2)


@query("""SELECT user_id, round(sum((value - 50) / 20 * (1 + event_id % 3)) / sum(1 + event_id % 3), 6) AS raw, round(greatest(-1, least(1, sum((value - 50) / 20 * (1 + event_id % 3)) / sum(1 + event_id % 3))), 6) AS strength FROM events GROUP BY ALL""")
def g15_signal_ensemble(spark, d):
    e = table(spark, d, "events").select("user_id", "value", F.lit(50.0).alias("m"), F.lit(20.0).alias("sd"), (1 + F.col("event_id") % 3).alias("w"))
    return r(A.signal_ensemble(e, ["user_id"], "value", "m", "sd", "w"))


@query("""WITH x AS (SELECT user_id, CASE WHEN value > 50 THEN 'bull' ELSE 'bear' END AS side, 0.1 + (event_id % 10) / 10 AS c, abs(value - 50) / 100 AS st FROM events),
g AS (SELECT user_id, sum(c) AS a, count(*) FILTER (side = 'bull') AS nb, sum(c) FILTER (side = 'bull') AS cb, avg(st) FILTER (side = 'bull') AS sb, count(*) FILTER (side = 'bear') AS nr, sum(c) FILTER (side = 'bear') AS cr, avg(st) FILTER (side = 'bear') AS sr FROM x GROUP BY ALL),
v AS (SELECT user_id, CASE WHEN nb >= 3 AND coalesce(cb / a, 0) >= 0.3 THEN sb * coalesce(cb / a, 0) END AS vb, CASE WHEN nr >= 3 AND coalesce(cr / a, 0) >= 0.3 THEN sr * coalesce(cr / a, 0) END AS vr FROM g)
SELECT user_id, CASE WHEN vb IS NULL AND vr IS NULL THEN 'none' WHEN vr IS NULL OR vb >= vr THEN 'bull' ELSE 'bear' END AS side, round(CASE WHEN vb IS NULL AND vr IS NULL THEN 0 WHEN vr IS NULL OR vb >= vr THEN tanh(vb) ELSE -tanh(vr) END, 6) AS score FROM v""")
def g16_divergence_vote(spark, d):
    x = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") > 50, "bull").otherwise("bear").alias("side"), (0.1 + (F.col("event_id") % 10) / 10).alias("c"), (F.abs(F.col("value") - 50) / 100).alias("st"))
    return r(A.divergence_vote(x, ["user_id"], "side", "c", "st", 3, 0.3, order=["event_id"]))


@query("""WITH x AS (SELECT label, 1.0 + vec_id % 4 AS w, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) SELECT label, CAST(pos AS INT) AS pos, round(sum(CAST(x AS DOUBLE) * w) / sum(w), 6) AS value FROM x GROUP BY label, pos""")
def g17_combine_vectors(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"), (1.0 + F.col("vec_id") % 4).alias("w"))
    return r(A.combine_vectors(e, ["label"], "v", "w"))


@query("""WITH x AS (SELECT user_id AS session, event_type AS phase, value AS l, event_id % 3 > 0 AS c, abs(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS j FROM events)
SELECT session, phase, count(*) AS n, round(avg(CAST(c AS INT)), 9) AS accuracy, round(avg(l), 9) AS mean, round(quantile_cont(l, 0.5), 9) AS median, round(stddev_samp(l) / avg(l), 9) AS cv, round(avg(j), 9) AS jitter FROM x GROUP BY ROLLUP (session, phase) HAVING session IS NOT NULL""")
def g18_phase_statistics(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("phase"), "ts", "event_id", F.col("value").alias("l"), (F.col("event_id") % 3 > 0).alias("c"))
    return r(A.phase_statistics(x, "session", "phase", ["ts", "event_id"], "l", "c"), 9)


@query("SELECT count(g) AS n, round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS sd, round(min(g), 6) AS lo, round(max(g), 6) AS hi, round(avg(CAST(abs(g - 1) <= 0.15 AS INT)), 6) AS near FROM (SELECT user_id, avg(value) / 50 AS g FROM events GROUP BY user_id)")
def g19_sessions_summary(spark, d):
    return r(A.summary(table(spark, d, "events").groupBy("user_id").agg((F.avg("value") / 50).alias("g")), "g"))


@query("""WITH x AS (SELECT l_returnflag AS f, l_linestatus AS g, l_discount - 0.05 AS e, l_tax * 20 AS low FROM lineitem), y AS (SELECT 'all' AS factor, '' AS level, e, low FROM x UNION ALL SELECT 'f', f, e, low FROM x UNION ALL SELECT 'g', g, e, low FROM x)
SELECT factor, level, count(*) AS cells, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.05), 6) AS p05, round(quantile_cont(e, 0.95), 6) AS p95, round(avg(CAST(e > 0 AS INT)), 6) AS positive, round(avg(CAST(low > 1 AS INT)), 6) AS above_one FROM y GROUP BY ALL""")
def g20_multiverse(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("g"), (F.col("l_discount") - 0.05).alias("e"), (F.col("l_tax") * 20).alias("low"))
    return r(A.multiverse(x, ["f", "g"], "e", "low"))


@query("""SELECT feature, min(v) AS lo, max(v) AS hi, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd FROM (SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY feature""")
def g21_feature_statistics(spark, d):
    return A.feature_statistics(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]).withColumns({c: F.round(c, 4) for c in ("mean", "sd")})


@query("""SELECT event_type AS symbol, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS worst, quantile_cont(value, 0.5) <= 60 AND quantile_cont(value, 0.95) <= 150 AND max(value) <= 500 AS passed FROM events GROUP BY ALL""")
def g22_release_gate(spark, d):
    g = A.latency_summary(ticks(spark, d), ["symbol"], "price").withColumn("passed", (F.col("p50") <= 60) & (F.col("p95") <= 150) & (F.col("worst") <= 500))
    return r(g.select("symbol", "p50", "p95", "worst", "passed"))


@query("""WITH x AS (SELECT CAST(l_linenumber AS DOUBLE) AS a, 1.0 + floor(l_quantity / 10) AS b FROM lineitem), m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM x WHERE a BETWEEN 1 AND 6 AND b BETWEEN 1 AND 6)
SELECT count(*) AS n, round(1 - avg((a - b) ** 2) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)), 6) AS kappa FROM x WHERE a BETWEEN 1 AND 6 AND b BETWEEN 1 AND 6""")
def g23_quadratic_kappa(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("a"), (1 + F.floor(F.col("l_quantity") / 10)).alias("b"))
    return r(A.quadratic_kappa(x, "a", "b", 1, 6))


@query("""WITH u AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, round(avg(CAST(n > 30 OR n > 1 AS INT)), 6) AS reuse, round(avg(CAST(l_suppkey % 10 = l_partkey % 10 AS INT)), 6) AS overlap, round(avg(CAST(nullif(l_returnflag, 'R') IS NULL AS INT)), 6) AS gap FROM lineitem JOIN u USING (l_partkey) GROUP BY l_orderkey""")
def g24_gaming_signals(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_suppkey") % 10).alias("a"), (F.col("l_partkey") % 10).alias("b"), F.nullif("l_returnflag", F.lit("R")).alias("src"))
    return r(A.gaming_signals(x, "l_orderkey", "l_partkey", "a", "b", "src"))


@query(f"""SELECT user_id, {s("b")} AS bucket, count(DISTINCT event_type) AS channels, CASE WHEN count(DISTINCT event_type) >= 3 THEN 'real' ELSE 'quarantine' END AS verdict FROM (SELECT *, time_bucket(INTERVAL 12 HOUR, ts) AS b FROM events WHERE value > 40) GROUP BY user_id, b""")
def g25_corroboration(spark, d):
    return A.corroborated(table(spark, d, "events"), ["user_id"], "ts", 43200, "event_type", F.col("value") > 40, 3).withColumn("bucket", stamp("bucket"))


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id % 5 = 1 AND value > 0")
def g26_evidence_query(spark, d):
    return table(spark, d, "events").where("event_type = 'click' AND user_id % 5 = 1 AND value > 0").select("event_id", "value")


@query("""WITH f AS (SELECT l_suppkey AS k, l_partkey % 10 AS sym, l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS p, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END AS q, 0.001 * l_extendedprice AS fee FROM lineitem),
b AS (SELECT k, sym, sum(q) AS net, arg_max(p, (l_shipdate, l_orderkey, l_linenumber, p)) AS last_p, sum(-q * p) AS cash, sum(fee) AS fees FROM f GROUP BY ALL)
SELECT k, round(sum(cash) - sum(fees), 1) AS cash, round(sum(fees), 2) AS fees, round(sum(net * last_p), 1) AS net, round(sum(abs(net * last_p)), 1) AS gross, round(sum(cash) - sum(fees) + sum(net * last_p), 1) AS equity FROM b GROUP BY k""")
def g27_accounts(spark, d):
    f = table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("sym", F.col("l_partkey") % 10).withColumnRenamed("l_suppkey", "k")
    q = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return r(A.accounts(f, "k", "sym", ["l_shipdate", "l_orderkey", "l_linenumber", "p"], "p", q, 0.001 * F.col("l_extendedprice")), 1, fees=2)


@query("""WITH x AS (SELECT l_orderkey AS claim, CASE l_returnflag WHEN 'A' THEN 'measured' WHEN 'N' THEN 'derived' ELSE 'reported' END AS tier, l_discount AS rel FROM lineitem)
SELECT claim, round(avg(CASE tier WHEN 'measured' THEN 1.0 WHEN 'derived' THEN 0.6 ELSE 0.2 END * rel), 6) AS precision, count(*) FILTER (tier = 'measured') AS n_measured, count(*) FILTER (tier = 'derived') AS n_derived, count(*) FILTER (tier = 'reported') AS n_reported FROM x GROUP BY claim""")
def g28_evidence_precision(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim"), F.when(F.col("l_returnflag") == "A", "measured").when(F.col("l_returnflag") == "N", "derived").otherwise("reported").alias("tier"), F.col("l_discount").alias("rel"))
    return r(A.evidence_precision(x, "claim", "tier", "rel"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY ALL")
def g29_fitted_line(spark, d):
    return r(A.fitted_line(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 6, slope=3, intercept=3)


@query("""WITH e AS (SELECT s_nationkey AS t, abs(s_acctbal) / 10000 AS st, s_suppkey % 3 > 0 AS ok FROM supplier) SELECT t, round(coalesce(sum(st) FILTER (ok AND st >= 0.2), 0), 6) AS drive, round(greatest(0, least(1, 1 - 0.3 * coalesce(sum(st) FILTER (ok AND st >= 0.2), 0))), 6) AS gate FROM e GROUP BY t""")
def g30_causal_gate(spark, d):
    e = table(spark, d, "supplier").select(F.col("s_nationkey").alias("t"), (F.abs("s_acctbal") / 10000).alias("st"), (F.col("s_suppkey") % 3 > 0).alias("ok"))
    return r(A.causal_gate(e, "t", "st", F.col("ok"), 0.2, 0.3))
