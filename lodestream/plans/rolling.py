"""Queries on windows and recurrences (W rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.operators import folds as O
from lodestream.operators import windows as W

from .joining import panel
from .registry import query, table, ticks
from .summing import RETURNS, r, returns
from .timing import HOURS, hours, s, stamp

T = "(SELECT event_type AS symbol, ts, event_id, user_id, value AS price FROM events)"
ORDER = "PARTITION BY symbol ORDER BY ts, event_id"


def w_():
    return W.series(["symbol"], ["ts", "event_id"])


@query(f"""SELECT event_id, round(CASE WHEN count(price) OVER f >= 4 AND stddev_pop(price) OVER f > 0 THEN (price - avg(price) OVER f) / stddev_pop(price) OVER f END, 5) AS z FROM {T} WINDOW f AS ({ORDER} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def w1_rolling_z(spark, d):
    return ticks(spark, d).select("event_id", F.round(W.rolling_z("price", w_(), 12), 5).alias("z"))


@query("""WITH m AS (SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS v FROM orders GROUP BY ALL)
SELECT p, CAST(m AS VARCHAR) AS month, round(v / lag(v) OVER w - 1, 6) AS mom, round(v / lag(v, 12) OVER w - 1, 6) AS yoy, m - lag(m) OVER w AS gap_days FROM m WINDOW w AS (PARTITION BY p ORDER BY m)""")
def w2_changes(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.trunc("o_orderdate", "month").alias("m")).agg(F.count("*").alias("v"))
    w = W.series(["p"], ["m"])
    return m.select("p", F.col("m").cast("string").alias("month"), F.round(W.change("v", w), 6).alias("mom"), F.round(W.change("v", w, 12), 6).alias("yoy"), F.datediff("m", F.lag("m").over(w)).cast("long").alias("gap_days"))


@query(f"""SELECT event_id, round(avg(price) OVER ({ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5, round(price - lag(price, 2) OVER ({ORDER}), 6) AS diff2, round(price / nullif(lag(price, 3) OVER ({ORDER}), 0) - 1, 6) AS pct3 FROM {T}""")
def w3_transforms(spark, d):
    x = W.transforms(ticks(spark, d), w_(), [("price", "rolling_mean", 5), ("price", "diff", 2), ("price", "pct_change", 3)])
    return r(x.select("event_id", F.col("price_rolling_mean_5").alias("mean5"), F.col("price_diff_2").alias("diff2"), F.col("price_pct_change_3").alias("pct3")))


@query(f"""WITH p AS (SELECT event_type AS a, time_bucket(INTERVAL 6 HOUR, ts) AS b, avg(value) AS v FROM events GROUP BY ALL), q AS (SELECT b, stddev_samp(v) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS sd FROM p)
SELECT {s("b")} AS ts, round(avg(sd), 6) AS vol FROM q GROUP BY b""")
def w4_rolling_volatility(spark, d):
    p = panel(spark, d).withColumn("sd", F.stddev_samp("v").over(Window.partitionBy("asset").orderBy("ts").rowsBetween(-5, 0)))
    return p.groupBy("ts").agg(F.round(F.avg("sd"), 6).alias("vol")).withColumn("ts", stamp("ts"))


@query(f"SELECT event_id, array_to_string(list(user_id) OVER ({ORDER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ',') AS buffer FROM {T}")
def w5_last_values(spark, d):
    return ticks(spark, d).select("event_id", F.array_join(W.last_values("user_id", w_(), 4).cast("array<string>"), ",").alias("buffer"))


@query(f"""WITH a AS (SELECT *, price * 0.4 AS bid, CAST(1 + user_id AS DOUBLE) AS ask FROM {T}), b AS (SELECT *, coalesce(sign(price - lag(price) OVER o) * (bid + ask), 0) AS flow, coalesce(price - lag(price) OVER o, 0) AS dp FROM a WINDOW o AS ({ORDER}))
SELECT event_id, round((bid - ask) / nullif(bid + ask, 0), 6) AS imbalance, round(sum(flow) OVER f, 4) AS ofi, round(2 * abs(price - avg(price) OVER f), 4) AS effective, round(2 * abs(lead(price, 10) OVER ({ORDER}) - price), 4) AS realised,
round(sum(dp * flow) OVER f / nullif(sum(flow * flow) OVER f, 0), 5) AS kyle, round(price - sum(price * (bid + ask)) OVER f / nullif(sum(bid + ask) OVER f, 0), 4) AS to_vwap FROM b WINDOW f AS ({ORDER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def w6_microstructure(spark, d):
    x = ticks(spark, d).withColumn("bid", F.col("price") * 0.4).withColumn("ask", (1 + F.col("user_id")).cast("double"))
    x = W.microstructure(x, w_(), "price", "bid", "ask", 10)
    return r(x.select("event_id", "imbalance", "ofi", "effective", "realised", "kyle", "to_vwap"), 4, imbalance=6, kyle=5)


_FD = W.fracdiff_weights(0.4, 1e-3)


@query(f"""SELECT event_id, round(list_sum(list_transform(list_zip(list_reverse(list(price) OVER ({ORDER} ROWS BETWEEN {len(_FD) - 1} PRECEDING AND CURRENT ROW)), {_FD}), lambda p: coalesce(p[1] * p[2], 0))), 5) AS fd FROM {T}""")
def w7_fracdiff(spark, d):
    return ticks(spark, d).select("event_id", F.round(W.fracdiff("price", w_(), 0.4, 1e-3), 5).alias("fd"))


@query(f"""WITH a AS (SELECT *, ln(price / lag(price) OVER ({ORDER})) AS r FROM {T}), b AS (SELECT *, sqrt(sum(r * r) OVER ({ORDER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS rv FROM a)
SELECT event_id, round(rv, 5) AS rv, round(stddev_samp(rv) OVER ({ORDER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 5) AS vov FROM b""")
def w8_realised_volatility(spark, d):
    return r(W.realised_volatility(ticks(spark, d), w_(), "price", 10).select("event_id", "rv", "vov"), 5)


@query(f"""SELECT event_id, round(avg(price) OVER ({ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(price) OVER ({ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1, 6) AS trend, round(price - lag(price, 10) OVER ({ORDER}), 6) AS momentum, round(stddev_samp(price) OVER ({ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 5) AS vol FROM {T}""")
def w9_regime_features(spark, d):
    w = w_()
    mean = lambda n: F.avg("price").over(w.rowsBetween(-n + 1, 0))
    return r(ticks(spark, d).select("event_id", (mean(5) / mean(20) - 1).alias("trend"), (F.col("price") - F.lag("price", 10).over(w)).alias("momentum"), F.stddev_samp("price").over(w.rowsBetween(-19, 0)).alias("vol")), 6, vol=5)


@query(f"""WITH a AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN price END AS x FROM {T}) SELECT event_id, last_value(CASE WHEN x < 30 THEN 'calm' WHEN x < 70 THEN 'normal' WHEN x IS NOT NULL THEN 'wild' END IGNORE NULLS) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS regime FROM a""")
def w10_volatility_regime(spark, d):
    x = ticks(spark, d).withColumn("x", F.when(F.col("event_id") % 4 != 0, F.col("price")))
    return x.select("event_id", W.volatility_regime("x", 30, 70, w_()).alias("regime"))


SYNC = """p AS (SELECT event_type AS a, time_bucket(INTERVAL 6 HOUR, ts) AS b, avg(value) AS v FROM events GROUP BY ALL), q AS (SELECT b, atan2(stddev_pop(v) OVER w, avg(v) OVER w) AS phase FROM p WINDOW w AS (PARTITION BY a ORDER BY b ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
g AS (SELECT b, sqrt(avg(cos(phase)) ** 2 + avg(sin(phase)) ** 2) AS r FROM q GROUP BY b)"""


@query(f"WITH {SYNC} SELECT {s('b')} AS ts, round(r, 6) AS r, round(r - lag(r, 3) OVER (ORDER BY b), 6) AS dr FROM g")
def w11_synchrony(spark, d):
    return r(W.synchrony(panel(spark, d), "asset", "ts", "v", 8)).withColumn("ts", stamp("ts"))


@query(f"""WITH a AS (SELECT event_id, price, quantile_cont(price, [0.25, 0.5, 0.75]) OVER ({ORDER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS q FROM {T}) SELECT event_id, CASE WHEN price > q[2] + (q[3] - q[1]) + 1e-9 THEN 'high' WHEN price < q[2] - (q[3] - q[1]) - 1e-9 THEN 'low' ELSE 'mid' END AS label FROM a""")
def w12_adaptive_labels(spark, d):
    return W.adaptive_labels(ticks(spark, d), w_(), "price", 30).select("event_id", "label")


@query(f"""WITH p AS (SELECT event_type AS a, time_bucket(INTERVAL 6 HOUR, ts) AS b, avg(value) AS v FROM events GROUP BY ALL), c AS (SELECT a, b, avg(v) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM p), x AS (SELECT a, b, c - lag(c) OVER (PARTITION BY a ORDER BY b) AS chg FROM c),
m AS (SELECT a, quantile_cont(abs(chg), 0.5) AS med FROM x WHERE chg IS NOT NULL GROUP BY a), y AS (SELECT b, chg, coalesce(abs(chg) / nullif(med, 0), 0) AS size FROM x JOIN m USING (a) WHERE chg IS NOT NULL),
g AS (SELECT b, count(*) FILTER (chg > 0) AS u, count(*) FILTER (chg < 0) AS d, count(*) AS n, coalesce(avg(size) FILTER (chg > 0), 0) AS su, coalesce(avg(size) FILTER (chg < 0), 0) AS sd FROM y GROUP BY b)
SELECT {s("b")} AS ts, round(greatest(u, d) / n, 6) AS support, round(CASE WHEN u >= d THEN su - sd ELSE sd - su END, 5) AS strength FROM g""")
def w13_convergence(spark, d):
    return r(W.convergence(panel(spark, d), "asset", "ts", "v", 3), 6, strength=5).withColumn("ts", stamp("ts"))


@query(f"""SELECT event_id, CASE WHEN avg(price) OVER ({ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > avg(price) OVER ({ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) THEN 1 ELSE -1 END AS crossing, CASE WHEN price > 60 THEN 1 WHEN price < 40 THEN -1 ELSE 0 END AS threshold FROM {T}""")
def w14_signals(spark, d):
    x = W.mean_by_runs(ticks(spark, d), w_(), "price", 20, "slow")
    x = x.withColumn("fast", F.avg("price").over(w_().rowsBetween(-4, 0)))
    return x.select("event_id", F.when(F.col("fast") > F.col("slow"), 1).otherwise(-1).alias("crossing"), F.when(F.col("price") > 60, 1).when(F.col("price") < 40, -1).otherwise(0).alias("threshold"))


@query(f"""SELECT event_id, CAST(sign(price - avg(price) OVER ({ORDER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS INT) AS momentum FROM {T}""")
def w15_momentum(spark, d):
    return ticks(spark, d).select("event_id", F.signum(F.col("price") - F.avg("price").over(w_().rowsBetween(-10, -1))).cast("int").alias("momentum"))


@query("""WITH RECURSIVE o AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i, CAST(l_extendedprice / l_quantity AS DOUBLE) AS p, CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DOUBLE) AS q FROM lineitem),
f AS (SELECT DISTINCT l_partkey, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS pnl FROM lineitem UNION ALL
SELECT o.l_partkey, o.i, pos + q, CASE WHEN pos * q >= 0 AND pos + q <> 0 THEN (cost * abs(pos) + p * abs(q)) / abs(pos + q) WHEN pos + q = 0 THEN 0 WHEN pos * (pos + q) < 0 THEN p ELSE cost END, pnl + CASE WHEN pos * q >= 0 THEN 0 ELSE least(abs(pos), abs(q)) * (p - cost) * sign(pos) END FROM f JOIN o ON o.l_partkey = f.l_partkey AND o.i = f.i + 1)
SELECT l_partkey, round(arg_max(pos, i), 4) AS pos, round(arg_max(cost, i), 4) AS cost, round(arg_max(pnl, i), 4) AS pnl FROM f GROUP BY l_partkey""")
def w16_average_cost(spark, d):
    li = table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return r(O.average_cost(li, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "p", q), 4)


@query(f"""WITH RECURSIVE m AS (SELECT symbol, user_id, avg(price) AS m, stddev_pop(price) AS s FROM {T} GROUP BY ALL), o AS (SELECT symbol, user_id, row_number() OVER (PARTITION BY symbol, user_id ORDER BY ts, event_id) AS i, coalesce((price - m) / nullif(s, 0), 0) AS z FROM {T} JOIN m USING (symbol, user_id)),
f AS (SELECT symbol, user_id, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS side FROM m UNION ALL
SELECT symbol, user_id, i, up, dn, CASE WHEN up > 3 THEN 1 WHEN dn > 3 THEN -1 ELSE 0 END FROM (SELECT o.symbol, o.user_id, o.i, greatest(0, CASE WHEN side = 0 THEN up ELSE 0 END + z - 0.25::DOUBLE) AS up, greatest(0, CASE WHEN side = 0 THEN dn ELSE 0 END - z - 0.25::DOUBLE) AS dn FROM f JOIN o ON o.symbol = f.symbol AND o.user_id = f.user_id AND o.i = f.i + 1))
SELECT symbol, user_id, CAST(i - 1 AS INT) AS at, side FROM f WHERE side <> 0""")
def w17_cusum(spark, d):
    return O.cusum(ticks(spark, d), ["symbol", "user_id"], ["ts", "event_id"], "price", 0.25, 3.0)


@query(f"""WITH x AS (SELECT *, row_number() OVER ({ORDER}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({RETURNS}) WHERE ret IS NOT NULL)
SELECT symbol, round(stddev_pop(ret) FILTER (i <= 50), 5) AS "first", round(stddev_pop(ret) FILTER (i > n - 50), 5) AS "last", round(stddev_pop(ret) FILTER (i > n - 50) / stddev_pop(ret) FILTER (i <= 50), 5) AS shock FROM x GROUP BY symbol""")
def w18_volatility_shock(spark, d):
    return r(W.volatility_shock(returns(spark, d), ["symbol"], ["ts", "event_id"], "ret", 50), 5)


STEPS = """c AS (SELECT event_type AS run, date_trunc('day', ts) AS b, user_id % 20 AS cell, avg(value) AS v FROM events GROUP BY ALL), x AS (SELECT run, b, abs(v - lag(v) OVER (PARTITION BY run, cell ORDER BY b)) AS d FROM c), g AS (SELECT run, b, avg(d) AS change FROM x WHERE d IS NOT NULL GROUP BY ALL)"""


def steps(spark, d):
    c = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.unix_date(F.to_date("ts")).alias("step"), (F.col("user_id") % 20).alias("cell")).agg(F.avg("value").alias("v"))
    return W.step_changes(c, "run", "step", ["cell"], "v")


@query(f"""WITH {STEPS}, m AS (SELECT run, quantile_cont(change, 0.5) AS med FROM g GROUP BY run), y AS (SELECT run, b, change, med, abs(change - med) AS dev FROM g JOIN m USING (run)), k AS (SELECT run, quantile_cont(dev, 0.5) AS mad FROM y GROUP BY run),
z AS (SELECT run, b, (change - med) / (1.4826 * mad + 1e-12) AS z FROM y JOIN k USING (run)) SELECT run, CAST(arg_max(CAST(b AS DATE) - DATE '1970-01-01', z) AS INT) AS at, round(max(z), 5) AS z, round(1 / (1 + exp(-(max(z) - 3))), 5) AS score FROM z GROUP BY run""")
def w19_change_point(spark, d):
    return r(W.change_point(steps(spark, d), "run", "step"), 5)


@query(f"""WITH a AS (SELECT event_type AS symbol, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INT) AS step, CAST(count(*) FILTER (value > 60) AS BIGINT) AS n FROM events GROUP BY ALL), x AS (SELECT *, CASE WHEN step - lag(step) OVER w > 1 THEN 1 ELSE 0 END AS new FROM a WHERE n > 2 WINDOW w AS (PARTITION BY symbol ORDER BY step)),
y AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY step ROWS UNBOUNDED PRECEDING) AS burst FROM x) SELECT symbol, min(step) AS start, max(step) - min(step) + 1 AS duration, CAST(sum(n) AS BIGINT) AS size FROM y GROUP BY symbol, burst""")
def w23_avalanches(spark, d):
    a = ticks(spark, d).groupBy("symbol", F.unix_date(F.to_date("ts")).alias("step")).agg(F.count_if(F.col("price") > 60).alias("n"))
    return W.avalanches(a.where("n > 2"), "symbol", "step", "n").select("symbol", "start", "duration", "size")


@query(f"""WITH h AS ({HOURS}), a AS (SELECT *, CASE WHEN close > open THEN 1.0 ELSE -1.0 END AS sig FROM h), p AS (SELECT *, coalesce(lag(sig) OVER w, 0) AS pos, coalesce(close - lag(close) OVER w, 0) AS dp FROM a WINDOW w AS (PARTITION BY symbol ORDER BY b)),
q AS (SELECT *, pos * dp - 0.01 * abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY b), 0)) AS pnl FROM p), e AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY b ROWS UNBOUNDED PRECEDING) AS equity FROM q)
SELECT symbol, {s("b")} AS bucket, pos, round(pnl, 5) AS pnl, round(equity, 4) AS equity, round(greatest(0, max(equity) OVER (PARTITION BY symbol ORDER BY b ROWS UNBOUNDED PRECEDING)) - equity, 4) AS drawdown FROM e""")
def w25_backtest(spark, d):
    x = W.backtest(hours(spark, d), ["symbol"], ["bucket"], "close", F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0), 0.01)
    return r(x.select("symbol", stamp("bucket").alias("bucket"), "pos", "pnl", "equity", "drawdown"), 4, pnl=5)


@query(f"""WITH {SYNC}, h AS (SELECT b, r, r - lag(r, 3) OVER (ORDER BY b) AS dr FROM g) SELECT {s("b")} AS ts, CASE WHEN r < 0.3 AND dr < 0 THEN 'KILL' WHEN r > 0.7 AND dr > 0 THEN 'EMERGENT' ELSE 'CAUTION' END AS decision FROM h""")
def w26_decision(spark, d):
    x = W.synchrony(panel(spark, d), "asset", "ts", "v", 8)
    return x.select(stamp("ts").alias("ts"), W.decision(F.col("r"), F.col("dr"), F.col("dr")).alias("decision"))


@query(f"""WITH h AS ({HOURS}), a AS (SELECT symbol, b, CASE WHEN close > 60 THEN 'high' WHEN close < 40 THEN 'low' ELSE 'mid' END AS phase FROM h), x AS (SELECT *, CASE WHEN phase <> lag(phase) OVER (PARTITION BY symbol ORDER BY b) THEN 1 ELSE 0 END AS new FROM a), y AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY b ROWS UNBOUNDED PRECEDING) AS part FROM x)
SELECT symbol, {s("min(b)")} AS start, any_value(phase) AS phase, count(*) AS length FROM y GROUP BY symbol, part""")
def w27_phase_log(spark, d):
    x = W.phase_log(hours(spark, d), ["symbol"], "bucket", F.when(F.col("close") > 60, "high").when(F.col("close") < 40, "low").otherwise("mid"))
    return x.select("symbol", stamp("start").alias("start"), "phase", "length")


@query(f"""WITH h AS ({HOURS}), a AS (SELECT symbol, b, close, CASE WHEN close > 60 THEN 'high' WHEN close < 40 THEN 'low' ELSE 'mid' END AS c, close - lag(close) OVER (PARTITION BY symbol ORDER BY b) AS d FROM h)
SELECT symbol, {s("b")} AS bucket, c AS class, abs(d) > 40 AS bifurcation FROM a WHERE d IS NOT NULL""")
def w28_trajectory(spark, d):
    x = hours(spark, d).withColumn("d", F.col("close") - F.lag("close").over(Window.partitionBy("symbol").orderBy("bucket"))).where("d IS NOT NULL")
    return x.select("symbol", stamp("bucket").alias("bucket"), F.when(F.col("close") > 60, "high").when(F.col("close") < 40, "low").otherwise("mid").alias("class"), (F.abs("d") > 40).alias("bifurcation"))


@query(f"""WITH a AS (SELECT symbol, abs(price - lag(price) OVER ({ORDER})) / greatest(abs(lag(price) OVER ({ORDER})), 1e-12) AS e FROM {T}) SELECT symbol, count(*) FILTER (e > 0.5) AS violations, round(avg(CAST(e > 0.5 AS INT)), 6) AS rate, round(max(e), 4) AS worst FROM a WHERE e IS NOT NULL GROUP BY symbol""")
def w29_conservation(spark, d):
    return r(W.conservation(ticks(spark, d), ["symbol"], ["ts", "event_id"], "price", 0.5), 6, worst=4)


def clamped(delta: str, start: float, low: float, high: float, decay: float) -> str:
    return f"""WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST({delta} AS DOUBLE) AS v FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST({start} AS DOUBLE) AS level FROM events UNION ALL SELECT o.user_id, o.i, greatest(CAST({low} AS DOUBLE), least(CAST({high} AS DOUBLE), level * CAST({decay} AS DOUBLE) + v)) FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, round(arg_max(level, i), 6) AS level FROM f GROUP BY user_id"""


@query(clamped("(value - 50) / 100", 0.0, -1.0, 1.0, 0.9))
def w30_clamped_valence(spark, d):
    return r(O.clamped(ticks(spark, d), ["user_id"], ["ts", "event_id"], (F.col("price") - 50) / 100, 0.0, -1.0, 1.0, 0.9))


@query("""WITH o AS (SELECT user_id, event_type AS symbol, value AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WHERE event_id % 5 > 0 WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
e AS (SELECT user_id, symbol, round(sum(CASE WHEN i = 1 THEN 1 ELSE 0.2::DOUBLE END * pow(0.8::DOUBLE, n - i) * v), 6) AS ewma FROM o GROUP BY user_id, symbol) SELECT user_id, symbol, ewma FROM (SELECT DISTINCT user_id, event_type AS symbol FROM events) LEFT JOIN e USING (user_id, symbol)""")
def w22_ewma(spark, d):
    return r(O.ewma(ticks(spark, d), ["user_id", "symbol"], ["ts", "event_id"], F.when(F.col("event_id") % 5 > 0, F.col("price")), 0.2))


@query("""WITH x AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS v FROM events), y AS (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM x) SELECT event_id, round(b, 4) AS balance, b < 0 AS rejected FROM y""")
def w31_balances(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, -F.col("value")).otherwise(F.col("value")))
    b = F.sum("v").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", F.round(b, 4).alias("balance"), (b < 0).alias("rejected"))


@query("""WITH RECURSIVE e AS (SELECT l_suppkey AS book, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, CAST(l_shipdate AS DATE) AS day, 1 AS nth, 'reserve' AS act, CAST(l_quantity AS DOUBLE) AS b, CAST(l_extendedprice AS DOUBLE) AS q FROM lineitem
UNION ALL SELECT l_suppkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey, CAST(l_shipdate AS DATE) + CAST(1 + l_orderkey % 30 AS INT), 0, CASE l_returnflag WHEN 'A' THEN 'commit' ELSE 'release' END, CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE) FROM lineitem WHERE l_returnflag <> 'N'),
o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY day, nth, id, act, b, q) AS i FROM e), f AS (SELECT DISTINCT book, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS id, '' AS status, 3000.0::DOUBLE AS hb, 0.0::DOUBLE AS rb, 5000000.0::DOUBLE AS hq, 0.0::DOUBLE AS rq, []::BIGINT[] AS open FROM e UNION ALL
SELECT book, i, id, CASE WHEN take THEN 'reserved' WHEN act = 'reserve' OR NOT has AND act = 'commit' THEN 'refused' WHEN NOT has THEN 'unknown' WHEN act = 'release' THEN 'released' ELSE 'committed' END, CASE WHEN has AND act = 'commit' THEN hb - b ELSE hb END, CASE WHEN take THEN rb + b WHEN has AND act <> 'reserve' THEN rb - b ELSE rb END,
CASE WHEN has AND act = 'commit' THEN hq - q ELSE hq END, CASE WHEN take THEN rq + q WHEN has AND act <> 'reserve' THEN rq - q ELSE rq END, CASE WHEN take THEN list_append(open, id) WHEN has AND act <> 'reserve' THEN list_filter(open, lambda x: x <> id) ELSE open END
FROM (SELECT o.book, o.i, o.id, act, b, q, hb, rb, hq, rq, open, list_contains(open, o.id) AS has, act = 'reserve' AND NOT list_contains(open, o.id) AND b <= hb - rb AND q <= hq - rq AS take FROM f JOIN o ON o.book = f.book AND o.i = f.i + 1))
SELECT book, id, status, round(hb, 2) AS base, round(rb, 2) + 0 AS base_reserved, round(hq, 2) AS quote, round(rq, 2) + 0 AS quote_reserved FROM f WHERE i > 0""")
def w31_reservations(spark, d):
    """A reservation a line, settled some days later by its id, or held."""
    q, flag = F.col("l_quantity").cast("double"), F.col("l_returnflag")
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("book"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("id"), F.to_date("l_shipdate").alias("day"), q.alias("b"), F.col("l_extendedprice").cast("double").alias("q"), flag.alias("flag"), (1 + F.col("l_orderkey") % 30).cast("int").alias("wait"))
    made = li.select("book", "id", "day", F.lit(1).alias("nth"), F.lit("reserve").alias("act"), "b", "q")
    ends = li.where("flag <> 'N'").select("book", "id", F.date_add("day", F.col("wait")).alias("day"), F.lit(0).alias("nth"), F.when(F.col("flag") == "A", "commit").otherwise("release").alias("act"), "b", "q")
    return r(O.reservation_log(made.union(ends), ["book"], ["day", "nth", "id"], "act", "id", "b", "q", 3000.0, 5_000_000.0).drop("day", "nth"), 2)


@query(f"""WITH RECURSIVE x AS (SELECT symbol, user_id, event_id, price / nullif(lag(price) OVER w, 0) - 1 AS ret, row_number() OVER w AS i FROM {T} WINDOW w AS (PARTITION BY symbol, user_id ORDER BY ts, event_id)), o AS (SELECT symbol, user_id, event_id, i, coalesce(greatest(-1, least(1, ret)), 0)::DOUBLE AS ret, (event_id % 10)::DOUBLE AS new FROM x),
f AS (SELECT DISTINCT symbol, user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS v, 0.0::DOUBLE AS rpe, 0.0::DOUBLE AS phasic, 0.0::DOUBLE AS tonic FROM o UNION ALL
SELECT symbol, user_id, event_id, i, v + 0.1::DOUBLE * rpe, rpe, phasic, greatest(0, least(1, tonic + 0.05::DOUBLE * (greatest(0, ret + 0.1::DOUBLE * new) + phasic - tonic))) FROM (SELECT *, least(2, greatest(0, rpe) * 2) AS phasic FROM (SELECT o.symbol, o.user_id, o.event_id, o.i, ret, new, v, tonic, ret + 0.99::DOUBLE * v - v AS rpe FROM f JOIN o ON o.symbol = f.symbol AND o.user_id = f.user_id AND o.i = f.i + 1)))
SELECT event_id, round(rpe, 6) AS rpe, round(phasic, 6) AS phasic, round(tonic, 6) AS tonic, round(1 / (1 + exp(-greatest(-10, least(10, 5 * (tonic - 0.5))))), 6) AS level FROM f WHERE i > 0""")
def w24_value_signal(spark, d):
    """Error, burst, level and signal at every step; the last digit of an event stands for its novelty."""
    x = ticks(spark, d)
    before = F.lag("price").over(W.series(["symbol", "user_id"], ["ts", "event_id"]))
    ret = F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("price") / F.nullif(before, F.lit(0.0)) - 1)), F.lit(0.0))
    out = O.value_series(x.withColumn("ret", ret), ["symbol", "user_id"], ["ts", "event_id"], "ret", F.col("event_id") % 10)
    return r(out.select("event_id", "rpe", "phasic", "tonic", "level"))


@query("SELECT event_id, round(1 / (1 + exp(-(-1 + value * 0.02 + user_id * 0.001))), 6) AS score FROM events")
def w32_warning_score(spark, d):
    return table(spark, d, "events").select("event_id", F.round(W.warning_score({"value": 0.02, "user_id": 0.001}, -1.0), 6).alias("score"))


@query("SELECT event_id, CASE WHEN (event_id % 10) / 10 < 0.2 THEN 'low confidence' WHEN abs(value - 50) / 50 > 0.8 THEN 'drift' ELSE 'quiet' END AS state FROM events")
def w33_truth_guard(spark, d):
    return table(spark, d, "events").select("event_id", W.truth_guard(F.lit(50.0), F.col("value"), (F.col("event_id") % 10) / 10, 0.2, 0.8).alias("state"))


@query(clamped("CASE WHEN value > 50 THEN 0.1 ELSE -0.1 END", 1.0, 0.0, 1.0, 1.0))
def w34_support_level(spark, d):
    return r(O.clamped(ticks(spark, d), ["user_id"], ["ts", "event_id"], F.when(F.col("price") > 50, 0.1).otherwise(-0.1), 1.0, 0.0, 1.0))
