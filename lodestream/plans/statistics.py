"""Queries on statistics (I rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import recurrences as V
from lodestream.operators import stats as S

from .registry import query, table, ticks
from .summing import RETURNS, r, returns

P = "(SELECT event_type AS symbol, ts, event_id, user_id, value AS price FROM events)"
O = "PARTITION BY symbol ORDER BY ts, event_id"  # noqa: E741


@query(f"""WITH a AS (SELECT symbol, price FROM {P} WHERE event_id % 2 = 0), b AS (SELECT symbol, price * 1.2 AS price FROM {P} WHERE event_id % 2 = 1), e AS (SELECT symbol, quantile_cont(price, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM a GROUP BY symbol),
ca AS (SELECT symbol, least(10, len(list_filter(q, lambda x: x <= price))) AS bin, count(*) AS n FROM a JOIN e USING (symbol) WHERE price BETWEEN q[1] AND q[11] GROUP BY ALL), cb AS (SELECT symbol, least(10, len(list_filter(q, lambda x: x <= price))) AS bin, count(*) AS n FROM b JOIN e USING (symbol) WHERE price BETWEEN q[1] AND q[11] GROUP BY ALL),
pa AS (SELECT symbol, bin, n / sum(n) OVER (PARTITION BY symbol) AS p FROM ca), pb AS (SELECT symbol, bin, n / sum(n) OVER (PARTITION BY symbol) AS p FROM cb), g AS (SELECT symbol, unnest(range(1, 11)) AS bin FROM e),
j AS (SELECT symbol, greatest(coalesce(pa.p, 0), 1e-6) AS p, greatest(coalesce(pb.p, 0), 1e-6) AS q FROM g LEFT JOIN pa USING (symbol, bin) LEFT JOIN pb USING (symbol, bin)) SELECT symbol, round(sum((q - p) * ln(q / p)), 5) AS psi FROM j GROUP BY symbol""")
def i1_psi(spark, d):
    t = ticks(spark, d)
    return r(S.psi(t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1").withColumn("price", F.col("price") * 1.2), ["symbol"], "price"), 5)


@query(f"""WITH g AS (SELECT symbol, price, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 <> 0) AS b FROM {P} GROUP BY ALL), c AS (SELECT symbol, sum(a) OVER w AS n, sum(b) OVER w AS m, abs(sum(a) OVER u / sum(a) OVER w - sum(b) OVER u / sum(b) OVER w) AS d FROM g WINDOW w AS (PARTITION BY symbol), u AS (PARTITION BY symbol ORDER BY price ROWS UNBOUNDED PRECEDING)),
s AS (SELECT symbol, any_value(n) AS n, any_value(m) AS m, max(d) AS d FROM c GROUP BY symbol), x AS (SELECT *, (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * d AS x FROM s)
SELECT symbol, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(d, 6) AS d, round(greatest(0, least(1, CASE WHEN x < 1e-3 THEN 1 ELSE list_sum(list_transform(range(1, 101), lambda k: 2 * CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * x * x))) END)), 6) AS p FROM x""")
def i2_kolmogorov_smirnov(spark, d):
    return r(S.kolmogorov_smirnov(ticks(spark, d), ["symbol"], F.col("user_id") % 2 == 0, "price"))


@query()
def i3_drift_calibration(spark, d):
    """95 % quantile of the stability index between hashed samples of one column."""
    t = ticks(spark, d).select("symbol", "price", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("round"), "event_id").withColumn("u", S.uniform(3, "event_id", "round"))
    p = S.psi(t.where("u < 0.3").drop("u"), t.where("u >= 0.3 AND u < 0.6").drop("u"), ["symbol", "round"], "price")
    return p.groupBy("symbol").agg(F.percentile("psi", F.lit(0.95)).alias("threshold"))


@query()
def i4_bootstrap_mean(spark, d):
    return S.bootstrap_mean(ticks(spark, d).withColumn("x", F.col("price") - 50), ["symbol"], "event_id", "x", 100)


TAU = f"""s AS (SELECT symbol, avg(price) AS m, var_pop(price) AS v, count(*) AS n FROM {P} GROUP BY symbol), x AS (SELECT symbol, ts, event_id, price - m AS x, v, n FROM {P} JOIN s USING (symbol)),
l AS (SELECT symbol, v, n, x, unnest([lag(x, 1) OVER w, lag(x, 2) OVER w, lag(x, 3) OVER w, lag(x, 4) OVER w, lag(x, 5) OVER w]) AS y, unnest([1, 2, 3, 4, 5]) AS lag FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)), a AS (SELECT symbol, lag, sum(x * y) / any_value(n) / any_value(v) AS rho FROM l GROUP BY ALL)"""


@query(f"WITH {TAU} SELECT symbol, lag, round(rho, 6) AS rho FROM a")
def i5_autocorrelation(spark, d):
    return r(S.autocovariances(ticks(spark, d), ["symbol"], ["ts", "event_id"], "price", 5))


@query(f"""WITH {TAU}, k AS (SELECT *, min(CAST(rho > 0 AS INT)) OVER (PARTITION BY symbol ORDER BY lag ROWS UNBOUNDED PRECEDING) AS ok FROM a), t AS (SELECT symbol, 1 + 2 * sum(CASE WHEN ok = 1 THEN rho ELSE 0 END) AS tau FROM k GROUP BY symbol) SELECT symbol, n, round(tau, 6) AS tau, round(n / tau, 3) AS effective FROM t JOIN s USING (symbol)""")
def i5_effective_size(spark, d):
    t = ticks(spark, d)
    rho = S.autocovariances(t, ["symbol"], ["ts", "event_id"], "price", 5)
    return r(S.effective_size(rho, t.groupBy("symbol").agg(F.count("price").alias("n")), ["symbol"]), 6, effective=3)


TWO = """WITH x AS (SELECT l_returnflag AS k, l_quantity AS v, l_linestatus = 'O' AS g FROM lineitem WHERE l_returnflag <> 'X'), m AS (SELECT k, count(*) FILTER (g) AS na, count(*) FILTER (NOT g) AS nb, avg(v) FILTER (g) AS ma, avg(v) FILTER (NOT g) AS mb, var_samp(v) FILTER (g) AS va, var_samp(v) FILTER (NOT g) AS vb FROM x GROUP BY k),
p AS (SELECT k, v, count(*) FILTER (g) AS a, count(*) FILTER (NOT g) AS b FROM x GROUP BY ALL), u AS (SELECT k, sum(t) AS u FROM (SELECT k, a * (coalesce(sum(b) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b / 2) AS t FROM p) GROUP BY k)"""


@query(f"""{TWO} SELECT k, na, nb, round((ma - mb) / sqrt(va / na + vb / nb), 5) AS t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 3) AS dof, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohen_d,
round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * (1 - 3 / (4 * (na + nb) - 9)), 6) AS hedges_g, u, round(2 * u / (na * nb) - 1, 6) AS cliff FROM m JOIN u USING (k)""")
def i6_two_samples(spark, d):
    x = table(spark, d, "lineitem").where("l_returnflag <> 'X'").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("v"), "l_linestatus")
    return r(S.two_samples(x, ["k"], F.col("l_linestatus") == "O", "v"), 6, t=5, dof=3)


@query(f"""{TWO}, d AS (SELECT k, na, nb, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS c FROM m), g AS (SELECT *, c * (1 - 3 / (4 * (na + nb) - 9)) AS g FROM d)
SELECT k, round(c, 6) AS cohen_d, round(c - 1.959963984540054 * sqrt((na + nb) / (na * nb) + c * c / (2 * (na + nb))), 6) AS d_low, round(c + 1.959963984540054 * sqrt((na + nb) / (na * nb) + c * c / (2 * (na + nb))), 6) AS d_high,
round(g, 6) AS hedges_g, round(g - 1.959963984540054 * sqrt((na + nb) / (na * nb) + g * g / (2 * (na + nb))), 6) AS g_low, round(g + 1.959963984540054 * sqrt((na + nb) / (na * nb) + g * g / (2 * (na + nb))), 6) AS g_high, round(2 * u / (na * nb) - 1, 6) AS cliff FROM g JOIN u USING (k)""")
def i7_effect_sizes(spark, d):
    x = table(spark, d, "lineitem").where("l_returnflag <> 'X'").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("v"), "l_linestatus")
    return r(S.effect_sizes(x, ["k"], F.col("l_linestatus") == "O", "v"))


@query("""WITH x AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, abs(o_totalprice / 100000 - 1) AS d FROM orders), s AS (SELECT a.k, quantile_cont((b.d - a.d) / (b.i - a.i), 0.5) AS slope FROM x a JOIN x b ON a.k = b.k AND a.i < b.i GROUP BY a.k)
SELECT k, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(any_value(slope), 5) END AS slope, CASE WHEN count(*) < 3 THEN 'INSUFFICIENT' WHEN any_value(slope) < 0 THEN 'CONVERGING' ELSE 'NOT_CONVERGING' END AS status, round(arg_min(d, i), 4) AS first_distance, round(arg_max(d, i), 4) AS last_distance FROM x LEFT JOIN s USING (k) GROUP BY k""")
def i15_convergence(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey", (F.col("o_totalprice") / 100000).alias("v"))
    return r(S.convergence(o, ["k"], ["o_orderdate", "o_orderkey"], "v", 1.0), 4, slope=5)


@query("""WITH x AS (SELECT o_orderpriority AS f, o_orderkey AS k, (o_custkey * 7919 % 10007 + 1) / 10008.0 / 50 AS p FROM orders), y AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY f) AS m FROM x WINDOW w AS (PARTITION BY f ORDER BY p, k))
SELECT k, round(least(1, p * m), 9) AS bonferroni, round(least(1, max(p * (m - r + 1)) OVER (PARTITION BY f ORDER BY p, k ROWS UNBOUNDED PRECEDING)), 9) AS holm, round(least(1, min(p * m / r) OVER (PARTITION BY f ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS bh FROM y""")
def i9_corrections(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("f"), F.col("o_orderkey").alias("k"), ((F.col("o_custkey") * 7919 % 10007 + 1) / 10008.0 / 50).alias("p"))
    return r(S.corrected(x, ["f"], "p", "k").drop("f", "p"), 9)


@query("""WITH g AS (SELECT lang, count(*) AS n, sum(toxic) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, n, round((k / n + 1.959963984540054 ** 2 / (2 * n)) / (1 + 1.959963984540054 ** 2 / n) - 1.959963984540054 / (1 + 1.959963984540054 ** 2 / n) * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 ** 2 / (4 * n * n)), 6) AS low,
round((k / n + 1.959963984540054 ** 2 / (2 * n)) / (1 + 1.959963984540054 ** 2 / n) + 1.959963984540054 / (1 + 1.959963984540054 ** 2 / n) * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 ** 2 / (4 * n * n)), 6) AS high FROM g""")
def i10_wilson(spark, d):
    g = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    low, high = S.wilson(F.col("k").cast("double"), F.col("n"))
    return r(g.select("lang", "n", low.alias("low"), high.alias("high")))


@query("""WITH x AS (SELECT toxic AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), p AS (SELECT s, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM x GROUP BY s), u AS (SELECT a * (coalesce(sum(b) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b / 2) AS u, a, b FROM p),
g AS (SELECT sum(a) AS n1, sum(b) AS n0, sum(u) / (sum(a) * sum(b)) AS c FROM u) SELECT 1 AS one, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, round(c, 6) AS auc, round(sqrt((c * (1 - c) + (n1 - 1) * (c / (2 - c) - c * c) + (n0 - 1) * (2 * c * c / (1 + c) - c * c)) / (n1 * n0)), 6) AS se FROM g""")
def i10_auc(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("one", F.lit(1))
    return r(S.auc(x, ["one"], "toxic", "n_chars"))


@query("""WITH x AS (SELECT user_id AS k, event_id, ln(1.0 + event_id % 97) AS x, ln(value * 0.1 + 1.0 + event_id % 97) AS y FROM events WHERE value > -1), s AS (SELECT a.k, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM x a JOIN x b ON a.k = b.k AND a.event_id < b.event_id AND a.x <> b.x GROUP BY a.k), c AS (SELECT k, count(*) AS used, max(x) - min(x) AS span, median(x) AS mx, median(y) AS my, avg(y) AS ay FROM x GROUP BY k), f AS (SELECT x.k, CASE WHEN sum((y - ay) ** 2) > 1e-10 THEN 1 - sum((y - my - slope * (x - mx)) ** 2) / sum((y - ay) ** 2) ELSE 0 END AS r2 FROM x JOIN c ON c.k = x.k LEFT JOIN s ON s.k = x.k GROUP BY x.k)
SELECT k, used, CASE WHEN used >= 5 AND span >= 0.5 THEN round(-slope, 5) END AS gamma, CASE WHEN used >= 5 AND span >= 0.5 THEN round(r2, 5) END AS r2, CASE WHEN used < 5 THEN 'INSUFFICIENT_DATA' WHEN span < 0.5 THEN 'INSUFFICIENT_RANGE' WHEN r2 < 0.3 THEN 'LOW_R2' WHEN abs(-slope - 1) < 0.15 THEN 'METASTABLE' WHEN abs(-slope - 1) < 0.30 THEN 'WARNING' WHEN abs(-slope - 1) < 0.50 THEN 'CRITICAL' ELSE 'COLLAPSE' END AS verdict FROM c LEFT JOIN s USING (k) LEFT JOIN f USING (k)""")
def i12_theil_sen(spark, d):
    x = table(spark, d, "events").where("value > -1").select(F.col("user_id").alias("k"), "event_id", (1.0 + F.col("event_id") % 97).alias("x"), (F.col("value") * 0.1 + 1.0 + F.col("event_id") % 97).alias("y"))
    return r(S.theil_sen(x, ["k"], "event_id", "x", "y"), 5)


DFA = f"""s AS (SELECT symbol, avg(price) AS m FROM {P} GROUP BY symbol), y AS (SELECT symbol, row_number() OVER w - 1 AS i, sum(price - m) OVER w AS y, count(*) OVER (PARTITION BY symbol) AS n FROM {P} JOIN s USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {DFA}, e AS (SELECT symbol, y, n, unnest([8, 16, 32, 64]) AS scale, i FROM y), g AS (SELECT *, i // scale AS seg, i % scale AS x FROM e WHERE (i // scale + 1) * scale <= n AND n >= 2 * scale), rr AS (SELECT symbol, scale, seg, sqrt(greatest(0, var_pop(y) * (1 - coalesce(corr(x, y) ** 2, 0)))) AS rms FROM g GROUP BY ALL), f AS (SELECT symbol, scale, avg(rms) AS f FROM rr GROUP BY ALL)
SELECT symbol, round(regr_slope(ln(f), ln(scale)), 5) AS alpha, count(*) AS scales FROM f WHERE f > 0 GROUP BY symbol""")
def i17_fluctuation(spark, d):
    return r(S.fluctuation(ticks(spark, d), ["symbol"], ["ts", "event_id"], "price", [8, 16, 32, 64]), 5)


@query(f"""WITH {DFA}, e AS (SELECT symbol, i, y, n, unnest([8, 16, 32]) AS scale FROM y), g AS (SELECT symbol, scale, y, n, i AS p, 0 AS side FROM e UNION ALL SELECT symbol, scale, y, n, n - 1 - i, 1 FROM e), h AS (SELECT *, p // scale AS seg, p % scale AS x FROM g WHERE p < (n // scale) * scale AND n >= 4 * scale),
rr AS (SELECT symbol, scale, side, seg, var_pop(y) * (1 - coalesce(corr(x, y) ** 2, 0)) AS f2 FROM h GROUP BY ALL), q AS (SELECT symbol, scale, f2, unnest([-2.0, 0.0, 2.0]) AS q FROM rr WHERE f2 > 1e-20), f AS (SELECT symbol, scale, CAST(q AS DOUBLE) AS q, CASE WHEN any_value(q) = 0 THEN 0.5 * avg(ln(f2)) ELSE ln(avg(pow(f2, q / 2))) / any_value(q) END AS lf FROM q GROUP BY symbol, scale, q)
SELECT symbol, q, round(regr_slope(lf, ln(scale)), 4) AS h FROM f GROUP BY symbol, q""")
def i18_multifractal(spark, d):
    return r(S.multifractal(ticks(spark, d), ["symbol"], ["ts", "event_id"], "price", [8, 16, 32], [-2.0, 0.0, 2.0]), 4)


@query(f"""WITH y AS (SELECT symbol, price, row_number() OVER ({O}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {P}), e AS (SELECT *, unnest([8, 16, 32]) AS width FROM y), g AS (SELECT *, i // width AS blk FROM e WHERE (i // width + 1) * width <= n),
c AS (SELECT symbol, width, blk, price, sum(price) OVER w - row_number() OVER w * avg(price) OVER (PARTITION BY symbol, width, blk) AS z FROM g WINDOW w AS (PARTITION BY symbol, width, blk ORDER BY i ROWS UNBOUNDED PRECEDING)), rr AS (SELECT symbol, width, blk, (max(z) - min(z)) / nullif(stddev_pop(price), 0) AS rs FROM c GROUP BY ALL), m AS (SELECT symbol, width, avg(rs) AS rs FROM rr GROUP BY ALL)
SELECT symbol, round(greatest(0, least(1, regr_slope(ln(rs), ln(width)))), 5) AS hurst FROM m WHERE rs > 0 GROUP BY symbol""")
def i20_rescaled_range(spark, d):
    return r(S.rescaled_range(ticks(spark, d), ["symbol"], ["ts", "event_id"], "price", [8, 16, 32]), 5)


@query("""WITH c AS (SELECT DISTINCT l_returnflag AS k, l_partkey % 128 AS x, CAST(floor(l_quantity * 2) AS BIGINT) AS y FROM lineitem), e AS (SELECT *, unnest([1, 2, 4, 8, 16]) AS s FROM c), n AS (SELECT k, s, count(DISTINCT (x // s, y // s)) AS n FROM e GROUP BY ALL) SELECT k, round(-regr_slope(ln(n), ln(s)), 6) AS dimension FROM n GROUP BY k""")
def i21_box_dimension(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_partkey") % 128).alias("x"), F.floor(F.col("l_quantity") * 2).alias("y")).distinct()
    return r(S.box_dimension(c, ["k"], "x", "y", [1, 2, 4, 8, 16]))


@query(f"""WITH b AS (SELECT symbol, ts, event_id, CASE WHEN max(user_id) OVER w > min(user_id) OVER w THEN least(5, floor((user_id - min(user_id) OVER w) / (max(user_id) OVER w - min(user_id) OVER w) * 6)) ELSE 0 END AS x, CASE WHEN max(price) OVER w > min(price) OVER w THEN least(5, floor((price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w) * 6)) ELSE 0 END AS y FROM {P} WINDOW w AS (PARTITION BY symbol)),
z AS (SELECT symbol, x, y, lead(y) OVER ({O}) AS z FROM b), d AS (SELECT * FROM z WHERE z IS NOT NULL), h AS (SELECT symbol, entropy(z * 100 + y) + entropy(y * 100 + x) - entropy(y) - entropy(z * 10000 + y * 100 + x) AS te FROM d GROUP BY symbol) SELECT symbol, round(greatest(0, te), 6) AS te FROM h""")
def i22_transfer_entropy(spark, d):
    return r(S.transfer_entropy(ticks(spark, d).withColumn("u", F.col("user_id").cast("double")), ["symbol"], ["ts", "event_id"], "u", "price"))


@query()
def i26_surrogates(spark, d):
    t = ticks(spark, d)
    a = S.shuffled(t, ["symbol"], ["ts"], "event_id", "price", 3).withColumn("family", F.lit("shuffle"))
    return a.unionByName(S.circular_shift(t, ["symbol"], ["ts", "event_id"], "price", 3).withColumn("family", F.lit("shift")))


@query()
def i28_null_verdict(spark, d):
    """Lag-1 autocorrelation of each series against shuffles of it."""
    t = ticks(spark, d)
    own = S.autocovariances(t, ["symbol"], ["ts", "event_id"], "price", 1).select("symbol", F.col("rho").alias("stat"))
    nulls = S.shuffled_autocovariances(t, ["symbol"], "event_id", "price", 40).withColumnRenamed("rho", "stat")
    return S.null_verdict(own, nulls, ["symbol"], "stat")


@query("SELECT event_type AS symbol, round(1 + count(*) / sum(ln(value / 5)), 6) AS exponent, count(*) AS n FROM events WHERE value >= 5 GROUP BY ALL")
def i31_power_law(spark, d):
    return r(S.power_law(ticks(spark, d), ["symbol"], "price", 5.0))


@query(f"""WITH x AS (SELECT symbol, price AS x, unnest([lead(price, 1) OVER w, lead(price, 2) OVER w, lead(price, 3) OVER w]) AS y, unnest([1, 2, 3]) AS k FROM {P} WINDOW w AS ({O})), g AS (SELECT symbol, k, sum(x * y) / sum(x * x) AS r FROM x WHERE y IS NOT NULL GROUP BY ALL) SELECT symbol, round(avg(pow(r, 1.0 / k)), 6) AS ratio FROM g WHERE r > 0 GROUP BY symbol""")
def i31_branching_ratio(spark, d):
    return r(S.branching_ratio(ticks(spark, d), ["symbol"], ["ts", "event_id"], "price", 3))


@query(f"""WITH x AS (SELECT * FROM ({RETURNS}) WHERE ret IS NOT NULL) SELECT CASE WHEN symbol IN ('click', 'view') THEN 'traffic' ELSE 'business' END AS branch, count(*) AS n, round(quantile_cont(ret, 0.5), 6) AS median FROM x GROUP BY ALL""")
def i36_branch_rollup(spark, d):
    x = returns(spark, d).withColumn("branch", F.when(F.col("symbol").isin("click", "view"), "traffic").otherwise("business"))
    return x.groupBy("branch").agg(F.count("*").alias("n"), F.round(F.percentile("ret", F.lit(0.5)), 6).alias("median"))


@query("""WITH x AS (SELECT user_id AS k, event_id, 1.0 + event_id % 97 AS x, value * 0.1 + 1.0 + event_id % 97 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value > -1), w AS (SELECT *, unnest([i // greatest(1, n // 4) - 1, i // greatest(1, n // 4)]) AS win FROM x),
l AS (SELECT k, win, event_id, ln(x) AS x, ln(y) AS y FROM w WHERE win >= 0 AND win < 3), s AS (SELECT a.k, a.win, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM l a JOIN l b ON a.k = b.k AND a.win = b.win AND a.event_id < b.event_id AND a.x <> b.x GROUP BY ALL)
SELECT k, count(*) AS windows, round(max(-slope) - min(-slope), 5) AS spread FROM s GROUP BY k""")
def i14_window_sweep(spark, d):
    x = table(spark, d, "events").where("value > -1").select(F.col("user_id").alias("k"), "ts", "event_id", (1.0 + F.col("event_id") % 97).alias("x"), (F.col("value") * 0.1 + 1.0 + F.col("event_id") % 97).alias("y"))
    g = S.theil_sen(S.half_overlapping(x, ["k"], ["ts", "event_id"], 3), ["k", "win"], "event_id", "x", "y").where("gamma IS NOT NULL")
    return r(g.groupBy("k").agg(F.count("*").alias("windows"), (F.max("gamma") - F.min("gamma")).alias("spread")), 5)


@query()
def i13_exponent_interval(spark, d):
    """Share of hashed half samples whose exponent exceeds one, with the middle 95 % of exponents."""
    x = table(spark, d, "events").where("value > -1").select((F.col("user_id") % 5).alias("k"), "event_id", (1.0 + F.col("event_id") % 97).alias("x"), (F.col("value") * 0.1 + 1.0 + F.col("event_id") % 97).alias("y"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("round"))
    g = S.theil_sen(x.where(S.uniform(7, "event_id", "round") < 0.5), ["k", "round"], "event_id", "x", "y")
    q = F.percentile("gamma", F.array(F.lit(0.025), F.lit(0.975)))
    return g.groupBy("k").agg(q.alias("q"), F.avg((F.col("gamma") > 1).cast("int")).alias("above")).select("k", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "above")


@query()
def i16_spectrum_slope(spark, d):
    return S.spectrum_slope(ticks(spark, d), ["symbol"], ["ts", "event_id"], "price", 32)


@query("""WITH x AS (SELECT event_type || (user_id % 20) AS k, row_number() OVER w AS i, value AS x, lead(value, 2) OVER w AS y FROM events WINDOW w AS (PARTITION BY event_type || (user_id % 20) ORDER BY ts, event_id)), e AS (SELECT * FROM x WHERE y IS NOT NULL),
p AS (SELECT a.k, a.i, b.i AS j FROM e a JOIN e b ON a.k = b.k AND a.i < b.i AND abs(a.x - b.x) <= 20 AND abs(a.y - b.y) <= 20), g AS (SELECT k, coalesce(lead(i) OVER w = i + 1, false) OR coalesce(lag(i) OVER w = i - 1, false) AS d FROM p WINDOW w AS (PARTITION BY k, j - i ORDER BY i)), s AS (SELECT k, count(*) AS points, count(*) FILTER (d) AS diag FROM g GROUP BY k), n AS (SELECT k, count(*) AS n FROM e GROUP BY k)
SELECT k, round(2 * coalesce(points, 0) / nullif(n * (n - 1), 0), 6) AS rate, round(diag / points, 6) AS determinism FROM n LEFT JOIN s USING (k)""")
def i24_recurrence(spark, d):
    x = table(spark, d, "events").withColumn("k", F.concat("event_type", (F.col("user_id") % 20).cast("string")))
    return r(V.recurrence(x, ["k"], ["ts", "event_id"], "value", 2, 20))


@query("""WITH m AS (SELECT l_returnflag AS k, 'l_tax' AS metric, l_tax AS v, l_linestatus = 'O' AS g FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount, l_linestatus = 'O' FROM lineitem), s AS (SELECT metric, avg(v) FILTER (g) - avg(v) FILTER (NOT g) AS diff, var_samp(v) FILTER (g) / count(*) FILTER (g) + var_samp(v) FILTER (NOT g) / count(*) FILTER (NOT g) AS se2 FROM m GROUP BY metric)
SELECT metric, round(diff, 9) AS diff, round(diff / sqrt(se2), 5) AS t FROM s""")
def i11_panel_contrast(spark, d):
    li = table(spark, d, "lineitem")
    long = li.select("l_linestatus", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("l_tax", "l_discount")])).alias("x")).select("l_linestatus", "x.*")
    out = S.two_samples(long, ["metric"], F.col("l_linestatus") == "O", "v").select("metric", "t")
    mean = long.groupBy("metric").agg((F.avg(F.when(F.col("l_linestatus") == "O", F.col("v"))) - F.avg(F.when(F.col("l_linestatus") != "O", F.col("v")))).alias("diff"))
    return out.join(mean, "metric").select("metric", F.round("diff", 9).alias("diff"), F.round("t", 5).alias("t"))
