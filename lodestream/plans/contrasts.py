"""Queries that contrast series and states (I8, I19, I25, I29) and the hashed term vectors (E6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import contrasts as C
from lodestream.operators import resampling as E

from .registry import query, table, ticks
from .summing import r

PAIR = "p AS (SELECT event_type AS symbol, value AS x, (event_id % 97) * 1.0 AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)"


def pair(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("x"), ((F.col("event_id") % 97) * 1.0).cast("double").alias("y"))


@query("""WITH x AS (SELECT event_type AS symbol, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS o, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
sd AS (SELECT symbol, o // 32 AS b, stddev_samp(price) AS sd FROM x WHERE o // 32 < n // 32 GROUP BY ALL), t AS (SELECT symbol, quantile_cont(sd, 0.5) AS t FROM sd GROUP BY symbol),
l AS (SELECT x.symbol, o, n, price, CASE WHEN n < 64 OR sd <= t THEN 'stable' WHEN sd > t THEN 'unstable' END AS state FROM x LEFT JOIN sd ON x.symbol = sd.symbol AND sd.b = o // 32 LEFT JOIN t ON t.symbol = x.symbol),
pp AS (SELECT symbol, 'full' AS part, o, price FROM l UNION ALL SELECT symbol, CASE WHEN o < n // 2 THEN 'first' ELSE 'second' END, o, price FROM l UNION ALL SELECT symbol, state, o, price FROM l WHERE state IS NOT NULL),
c AS (SELECT symbol, part, avg(price) AS m, count(*) AS n FROM pp GROUP BY ALL HAVING count(*) >= 64), y AS (SELECT symbol, part, row_number() OVER w - 1 AS i, sum(price - m) OVER w AS y, n FROM pp JOIN c USING (symbol, part) WINDOW w AS (PARTITION BY symbol, part ORDER BY o ROWS UNBOUNDED PRECEDING)),
e AS (SELECT symbol, part, y, n, unnest([4, 8, 16]) AS scale, i FROM y), g AS (SELECT *, i // scale AS seg, i % scale AS x FROM e WHERE (i // scale + 1) * scale <= n AND n >= 2 * scale), rr AS (SELECT symbol, part, scale, seg, sqrt(greatest(0, var_pop(y) * (1 - coalesce(corr(x, y) ** 2, 0)))) AS rms FROM g GROUP BY ALL),
f AS (SELECT symbol, part, scale, avg(rms) AS f FROM rr GROUP BY ALL), a AS (SELECT symbol, part, regr_slope(ln(f), ln(scale)) AS alpha FROM f WHERE f > 0 GROUP BY ALL),
z AS (SELECT symbol, max(alpha) FILTER (part = 'full') AS "full", max(alpha) FILTER (part = 'first') AS first, max(alpha) FILTER (part = 'second') AS second, max(alpha) FILTER (part = 'stable') AS stable, max(alpha) FILTER (part = 'unstable') AS unstable FROM a GROUP BY symbol)
SELECT symbol, round("full", 5) AS "full", round(first, 5) AS first, round(second, 5) AS second, round(stable, 5) AS stable, round(unstable, 5) AS unstable, round(abs(first - second), 5) AS delta_half, round(abs(stable - unstable), 5) AS delta_state, coalesce(abs(first - second) > 0.1, false) OR coalesce(abs(stable - unstable) > 0.1, false) AS differs FROM z""")
def i19_state_contrast(spark, d):
    return r(C.state_contrast(ticks(spark, d), ["symbol"], ["ts", "event_id"], "price", 32, 0.5, [4, 8, 16], 0.1), 5)


@query(f"""WITH {PAIR}, e AS (SELECT *, unnest([i // 32, i // 32 - 1]) AS s FROM p), g AS (SELECT symbol, s, i - 32 * s AS j, x, y FROM e WHERE s >= 0 AND 32 * s + 64 <= n),
m AS (SELECT symbol, s, j, (x - avg(x) OVER w) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS u, (y - avg(y) OVER w) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS v FROM g WINDOW w AS (PARTITION BY symbol, s)), k AS (SELECT unnest(range(0, 33)) AS k),
dft AS (SELECT symbol, s, k, sum(u * cos(2 * pi() * k * j / 64)) AS ur, -sum(u * sin(2 * pi() * k * j / 64)) AS ui, sum(v * cos(2 * pi() * k * j / 64)) AS vr, -sum(v * sin(2 * pi() * k * j / 64)) AS vi FROM m, k GROUP BY ALL),
c AS (SELECT symbol, k, (avg(ur * vr + ui * vi) ** 2 + avg(ur * vi - ui * vr) ** 2) / (avg(ur ** 2 + ui ** 2) * avg(vr ** 2 + vi ** 2)) AS coh, count(*) AS segments FROM dft GROUP BY ALL HAVING count(*) > 1)
SELECT symbol, arg_max(k, coh) / 64 AS frequency, round(max(coh), 5) AS coherence, max(segments) AS segments FROM c GROUP BY symbol""")
def i25_coherence(spark, d):
    return r(C.coherence_peak(C.coherence(pair(spark, d), ["symbol"], ["ts", "event_id"], "x", "y"), ["symbol"]), 6, coherence=5)


@query(f"""WITH {PAIR}, c AS (SELECT symbol, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy FROM p GROUP BY symbol), k AS (SELECT unnest(range(1, 11)) AS k),
l AS (SELECT a.symbol, k, avg((a.x - mx) * (b.x - mx)) / (any_value(vx) + 1e-30) AS ax, avg((a.y - my) * (b.y - my)) / (any_value(vy) + 1e-30) AS ay FROM k, p a JOIN p b ON b.symbol = a.symbol AND b.i = a.i + k JOIN c ON c.symbol = a.symbol GROUP BY a.symbol, k),
f AS (SELECT symbol, sqrt(avg((ax - ay) ** 2)) AS acf_rmse FROM l GROUP BY symbol), rx AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY x) AS r FROM p), ry AS (SELECT symbol, y, row_number() OVER (PARTITION BY symbol ORDER BY y) AS r FROM p)
SELECT symbol, round(any_value(acf_rmse), 6) AS acf_rmse, round(max(abs(x - y)), 6) AS distribution_error FROM rx JOIN ry USING (symbol, r) JOIN f USING (symbol) GROUP BY symbol""")
def i29_null_fidelity(spark, d):
    return r(C.null_fidelity(pair(spark, d), ["symbol"], ["ts", "event_id"], "x", "y", 10))


@query()
def i8_bootstrap_difference(spark, d):
    x = table(spark, d, "lineitem").withColumn("row", F.concat_ws("-", "l_orderkey", "l_linenumber")).withColumn("late", F.col("l_returnflag") == "R")
    return r(C.bootstrap_difference(x, ["l_linestatus"], "row", "late", "l_quantity"))


@query(r"""WITH w AS (SELECT item_id, unnest(string_split_regex(lower(text), '\s+')) AS word FROM benchmark), g AS (SELECT item_id, sha256(word) AS h, count(*) AS n FROM w WHERE word <> '' GROUP BY item_id, word), b AS (SELECT item_id, n, h, unnest(range(1, 62, 4)) AS pos FROM g),
v AS (SELECT item_id, CAST('0x' || substr(h, pos, 2) AS INTEGER) % 384 AS place, sum(n * CAST('0x' || substr(h, pos + 2, 2) AS INTEGER)) AS x FROM b GROUP BY ALL) SELECT item_id, place, round(CAST(x AS DOUBLE) / sqrt(CAST(sum(x * x) OVER (PARTITION BY item_id) AS DOUBLE)), 6) AS weight FROM v WHERE x > 0""")
def e6_term_vectors(spark, d):
    return r(C.term_vectors(table(spark, d, "benchmark"), "item_id", "text"))


LINES = "(SELECT l_returnflag AS k, l_linestatus = 'O' AS g, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey * 100 + l_suppkey AS id, l_quantity AS v FROM lineitem)"


def lines(spark, d):
    li = table(spark, d, "lineitem")
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey")
    return li.select(F.col("l_returnflag").alias("k"), (F.col("l_linestatus") == "O").alias("g"), row.alias("id"), F.col("l_quantity").cast("double").alias("v"))


@query(f"SELECT k, count(v) AS n, round(avg(v), 6) AS mean, round((avg(v) - 25) / sqrt(var_samp(v) / count(v)), 5) AS t, (count(v) - 1)::DOUBLE AS dof FROM {LINES} GROUP BY k")
def i6_one_sample(spark, d):
    return r(E.one_sample_t(lines(spark, d), ["k"], "v", 25.0).drop("p"), 6, t=5)


@query(f"""WITH x AS {LINES}, n AS (SELECT k, count(*) FILTER (g) AS na, avg(v) FILTER (g) - avg(v) FILTER (NOT g) AS s FROM x GROUP BY k), p AS (SELECT k, round, v, row_number() OVER (PARTITION BY k, round ORDER BY md5('42:' || round || ':' || id), id) AS i FROM x, (SELECT unnest(range(1, 20)) AS round)),
q AS (SELECT p.k, round, avg(v) FILTER (i <= na) - avg(v) FILTER (i > na) AS s FROM p JOIN n USING (k) GROUP BY ALL) SELECT n.k, round(any_value(n.s), 6) AS statistic, count(*) FILTER (abs(q.s) >= abs(n.s)) AS extreme, round((count(*) FILTER (abs(q.s) >= abs(n.s)) + 1) / 20, 6) AS p FROM q JOIN n USING (k) GROUP BY n.k""")
def i6_permutation(spark, d):
    return r(E.permutation_test(lines(spark, d), ["k"], "id", "g", "v", rounds=19))


@query()
def i8_bootstrap_statistic(spark, d):
    """The standardised difference, as one of the statistics that can be given."""
    return r(E.bootstrap_interval(lines(spark, d), ["k"], "id", "g", "v", rounds=100), 5)
