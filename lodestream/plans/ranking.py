"""Queries on search, top-k and text functions (K and X rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.functions import scalars as X
from lodestream.operators import search as K

from .registry import query, table
from .summing import r

TOK = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')"
BM = f"""d AS (SELECT doc_id, {TOK} AS t FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d), q AS (SELECT DISTINCT item_id, unnest({TOK}) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT p.doc_id, term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.6 / (tf + 1.6 * (0.25 + 0.75 * len(t) / mean)) AS w FROM p JOIN f USING (term) JOIN d USING (doc_id), st),
bs AS (SELECT item_id, doc_id, sum(w) AS score FROM w JOIN q USING (term) GROUP BY ALL)"""


def bm(spark, d, k=10, extra=None):
    return K.bm25(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", k, extra=extra)


@query(f"WITH {BM} SELECT item_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM bs QUALIFY rank <= 10")
def k1_bm25(spark, d):
    return r(bm(spark, d))


COS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), cs AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score FROM v, v q WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"""


def cos(spark, d, k=10):
    e = table(spark, d, "embeddings")
    return K.cosine_top(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "query_id", k)


@query(f"WITH {COS} SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INT) AS rank FROM cs QUALIFY rank <= 10")
def k2_cosine(spark, d):
    return r(cos(spark, d))


@query(f"""WITH {BM}, a AS (SELECT item_id % 20 AS q, doc_id % 500 AS k, max(score) AS s FROM (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 30) GROUP BY ALL), {COS},
b AS (SELECT query_id % 20 AS q, vec_id AS k, max(score) AS s FROM (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) <= 30) GROUP BY ALL), h AS (SELECT q, k, 0.55 * coalesce(a.s, 0) + 0.45 * coalesce(b.s, 0) AS score FROM a FULL JOIN b USING (q, k))
SELECT q, k, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, k) AS INT) AS rank FROM h QUALIFY rank <= 10""")
def k3_hybrid(spark, d):
    a = bm(spark, d, 30).groupBy((F.col("item_id") % 20).alias("q"), (F.col("doc_id") % 500).alias("k")).agg(F.max("score").alias("score"))
    b = cos(spark, d, 30).groupBy((F.col("query_id") % 20).alias("q"), F.col("vec_id").alias("k")).agg(F.max("score").alias("score"))
    return r(K.hybrid(a, b, "q", "k", 10))


@query(f"""WITH {BM}, j AS (SELECT item_id, doc_id, score * CASE WHEN doc_id % 400 > 365 THEN 0 ELSE pow(0.5, (doc_id % 400) / 90.0) END * CASE WHEN source = 'src0' THEN 0.5 ELSE 1 END * CASE WHEN lang = 'en' THEN 1.15 ELSE 0.8 END * (1 + 0.03 * least(n_chars % 20, 10)) AS s FROM bs JOIN documents USING (doc_id))
SELECT item_id, doc_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS INT) AS rank FROM j QUALIFY rank <= 10""")
def k4_rerank(spark, d):
    j = bm(spark, d, 0, ["source", "lang", "n_chars"])
    s = K.rerank(F.col("score"), K.freshness(F.col("doc_id") % 400, 90.0, 365), F.when(F.col("source") == "src0", 0.5).otherwise(1.0), F.array("lang"), F.array(F.lit("en")), F.col("n_chars") % 20)
    return r(K.top(j.select("item_id", "doc_id", s.alias("score")), ["item_id"], [F.round("score", 9).desc(), F.col("doc_id")], 10))


@query("""WITH l AS (SELECT l_orderkey AS book, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, l_extendedprice AS price, l_linenumber * 100000 + l_partkey AS place FROM lineitem)
SELECT book, side, price, place, CAST(row_number() OVER (PARTITION BY book, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, place) AS INT) AS level FROM l QUALIFY level <= 2""")
def k5_best_levels(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.when(F.col("l_linenumber") % 2 == 0, "bid").otherwise("ask").alias("side"), F.col("l_extendedprice").alias("price"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("place"))
    return K.best_levels(li, "book", "side", "price", 2)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
def k6_riskiest(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(20)


@query()
def k7_code_neighbours(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", K.sign_code("embedding", 32, 64).alias("code"))
    near = K.cosine_top(e, "vec_id", "code", e.where("vec_id % 20 = 0"), "query_id", 5)
    return near.join(e.select("vec_id", "label"), "vec_id")


@query("SELECT doc_id, n_chars FROM documents WHERE contains(text, 'the') AND n_chars >= 500 AND lang IN ('en', 'de') ORDER BY n_chars DESC, doc_id DESC LIMIT 50")
def k8_recall_memories(spark, d):
    docs = table(spark, d, "documents").withColumn("at", F.struct("n_chars", "doc_id")).withColumn("tags", F.array("lang"))
    hit = docs.where(F.contains("text", F.lit("the")) & (F.col("n_chars") >= 500) & F.arrays_overlap("tags", F.array(F.lit("en"), F.lit("de"))))
    return hit.orderBy(F.desc("at")).limit(50).select("doc_id", "n_chars")


@query()
def k9_weighted_pick(spark, d):
    return K.weighted_pick(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 100)


WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query(f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and', 'to'))) AS p, len(list_filter(w, lambda x: x IN ('stupid', 'idiot', 'trash', 'of'))) AS n, len(list_filter(w, lambda x: x IN ('the'))) AS boost FROM t)
SELECT doc_id, round((p + 0.5 * boost - n) / greatest(p + n, 1), 6) AS score FROM s""")
def x1_lexicon_sentiment(spark, d):
    s = X.lexicon_score(F.col("text"), ["the", "and", "to"], ["stupid", "idiot", "trash", "of"], ["the"])
    return table(spark, d, "documents").select("doc_id", F.round(s, 6).alias("score"))


@query("""SELECT event_id, round(ln(1 + CAST(coalesce(json_extract(props, '$.k'), '0') AS DOUBLE) + user_id), 6) AS weight FROM events""")
def x2_engagement(spark, d):
    m = F.create_map(F.lit("likes"), F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)), F.lit("shares"), F.col("user_id").cast("double"))
    return table(spark, d, "events").select("event_id", F.round(X.engagement(m), 6).alias("weight"))


@query(f"""WITH d AS (SELECT doc_id, {TOK} AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, t, unnest(range(0, greatest(0, len(t) - 41) + 1, 160)) AS a FROM d WHERE len(t) > 0)
SELECT doc_id, CAST(a // 160 AS INT) AS nth, md5(array_to_string(t[a + 1 : a + 200], ' ')) AS segment FROM s""")
def x3_segments(spark, d):
    return K.segments(table(spark, d, "documents"), "doc_id", "text").withColumn("segment", F.md5("segment"))


@query()
def x4_shards(spark, d):
    return table(spark, d, "documents").groupBy(X.weighted_shard("doc_id", [3, 2, 1]).alias("shard")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages) SELECT page_id, scheme IN ('http', 'https') AND host <> '' AS valid, CASE WHEN host = '' THEN 'untitled' ELSE host END AS title FROM u""")
def x5_citations(spark, d):
    return table(spark, d, "pages").select("page_id", X.valid_link("url").alias("valid"), X.link_title("url").alias("title"))


@query("SELECT o_orderkey, round(CASE WHEN date_diff('day', o_orderdate, TIMESTAMP '1999-01-01') > 2000 THEN 0 ELSE pow(0.5, date_diff('day', o_orderdate, TIMESTAMP '1999-01-01') / 365.0) END, 6) AS fresh FROM orders")
def x6_freshness(spark, d):
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.round(K.freshness(age, 365.0, 2000), 6).alias("fresh"))


@query("""WITH g AS (SELECT source, list_sort(list(DISTINCT lang)) AS have FROM documents GROUP BY source) SELECT source, array_to_string(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM g""")
def x7_completeness(spark, d):
    return X.missing_tags(table(spark, d, "documents"), "source", "lang", ["de", "en", "es", "fr", "it"])


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id, a.e AS x, b.e AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(acos(greatest(-1, least(1, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)))))), 6) AS theta, round(list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y), 6) AS dist2 FROM p""")
def x8_vector_geometry(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return r(p.select("vec_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), K.cosine("x", "y")))).alias("theta"), (K.dot("x", "x") + K.dot("y", "y") - 2 * K.dot("x", "y")).alias("dist2")))


@query("""SELECT event_id, round(CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END, 6) AS gradient FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def x9_gradient(spark, d):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(X.gradient("value", w), 6).alias("gradient"))


@query("SELECT event_type, round(quantile_cont(abs(value - 50), 0.9), 6) AS tau FROM events GROUP BY ALL")
def x10_thresholds(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile(F.abs(F.col("value") - 50), F.lit(0.9)), 6).alias("tau"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(abs(CAST(x AS DOUBLE)), 1e-12)) AS a FROM embeddings), n AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p FROM v), j AS (SELECT x.vec_id, x.p AS p, y.p AS q FROM n x JOIN n y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / z[2]))), 5) AS kl FROM j""")
def x11_kl_divergence(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return p.select("vec_id", F.round(X.kl_divergence("v", "w"), 5).alias("kl"))


@query("SELECT event_type, round((avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / stddev_pop(value) ** 3, 4) AS skew, round(0.5 * (avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / stddev_pop(value) ** 3 + 0.3 * regr_slope(value, user_id) + 0.2 * (avg(value) - median(value)), 4) AS direction FROM events GROUP BY ALL")
def x12_skewness(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.skewness("value"), 4).alias("skew"), F.round(X.direction_index(F.skewness("value"), F.regr_slope("value", F.col("user_id").cast("double")), F.avg("value") - F.median("value")), 4).alias("direction"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id, a.e AS x, b.e AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1), k AS (SELECT vec_id, sqrt(list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y)) AS l2, sqrt(list_dot_product(x, x)) AS nx, 1 - list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS c FROM p)
SELECT vec_id, round(l2, 5) AS l2, round(l2 / nx, 5) AS relative, round(c, 5) AS cosine, round(0.5 * l2 / nx + 0.5 * c, 5) AS drift FROM k""")
def x13_descriptor_drift(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    l2 = F.sqrt(K.dot("x", "x") + K.dot("y", "y") - 2 * K.dot("x", "y"))
    p = p.select("vec_id", l2.alias("l2"), (l2 / F.sqrt(K.dot("x", "x"))).alias("relative"), (1 - K.cosine("x", "y")).alias("cosine"))
    return r(p.withColumn("drift", 0.5 * F.col("relative") + 0.5 * F.col("cosine")), 5)


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256('{"event_id":' || event_id || ',"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}') AS hash FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def x14_json_records(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k IS NOT NULL")
    return e.withColumn("hash", F.sha2(F.to_json(F.struct("event_id", "k")), 256))


@query("""WITH s AS (SELECT o_orderkey, floor(o_totalprice) AS q FROM orders), e AS (SELECT o_orderkey, q, unnest(range(4)) AS i FROM s) SELECT o_orderkey, CAST(i AS INT) AS slice, CASE WHEN i < 3 THEN floor(q / 4) ELSE q - 3 * floor(q / 4) END AS qty FROM e""")
def x15_twap_schedule(spark, d):
    return X.even_schedule(table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("double").alias("q")), "o_orderkey", "q", 4)


@query("""WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS q FROM orders), e AS (SELECT o_orderkey, q, unnest([0, 1, 2, 3]) AS slice FROM s) SELECT o_orderkey, CAST(slice AS INT) AS slice, round(q * [0.4, 0.2, 0.1, 0.3][slice + 1], 4) AS qty FROM e""")
def x15_vwap_schedule(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("q"))
    return r(X.profile_schedule(o, "o_orderkey", "q", [40.0, 20.0, 10.0, 30.0]), 4)


@query("""WITH e AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS q, unnest([0, 1, 2, 3]) AS slice FROM orders), a AS (SELECT *, least(q, 0.2::DOUBLE * [300000, 100000, 50000, 200000][slice + 1]) AS x FROM e), b AS (SELECT *, sum(x) OVER (PARTITION BY o_orderkey) AS given FROM a)
SELECT o_orderkey, CAST(slice AS INT) AS slice, round(x + CASE WHEN slice = 3 THEN greatest(0, q - given) ELSE 0 END, 4) AS qty FROM b""")
def x15_pov_schedule(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("q"))
    return r(X.profile_schedule(o, "o_orderkey", "q", [300_000.0, 100_000.0, 50_000.0, 200_000.0], 0.2), 4)


@query("""WITH p AS (SELECT l_returnflag AS run, l_extendedprice AS x, l_quantity * 1500 AS y FROM lineitem) SELECT run, round(avg((x - y) ** 2), 0) AS mse, round(10 * log10(avg(x * x) / avg((x - y) ** 2)), 5) AS snr, round(10 * log10(max(x) ** 2 / avg((x - y) ** 2)), 5) AS psnr FROM p GROUP BY run""")
def x16_signal_noise(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 1500).alias("y"))
    return r(X.signal_noise(p, ["run"], "x", "y"), 5, mse=0)
