"""Queries on ledgers and evidence (V rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import ledger as V
from lodestream.operators.clean import violations
from lodestream.sources.files import fingerprint

from .registry import query, table


def chain(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("ledger"), F.col("o_orderkey").alias("sequence"), F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("record"))
    return V.append_chain(o, "ledger", "sequence", "record")


@query()
def v1_verify_chain(spark, d):
    """Links of a chain in which every 97th record was altered after it was written."""
    broken = chain(spark, d).withColumn("record", F.when(F.col("sequence") % 97 == 0, F.concat("record", F.lit("!"))).otherwise(F.col("record")))
    return V.verify_chain(broken, "ledger", "sequence", "record").where("bad_record OR bad_chain")


@query("""WITH RECURSIVE o AS (SELECT o_custkey % 50 AS ledger, o_orderkey AS sequence, sha256(o_orderkey || '|' || o_orderstatus) AS h, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders),
c AS (SELECT ledger, sequence, h, i, sha256(repeat('0', 64) || h) AS chain FROM o WHERE i = 1 UNION ALL SELECT o.ledger, o.sequence, o.h, o.i, sha256(c.chain || o.h) FROM c JOIN o ON o.ledger = c.ledger AND o.i = c.i + 1)
SELECT ledger, sequence, h AS record_hash, chain AS chain_hash FROM c""")
def v2_append_chain(spark, d):
    return chain(spark, d).drop("record")


@query()
def v3_ledger_summary(spark, d):
    return fingerprint(chain(spark, d), ["ledger", "sequence", "chain_hash"])


@query("""SELECT l_orderkey AS claim, min(l_discount) AS weakest, count(DISTINCT l_suppkey) AS producers, sha256(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR))) AS digest FROM lineitem GROUP BY ALL""")
def v4_claim_digest(spark, d):
    return V.claim_digest(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "claim"), "claim", "l_partkey", "l_discount", "l_suppkey")


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice <= 1000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END) AS issues FROM orders WHERE o_totalprice <= 1000 OR o_orderstatus NOT IN ('O', 'F')""")
def v5_entry_rules(spark, d):
    rules = violations({"price": F.col("o_totalprice") <= 1000, "status": ~F.col("o_orderstatus").isin("O", "F")})
    return table(spark, d, "orders").select("o_orderkey", F.array_join(rules, ",").alias("issues")).where("issues <> ''")


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS lineage FROM customer""")
def v6_lineage_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.to_json(F.struct("c_custkey", "c_mktsegment")), 256).alias("lineage"))
