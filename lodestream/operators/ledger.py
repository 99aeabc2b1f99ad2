"""Hash-chained ledgers and evidence rules."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def append_chain(records: DataFrame, ledger: str, sequence: str, record: str) -> DataFrame:
    """(ledger, sequence, record, record_hash, chain_hash): each hash covers the one before. Parallel over ledgers.

    Ledgers are sorted streams, of which a task holds a batch and the last hash; records are hashed by Spark.
    """
    d = records.select(ledger, sequence, record, F.sha2(F.coalesce(F.col(record), F.lit("")), 256).alias("record_hash"))
    d = d.repartition(ledger).sortWithinPartitions(F.col(ledger).asc_nulls_first(), F.col(sequence).asc_nulls_last())
    kind = ", ".join(f"`{c}` {t}" for c, t in d.dtypes) + ", chain_hash string"

    def fold(batches):
        own, before, started = None, GENESIS, False
        for b in batches:
            chain = []
            for key, h in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not started or key != own:
                    own, before, started = key, GENESIS, True
                before = hashlib.sha256((before + h).encode()).hexdigest()
                chain.append(before)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chain, pa.string())], [*d_names, "chain_hash"])

    d_names = d.columns
    return d.mapInArrow(fold, kind)


def verify_chain(chain: DataFrame, ledger: str, sequence: str, record: str) -> DataFrame:
    """Broken links: each is checked by itself against the stored hash before it."""
    w = Window.partitionBy(ledger).orderBy(sequence)
    before = F.coalesce(F.lag("chain_hash").over(w), F.lit(GENESIS))
    gap = F.col(sequence) != F.lag(sequence).over(w) + 1
    d = chain.withColumn("bad_record", F.sha2(F.col(record), 256) != F.col("record_hash")).withColumn("bad_chain", F.sha2(F.concat(before, F.col("record_hash")), 256) != F.col("chain_hash")).withColumn("gap", F.coalesce(gap, F.lit(False)))
    return d.where("bad_record OR bad_chain OR gap").select(ledger, sequence, "bad_record", "bad_chain", "gap")


def claim_digest(df: DataFrame, claim: str, item: str, confidence: str, producer: str) -> DataFrame:
    return df.groupBy(claim).agg(F.min(confidence).alias("weakest"), F.count_distinct(producer).alias("producers"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), ","), 256).alias("digest"))
