"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's rows as Parquet into the shared folder and reads them for the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import jaccard, mixing, packing, suffix, toxicity
from lodestream.llm.common import written


#: Rows in a batch for Python, most of which are whole documents; the default of 10,000 is 33 MB of usual ones.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def carried(docs: DataFrame) -> DataFrame:
    """(row, text): every column but the text in one struct, so that no name of theirs meets one of an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def released(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, in their order; ``changed`` replaces some of them."""
    return rows.select(*[F.col("text") if c == "text" else changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go; it learns from all rows of ``labels``.

    A null text counts as empty and stays; without labels, or in an empty table, nothing goes; rows without doc_id or that
    repeat one are scored like others; columns of any name come through unchanged.
    """
    small_batches(spark)
    model, scorer = toxicity.learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return released(toxicity.score(carried(docs), model, scorer).where("predicted = 0"), docs)


def keyed(docs: DataFrame) -> DataFrame:
    """(row, text, row_key) of ``docs``; the key is another number for every row: its doc_id, where no other row has that one.

    Rows without doc_id, or that repeat one, get a hash of the whole row and the copy's number; equal rows are counted
    before they are numbered, so no task gets all copies of a row.
    """
    rows, own_id = carried(docs), F.col("row.doc_id").cast("long")
    repeated = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    if not (docs.where("doc_id IS NULL").limit(1).count() or repeated.limit(1).count()):
        return rows.withColumn("row_key", own_id)
    marked = rows.join(repeated, own_id == F.col("again"), "left")
    odd = own_id.isNull() | F.col("again").isNotNull()
    single = marked.where(~odd).select("row", "text", own_id.alias("row_key"))
    copies = marked.where(odd).groupBy("row", "text").agg(F.count("*").alias("copies"))
    copies = copies.select("row", "text", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    # nulls are skipped by the hash, so their places go into it
    fields = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    several = copies.select("row", "text", F.xxhash64(*fields, *[f.isNull() for f in fields], "copy").alias("row_key"))
    return written(single.union(several), "keyed")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join one row stays: that of the smallest doc_id, rows without doc_id coming last.

    Every row counts as a document of its own. Texts without words are linked with nothing; of those only rows that
    repeat a doc_id are one class. An empty table stays empty; columns of any name come through unchanged.
    """
    small_batches(spark)
    rows = keyed(docs)
    found = jaccard.jaccard_components(rows.select(F.col("row_key").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("row_key"), "n_shingles", "component_id")
    ids = rows.select("row_key", F.col("row.doc_id").cast("long").alias("id"))
    found = written(found.join(ids, "row_key").select("row_key", "id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.coalesce("id", "row_key")).alias("class")), "near-classes")
    stays = found.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row_key"))["row_key"].alias("row_key"))
    goes = found.select("row_key").join(stays.select("row_key"), "row_key", "left_anti")
    return released(rows.join(goes, "row_key", "left_anti"), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; a document of which nothing is left goes too.

    A null text becomes the empty one and stays; rows without doc_id, and rows that repeat one, are judged by their texts;
    ``n_chars`` follows the text where something went; an empty table stays empty; other columns come through unchanged.
    """
    small_batches(spark)
    rows = carried(docs).select("row", "text", F.col("row.doc_id").alias("doc_id"))
    out = suffix.remove_repeats(rows, keep_text=True).where("n_removed = 0 OR n_removed < n_bytes")
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return released(out, docs, **changed)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, shared out by the target weights, each document at most once.

    A null text has no tokens; rows without lang or source form the leaf "(none)"; every row, also one without doc_id or
    that repeats another, is a document of its own; an empty table stays empty; columns of any name come through unchanged.
    """
    rows = keyed(docs)
    sources = rows.select(F.col("row_key").alias("doc_id"), "text", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"))
    taken = mixing.mix_sources(sources, share=0.8, max_epochs=1).select(F.col("doc_id").alias("row_key"))
    return released(rows.join(taken, "row_key", "left_semi"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences; of a null text the end mark alone. Only doc_id and text are looked at; rows without
    doc_id or that repeat one are packed like others; an empty table gives no rows."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), most=250_000, room=1_000_000))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_near_duplicates), ("repeated_passages", cut_repeats), ("mixing", mix), ("packing", pack)]

#: The first stage is a learned model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
