"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text.  The ledger is a Parquet table of
(blob, scanned: rules with their versions, found: spans by rule).  A commit takes the versions that came in, keeps one
text of each blob (summed up in each task before the shuffle, so copies do not meet in one task), leaves out what the
ledger holds, and scans each remaining blob by those rules only whose version it has not been scanned with.  Findings go
back to all paths by a join on the blob, which Spark may split where one blob is hot.

A commit is one append: readers see it when Spark has moved its files into place.  A job that died leaves nothing that
is read, and runs again; pairs that two jobs scanned at once are the same and count once.

Rules: a kind, a version, a pattern and the least length of its match or of one group.  Matches are taken from left to
right without overlap, and those that are too short are dropped afterwards, so a short match still covers its text.
``BASE`` are the three kinds every result counts; ``ADDED`` finds private keys, prefixed tokens, passwords in URLs and
bearer tokens beside them.

Defined results: a null text is the empty blob, which has no findings; rows without path or that repeat one are versions
of their own and all come back; an empty table gives no rows; other columns, whatever their names, are left out; positions
count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0


BASE = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 16),  # a run of 16 and more is the run that a plain + would find
)
ADDED = (
    Rule("private", 1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0),
    Rule("prefixed", 1, r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_)[A-Za-z0-9_-]+", 20),
    Rule("url", 1, r"://[^\s/:@]{1,100}:([^\s/:@]+)@", 6, 1),
    Rule("bearer", 1, r"Bearer\x20+([A-Za-z0-9+/_.=~-]+)", 20, 1),
)
RULES = BASE + ADDED
SCAN = "blob binary, scanned array<struct<kind:string,version:int>>, found array<struct<kind:string,version:int,start:int,end:int>>"
PLACES = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
PAIRS = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32())]))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def hits(rule: Rule, find, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in find(text) if len(m[rule.group]) >= rule.least]


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs: (blob, text, pending: indexes of rules).  A row for each blob, with findings or without."""

    def work(batches):
        finders = [re.compile(r.pattern).finditer for r in rules]
        for b in batches:
            scanned, found = [], []
            for text, pending in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = [rules[i] for i in pending]
                scanned.append([{"kind": r.kind, "version": r.version} for r in own])
                found.append([{"kind": r.kind, "version": r.version, "start": s, "end": e} for i, r in zip(pending, own, strict=True) for s, e in hits(r, finders[i], text)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scanned, PAIRS), pa.array(found, PLACES)], ["blob", "scanned", "found"])

    return blobs.mapInArrow(work, SCAN)


class Ledger:
    """Scans of blobs, kept as a Parquet table in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """Every scan so far; an empty table before the first commit."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], SCAN)
        return self.spark.read.schema(SCAN).parquet(self.path)

    def unseen(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, text, pending): one text of each blob that some rule has not seen in its present version."""
        t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        blobs = versions.select(blob_of(t).alias("blob"), t.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        seen = self.read().select("blob", F.explode("scanned").alias("s")).groupBy("blob").agg(F.collect_set("s").alias("seen"))  # at most rules x versions
        due = F.array(*[F.when(F.col("seen").isNull() | ~F.array_contains("seen", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).cast("int").alias("version"))), F.lit(i)) for i, r in enumerate(rules)])
        return blobs.join(seen, "blob", "left").select("blob", "text", F.array_compact(due).alias("pending")).where("size(pending) > 0")

    def commit(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what ``versions`` bring that the ledger has not seen."""
        scan(self.unseen(versions, text, rules), rules).write.mode("append").option("compression", "zstd").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, found: array of start, kind's place in the list, end, kind) of the blobs with findings, by start."""
        place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
        one = self.read().where("size(found) > 0").select("blob", F.explode("found").alias("f")).select("blob", F.col("f.start").alias("start"), F.try_element_at(place, F.concat_ws(":", "f.kind", "f.version")).alias("nth"), F.col("f.end").alias("end"), F.col("f.kind").alias("kind"))
        # collect_set: pairs that were scanned twice count once; it holds the findings of one text
        return one.where("nth IS NOT NULL").groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "nth", "end", "kind"))).alias("found"))

    def paths(self, versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(path, blob, found) of every version; ``found`` is null where there is nothing."""
        own = versions.select(F.col(f"`{path}`").alias("path"), blob_of(F.col(f"`{text}`")).alias("blob"))
        return own.join(self.findings(rules), "blob", "left").select("path", "blob", "found")


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op12_secret_ledger(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ledger = Ledger(spark, new_path(spark, "secret-ledger"))
    ledger.commit(docs)
    base = F.filter("found", lambda s: s["nth"] < len(BASE))
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda s: s["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    texts = ledger.findings().select("blob", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
    own = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    out = own.join(texts, "blob", "left")
    none = {f"n_{r.kind}": F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")) for r in BASE} | {"base_sha256": F.coalesce("base_sha256", F.sha2(F.lit(""), 256)), "spans": F.coalesce("spans", F.lit(""))}
    return out.withColumns(none).select("doc_id", *none)
