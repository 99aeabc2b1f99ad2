"""Token-id store: one shared zstandard dictionary, a frame for each document, an offset index for short access.

Format (a folder): ``dictionary`` holds the dictionary's bytes and its hash; ``blocks`` holds one row for each block of
documents in ascending doc_id order - block bounds, the dictionary hash, a payload of concatenated frames, and the
block's index: ids of the documents, byte offsets of their frames (one more than documents), their token counts, and the
tokens of its slice before it; ``slices`` holds the tokens before each slice, one row for each writing task.
A frame is the document's ids, serialised as little-endian unsigned 16-bit integers where the vocabulary fits, else
32-bit, compressed by itself with the dictionary.  So one document is read from its block's index and one frame.

The dictionary is trained on ids of a bounded sample (``fit_docs`` documents of up to ``fit_bytes`` bytes with the
smallest hash of their id); a sample too small to train on is the dictionary itself (raw content).  Every document is
encoded whole.  Defined results: a null text is an empty one and has the end id only; repeated doc_ids stay, as separate
frames ordered by a hash of their ids, then by frame; rows without doc_id come first, in the same order; an id that many
rows share is dealt over several slices; an empty table gives an empty store; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import groups, new_path, written
from .tokens import encoded

END_ID = 1


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def train_dictionary(texts: list[str | None], path: str, glued: bool, end_id: int, width: str, size: int = 64 << 10) -> bytes:
    """Dictionary over the serialised ids of the sample's documents; their last bytes, where they are too few to train on."""
    rows = [np.append(ids, end_id).astype(width).tobytes() for _, ids in encoded(texts, path, glued)]
    if sum(map(len, rows)) < 4 * size or len(rows) < 50:
        return b"".join(rows)[-size:]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:
        return b"".join(rows)[-size:]


def _codec(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None  # trained or raw: its first bytes tell
    return {"dict_data": d} if d else {}


def write_store(docs: DataFrame, to: str, path: str, glued: bool = False, end_id: int = END_ID, vocabulary: int = 49_408, fit_docs: int = 2000, fit_bytes: int = 100_000, block_bytes: int = 1 << 20, level: int = 3) -> str:
    """Write ``docs`` (doc_id, text) as a store into folder ``to``; returns the dictionary's hash."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = _width(vocabulary)
    fit = docs.where(F.octet_length("text") <= fit_bytes).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    fit_ids = [r[0] for r in fit.collect()]  # at most fit_docs numbers
    sample = docs.where(F.col("doc_id").isin(fit_ids)).where(F.octet_length("text") <= fit_bytes).select("text").limit(fit_docs)
    dictionary = train_dictionary([r[0] for r in sample.collect()], path, glued, end_id, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{to}/dictionary")

    # Bounds of ascending slices, from the id column alone: one number for each writing task; a bound met twice is a hot id.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    cuts = np.array(sorted(found or []), np.int64)

    def pack(batches):
        comp = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False, **_codec(dictionary))
        for b in batches:
            ids = b.column(0)
            frames, n, tie = [], np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, x in encoded(b.column(1).to_pylist(), path, glued):
                raw = np.append(x, end_id).astype(width).tobytes()
                n[i], tie[i] = len(x) + 1, zlib.crc32(raw)
                frames.append(comp.compress(raw))
            own = ids.fill_null(0).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(cuts, own, "left"), np.searchsorted(cuts, own, "right")
            # rows of an id that is several bounds, and rows without id, are dealt by their hash in ascending order
            slices = np.where(last - first > 1, first + (tie * (last - first + 1) >> 32), last)
            slices = np.where(ids.is_null().to_numpy(zero_copy_only=False), (tie * parts >> 32) - parts, slices)
            yield pa.RecordBatch.from_arrays([pa.array(slices), ids, pa.array(tie), pa.array(n), pa.array(frames, pa.binary())], ["slice", "doc_id", "tie", "n_tokens", "frame"])

    frames = docs.mapInArrow(pack, "slice long, doc_id long, tie long, n_tokens long, frame binary")
    frames = frames.repartition(parts, "slice").sortWithinPartitions("slice", "doc_id", "tie", "frame").drop("tie")

    def block(batches):
        def row(slice_no, nth, before, ids, n, held):
            offsets = np.append(0, np.cumsum([len(f) for f in held])).astype("<i8")
            return {"slice": slice_no, "block": nth, "before": before, "first_doc": ids[0], "last_doc": ids[-1], "n_docs": len(ids), "n_null": sum(i is None for i in ids), "n_tokens": int(sum(n)), "doc_ids": np.array([0 if i is None else i for i in ids], "<i8").tobytes(), "offsets": offsets.tobytes(), "counts": np.array(n, "<i8").tobytes(), "payload": b"".join(held), "dictionary_hash": digest}

        at, nth, before, ids, n, held, size = None, 0, 0, [], [], [], 0
        for b in batches:
            for s, i, k, f in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if ids and (s != at or size >= block_bytes):
                    yield pa.RecordBatch.from_pylist([row(at, nth, before, ids, n, held)], schema=BLOCK_ARROW)
                    nth, before = (nth + 1, before + sum(n)) if s == at else (0, 0)
                    ids, n, held, size = [], [], [], 0
                at = s
                ids.append(i)
                n.append(k)
                held.append(f)
                size += len(f)
        if ids:
            yield pa.RecordBatch.from_pylist([row(at, nth, before, ids, n, held)], schema=BLOCK_ARROW)

    frames.mapInArrow(block, BLOCK).write.option("compression", "uncompressed").parquet(f"{to}/blocks")
    sizes = spark.read.schema(BLOCK).parquet(f"{to}/blocks").groupBy("slice").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 2 rows for each writing task at most
    sizes.select("slice", (F.sum("n").over(w) - F.col("n")).alias("start")).coalesce(1).write.parquet(f"{to}/slices")
    return digest


BLOCK = "slice long, block long, before long, first_doc long, last_doc long, n_docs long, n_null long, n_tokens long, doc_ids binary, offsets binary, counts binary, payload binary, dictionary_hash string"
BLOCK_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]]) for c in BLOCK.split(", ")])


def _open(spark: SparkSession, store: str) -> tuple[DataFrame, bytes, str]:
    d = spark.read.parquet(f"{store}/dictionary").first()
    if hashlib.sha256(bytes(d["dictionary"])).hexdigest() != d["hash"]:
        raise ValueError("the dictionary does not have its hash")
    # A row for each writing task, so it is broadcast.
    slices = spark.read.schema("slice long, start long").parquet(f"{store}/slices")
    blocks = spark.read.schema(BLOCK).parquet(f"{store}/blocks").join(F.broadcast(slices), "slice")
    return blocks.withColumn("start", F.col("start") + F.col("before")), bytes(d["dictionary"]), d["hash"]


def _documents(blocks: DataFrame, dictionary: bytes, digest: str, width: str, digest_only: bool, wanted: list[int] | None = None) -> DataFrame:
    def read(batches):
        dec = zstandard.ZstdDecompressor(**_codec(dictionary))
        for b in batches:
            for r in b.to_pylist():
                if r["dictionary_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                ids, off, n = (np.frombuffer(r[c], "<i8") for c in ("doc_ids", "offsets", "counts"))
                start = r["start"] + np.cumsum(n) - n
                empty = r["n_null"]  # rows without id stand first
                rows = range(len(ids)) if wanted is None else empty + np.flatnonzero(np.isin(ids[empty:], wanted))
                out = []
                for i in rows:
                    x = np.frombuffer(dec.decompress(r["payload"][off[i] : off[i + 1]]), width).astype("<u4")
                    out.append((None if i < empty else int(ids[i]), int(start[i]), len(x), zlib.crc32(x.tobytes()), None if digest_only else x.astype(np.int64)))
                cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
                arrays = [pa.array(list(c), pa.int64()) for c in cols[:4]]
                if not digest_only:
                    arrays.append(pa.array(list(cols[4]), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    cols = ["start", "dictionary_hash", "n_null", "doc_ids", "offsets", "counts", "payload"]
    return blocks.select(*cols).mapInArrow(read, kind)


def read_store(spark: SparkSession, store: str, digest_only: bool = False, vocabulary: int = 49_408) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document."""
    blocks, dictionary, digest = _open(spark, store)
    return _documents(blocks, dictionary, digest, _width(vocabulary), digest_only)


def lookup(spark: SparkSession, store: str, doc_ids: list[int], vocabulary: int = 49_408) -> DataFrame:
    """A few documents: only blocks whose bounds hold one are read, and only their own frames are decompressed."""
    blocks, dictionary, digest = _open(spark, store)
    hit = F.lit(False)
    for i in doc_ids:
        hit |= (F.coalesce("first_doc", F.lit(-(1 << 63))) <= i) & (F.col("last_doc") >= i)
    return _documents(blocks.where(hit), dictionary, digest, _width(vocabulary), False, list(doc_ids))


def op2_token_store(spark, sf_dir):
    import public_tokenizers

    store = new_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), store, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, store, digest_only=True)
