"""Best-fit packing with certified bounds and repacking.

Documents become token pieces of at most ``capacity``; only longer documents are cut, the first piece being the
shorter one.  Pieces are dealt to partitions by a hash and each partition is packed by best-fit decreasing.  A lower
bound by dual-feasible functions certifies the partition's number of bins.  Partitions with a gap between bins and
bound give up their bins that are not full, exchange those pieces by a new hash into fewer partitions and are packed
anew, for ``rounds`` rounds; a partition without a gap keeps its packing.  The bins of an exchange are counted before
and after: a repacking that does not need fewer bins is dropped, and the earlier packing stays.

Pieces are numbered when they are written, and the hash is one of those numbers, so equal rows spread as others do.
Defined results: a null text is an empty document (its end id only); repeated doc_ids are separate documents; a null
doc_id stays null; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import bisect
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import PIECES, ROOM, encoded

END_ID = 2


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = END_ID, glued: bool = True, most: int = PIECES, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; ``most`` and ``room`` bound a worker's memory."""

    def cut(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            rows: list[tuple] = []
            for i, x in encoded(b.column(1).to_pylist(), path, glued, most=most, room=room):
                x = np.append(x, end_id).astype("<u4")
                first = len(x) % capacity or capacity
                ends = np.arange(first, len(x) + 1, capacity)
                for p, e in enumerate(ends):
                    s = 0 if p == 0 else int(ends[p - 1])
                    rows.append((ids[i], p, s, int(e) - s, zlib.crc32(x[s:e].tobytes())))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, PIECE_TYPES, strict=True)], PIECE_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item: the longest first, each into the fullest bin that still takes it."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms: list[int] = []  # sorted rooms that have a bin
    n = 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        k = bisect.bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = stacks[room].pop()
            if not stacks[room]:
                rooms.pop(k)
        else:
            room, b, n = capacity, n, n + 1
        bin_of[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            if not stacks[left]:
                bisect.insort(rooms, left)
            stacks[left].append(b)
    return bin_of, offset, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of dual-feasible functions: f sums to at most 1 over a bin, so the sum over all items bounds the bins.

    The family: items above capacity - t count 1, those below t count 0, those between count their share (Martello and
    Toth); and the rounded staircase floor((k + 1) x) / k (Fekete and Schepers), for each t and k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    total = np.cumsum(count * size)
    above = np.cumsum(count[::-1])[::-1]
    best = -(-int(total[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        large = int(above[capacity - t + 1])
        middle = int(total[capacity - t] - total[t - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 64):
        x = (k + 1) * size
        f = np.where(x % capacity == 0, size * k, (x // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((f * count).sum()) // (k * capacity)))
    return best


PACKED = "row long, length long, part long, bin long, offset long, gap long"


def _pack(rows: DataFrame, capacity: int) -> DataFrame:
    def work(t: pa.Table) -> pa.Table:
        size = t.column("length").to_numpy().astype(np.int64)
        bins, offset, n = best_fit_decreasing(size, capacity)
        gap = np.full(len(size), n - lower_bound(size, capacity))
        return pa.table({"row": t.column("row"), "length": t.column("length"), "part": t.column("to"), "bin": bins, "offset": offset, "gap": gap})

    return rows.groupBy("to").applyInArrow(work, PACKED)


def pack(rows: DataFrame, capacity: int = 1024, part_rows: int = 50_000, rounds: int = 3) -> DataFrame:
    """Add sequence_id and offset to pieces. A task packs about ``part_rows`` of them, whatever the keys are."""
    rows = written(rows.select(*PIECE_NAMES, F.monotonically_increasing_id().alias("row")), "pieces")
    n = rows.count()
    todo, before = rows.select("row", "length"), None
    kept: list[DataFrame] = []
    for r in range(rounds + 1):
        parts = max(1, -(-n // part_rows))
        dealt = todo.select("row", "length", F.pmod(F.xxhash64("row", F.lit(r)), F.lit(parts)).cast("long").alias("to"))
        packed = written(_pack(dealt, capacity), f"packed{r}")
        packed = packed.select("row", "length", "offset", (F.lit(r).cast("long") * (1 << 58) + F.col("part") * (1 << 32) + F.col("bin")).alias("sequence_id"), "gap")
        if before is not None:
            earlier, bins = before
            if packed.select("sequence_id").distinct().count() >= bins:
                kept.append(earlier)
                break
        if r == rounds or parts == 1 or not n:
            kept.append(packed.select("row", "sequence_id", "offset"))
            break
        used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
        tagged = packed.join(used, "sequence_id").withColumn("again", (F.col("gap") > 0) & (F.col("used") < capacity))
        tagged = written(tagged.select("row", "length", "sequence_id", "offset", "again"), f"tagged{r}")
        kept.append(tagged.where("not again").select("row", "sequence_id", "offset"))
        todo = tagged.where("again")
        n = todo.count()
        if not n:
            break
        before = todo.select("row", "sequence_id", "offset"), todo.select("sequence_id").distinct().count()
    places = reduce(DataFrame.union, kept)
    return rows.join(places, "row").drop("row")


def certificate(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: sequences, tokens, and the bound by the tokens alone (for reports)."""
    return packed.agg(F.count_distinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens"), F.ceil(F.sum("length") / capacity).alias("bound"))


def op10_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
