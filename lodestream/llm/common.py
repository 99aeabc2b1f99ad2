"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="spark-lodestream-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestream/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as a table into the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def held(key, make):
    """A large table that a worker process keeps between tasks. There is one at a time: another key lets the last one go."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool, then the C library's heap, where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let_go() -> None:
    """Give back the table that this worker process keeps; work that needs memory of its own begins with it."""
    _HELD.clear()
    give_back()


def slim(work):
    """``work`` on batches, after which an idle worker process is no larger than what it keeps."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if a.null_count:
        a = a.fill_null("")
    a = a.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes together; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key after the other, from a partition sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), b.num_rows]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if held and k[i] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = k[i]
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False, base: int = BASE) -> np.ndarray:
    """base**i modulo 2**64 for i < n, or of its inverse."""
    got = _POWERS.get((base, inverse))
    if got is None or len(got) < n:
        b = pow(base, -1, 1 << 64) if inverse else base
        size = 1 << max(21, int(n - 1).bit_length())
        out = np.ones(size, np.uint64)
        have = 1
        while have < size:
            step = np.uint64(pow(b, have, 1 << 64))
            out[have : 2 * have] = out[:have] * step
            have *= 2
        _POWERS[(base, inverse)] = got = out
    return got[:n]


#: A fixed random number for each byte value.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
SECOND_BASE = 0xD1342543DE82EF95 | 1


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """n + 1 prefix sums of byte codes times powers: a substring's name is a difference of two, shifted."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data), base=base), out=out[1:])
    return out


def names(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Names of the substrings [start, end), equal for equal strings."""
    inv = powers(len(prefix), True, base)
    length = (np.asarray(end) - np.asarray(start)).astype(np.uint64)
    return mix((prefix[end] - prefix[start]) * inv[start] + length * M2)
