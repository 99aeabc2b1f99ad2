"""Reading vectors as numpy blocks; which vectors take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, drop_zero: bool) -> DataFrame:
    """(id, v array<double>) of the vectors without null or non-finite components; empty vectors never take part."""
    v = F.col(vec_col).cast("array<double>")
    bad: Column = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))
    if drop_zero:
        ok &= F.exists(v, lambda x: x != 0)
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """n x d doubles of a list column whose rows have one length."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    n = len(a)
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))
