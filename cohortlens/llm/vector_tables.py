"""Vectors as packed bytes, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(vector: list | None) -> np.ndarray | None:
    """The components as doubles; None for a null or empty vector, or one with null or non-finite components."""
    if not vector or None in vector:
        return None
    out = np.asarray(vector, dtype=np.float64) + 0.0  # no negative zeros
    return out if np.isfinite(out).all() else None


def packed(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Columns key and vec: the doubles of each vector one after another; null where it is not usable."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (usable(v.as_py()) for v in batch.column(1))
            data = [None if v is None else v.tobytes() for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["key", "vec"])

    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(column).cast("array<double>").alias("vector"))
    return rows.mapInArrow(pack, "key bigint, vec binary")


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Packed vectors of one width as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)
