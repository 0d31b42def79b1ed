"""Vectors in table columns: which take part, and their numpy forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(name: str) -> Column:
    return F.col(name).cast("array<double>")


def is_finite(name: str) -> Column:
    """Neither null nor holding a null or non-finite component; never null itself."""
    good = F.forall(doubles(name), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column and where each row's begin (one end more)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]


def matrix(cells: pa.Array, kind=np.float64) -> np.ndarray:
    """Binary cells of one length as the rows of a matrix."""
    joined = b"".join(x.as_buffer().to_pybytes() for x in cells)
    return np.frombuffer(joined, kind).reshape(len(cells), -1) if len(cells) else np.zeros((0, 0), kind)


def binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary cells."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())
