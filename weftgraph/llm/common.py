"""Helpers that several operators of this folder share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that ends a word; bytes.split() cuts at just these.
SPACE = b" \t\n\x0b\x0c\r"
#: UTF-8 continuation bytes: a text's other bytes are as many as its code points.
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what spark.checkpoint.dir names; only where that is unset and Spark runs in this one process a
    temporary folder is made and set. On a cluster a folder of one machine would lose rows, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='weft-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back: a lineage cut that outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *left_out: str) -> list[str]:
    """The columns of df that pass through: those not named like a result column."""
    return [c for c in df.columns if c not in left_out]


def fields(df: DataFrame, names: list[str]) -> str:
    """The schema of some columns as text."""
    return ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in df.schema if f.name in names)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow that also takes column names with dots; run gets the columns by position."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


_owner: list = ["", None]


def claim(owner: str, clear) -> None:
    """Tells that an operator now fills its memory of words in this worker process; that of the operator before
    is dropped, so a worker that serves several operators in turn holds one of them."""
    if _owner[0] != owner:
        if _owner[1] is not None:
            _owner[1]()
        _owner[:] = [owner, clear]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunks(texts: list[bytes | None], most: int) -> list[slice]:
    """Runs of rows of about `most` bytes of text, one row at least."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= most:
            out.append(slice(start, i + 1))
            start, size = i + 1, 0
    if start < len(texts):
        out.append(slice(start, len(texts)))
    return out


def text_parts(column: pa.Array, most: int) -> Iterator[tuple[slice, list[bytes | None]]]:
    """The runs of rows that `chunks` makes, each with its texts; a batch's texts are not copied all at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        stop = min(int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most)) + 1, len(sizes))
        yield slice(start, stop), as_bytes(column.slice(start, stop - start))
        start = stop


def word_ids(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of all texts as ids in order of first appearance, words per text, and the words."""
    known: dict[bytes, int] = defaultdict(itertools.count().__next__)
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.split() if t else []
        counts[i] = len(words)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), counts, list(known)
