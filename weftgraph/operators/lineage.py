"""Cuts in the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='weft-shared-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written in columns to the shared folder and read back: for large tables that are read more than once, or in part."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's checkpoint folder and read back; only where none is named and Spark runs in this
    one process, as in tests, a temporary one is set. On a cluster a folder of one machine would lose rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def cut_telling(df: DataFrame, total: Column) -> tuple[DataFrame, int]:
    """cut(df) and a total over its rows, taken as they are written."""
    seen = Observation()
    out = cut(df.observe(seen, total.alias("total")))
    return out, seen.get["total"] or 0
