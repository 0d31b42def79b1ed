"""A graph that grows with each batch of a stream of insertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.augment import augment
from ..operators.graph import SequenceGraph
from ..plans.growing import GrowOptions, grow


def write_graph(graph: SequenceGraph, path: str, version: int) -> None:
    """One version of a graph; written again after a failure it replaces itself."""
    graph.segments.write.mode("overwrite").parquet(f"{path}/version={version}/segments")
    graph.arcs.write.mode("overwrite").parquet(f"{path}/version={version}/arcs")


def read_graph(spark: SparkSession, path: str, version: int) -> SequenceGraph:
    return SequenceGraph(spark.read.parquet(f"{path}/version={version}/segments"), spark.read.parquet(f"{path}/version={version}/arcs"))


def grow_stream(insertions: DataFrame, path: str, checkpoint: str):
    """Puts each micro-batch of insertions (ins, v0, off0, v1, off1, seq), whose vertices are those of the version before,
    into the graph: batch k makes version k + 1 of version k, so that samples are added in order and a batch that
    is run again starts from the same graph. Version 0 must be there."""

    def one(batch: DataFrame, number: int) -> None:
        graph = read_graph(batch.sparkSession, path, number)
        write_graph(augment(graph, batch), path, number + 1)

    return insertions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grow_from_sequences(samples: DataFrame, path: str, checkpoint: str, o: GrowOptions = GrowOptions()):
    """Puts each micro-batch of sequences (rid, name, seq), a sample, into the graph: its version is mapped to, what the
    sample adds is found and makes the next version, as in grow_stream. Version 0 must be there."""

    def one(batch: DataFrame, number: int) -> None:
        graph = read_graph(batch.sparkSession, path, number)
        write_graph(grow(graph, batch, o), path, number + 1)

    return samples.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
