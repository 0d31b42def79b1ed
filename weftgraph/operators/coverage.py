"""Segment and link coverage by walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from .graph import SequenceGraph, flip
from .intervals import union_length


def traversals(steps: DataFrame, by: list[str], order: list[str] | None = None) -> DataFrame:
    """The arcs that walks take: steps (by..., ord, v) as (by..., v, w). `order` names other columns than ord that put a
    walk's steps in order, so that steps needn't be sorted to number them and then again."""
    return steps.withColumn("w", F.lead("v").over(Window.partitionBy(*by).orderBy(*(order or ["ord"])))).where("w IS NOT NULL").select(*by, "v", "w")


def depth(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """Summed covered length over length for each segment; steps: (seg, st, en)."""
    held = steps.groupBy("seg").agg(F.sum(F.col("en") - F.col("st")).alias("_c"))
    return segments.join(held, "seg", "left").select("seg", (F.coalesce("_c", F.lit(0)) / F.col("len")).alias("depth"))


def link_counts(steps: DataFrame, by: list[str], arcs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """How often walks take each arc, on either strand. An arc and its dual are counted under the smaller of the two; one
    that is its own dual counts for both strands."""
    dual = (flip("w") < F.col("v")) | ((flip("w") == F.col("v")) & (flip("v") < F.col("w")))
    keys = [F.when(dual, flip("w")).otherwise(F.col("v")).alias("_v"), F.when(dual, flip("v")).otherwise(F.col("w")).alias("_w")]
    counts = traversals(steps, by, order).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    asked = arcs.select("v", "w").distinct().select("v", "w", *keys)
    n = F.col("_n") * F.when(F.col("v") == flip("w"), 2).otherwise(1)
    return asked.join(counts, ["_v", "_w"], "left").select("v", "w", F.coalesce(n, F.lit(0)).alias("n"))


def breadth(steps: DataFrame, segments: DataFrame, sample: str, n_samples: int) -> DataFrame:
    """The part of each segment that a sample covers, averaged over all samples; steps: (sample, seg, st, en)."""
    held = union_length(steps, [sample, "seg"]).groupBy("seg").agg(F.sum("length").alias("_c"))
    return segments.join(held, "seg", "left").select("seg", (F.coalesce("_c", F.lit(0)) / F.col("len") / n_samples).alias("breadth"))


def link_use(steps: DataFrame, sample: str, by: list[str], n_samples: int, order: list[str] | None = None) -> DataFrame:
    """The share of samples that take each arc."""
    return traversals(steps, [sample, *by], order).groupBy("v", "w").agg((F.count_distinct(sample) / n_samples).alias("use"))


def write_tags(graph: SequenceGraph, tag: str, segs: DataFrame | None = None, links: DataFrame | None = None) -> SequenceGraph:
    """graph with coverage as a float tag: segs (seg, value) on segments, links (v, w, value) on arcs, of which those that
    complete a link's other strand stay as they are."""
    segments, arcs = graph.segments, graph.arcs
    text = F.round("_value", 6).cast("string")
    if segs is not None:
        segments = segments.join(segs.select("seg", F.col("value").alias("_value")), "seg", "left").withColumn("tags", F.when(F.col("_value").isNotNull(), tags.put(F.col("tags"), tag, "f", text)).otherwise(F.col("tags"))).drop("_value")
    if links is not None:
        own = F.col("_value").isNotNull() & ~F.col("comp")
        arcs = arcs.join(links.select("v", "w", F.col("value").alias("_value")), ["v", "w"], "left").withColumn("tags", F.when(own, tags.put(F.col("tags"), tag, "f", text)).otherwise(F.col("tags"))).drop("_value")
    return SequenceGraph(segments, arcs)
