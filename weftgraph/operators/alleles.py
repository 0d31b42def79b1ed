"""Alleles of bubbles over samples: merging, frequencies and recoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allele_numbers(calls: DataFrame, bubble: list[str]) -> DataFrame:
    """Each bubble's walks from the most frequent on, ties by first sample: (bubble..., walk, n, first, allele)."""
    counts = calls.where("walk IS NOT NULL").groupBy(*bubble, "walk").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("first"), F.min_by("length", "sample").alias("length"))
    return counts.withColumn("allele", F.row_number().over(Window.partitionBy(*bubble).orderBy(F.desc("n"), "first", "walk")) - 1)


def merge_alleles(calls: DataFrame, bubble: list[str]) -> DataFrame:
    """One row for each bubble: NS samples called, NA alleles, AC, ALEN and AWALK in order of the alleles, and GT,
    the allele of each sample in order ('.' for no call)."""
    alleles = allele_numbers(calls, bubble)
    summed = alleles.groupBy(*bubble).agg(F.sum("n").alias("ns"), F.count(F.lit(1)).alias("na"), F.sort_array(F.collect_list(F.struct("allele", "n", "length", "walk"))).alias("_a"))
    listed = lambda c: F.array_join(F.transform("_a", lambda x: x[c].cast("string")), ",")
    gts = calls.join(alleles.select(*bubble, "walk", "allele"), [*bubble, "walk"], "left").groupBy(*bubble).agg(F.sort_array(F.collect_list(F.struct("sample", F.coalesce(F.col("allele").cast("string"), F.lit(".")).alias("gt")))).alias("_g"))
    return summed.join(gts, bubble, "right").select(*bubble, F.coalesce("ns", F.lit(0)).alias("ns"), F.coalesce("na", F.lit(0)).alias("na"), F.coalesce(listed("n"), F.lit("")).alias("ac"), F.coalesce(listed("length"), F.lit("")).alias("alen"), F.coalesce(listed("walk"), F.lit("")).alias("awalk"), F.array_join(F.transform("_g", lambda x: x["gt"]), ",").alias("gt"))


def recode(numbers: Column, reference: Column, most: int) -> Column:
    """Allele numbers so that the reference sample's becomes 0, those before it move up by one, and numbers over
    `most` become `most`; null stays."""
    own = F.when(numbers == reference, F.lit(0)).when(numbers < reference, numbers + 1).otherwise(numbers)
    return F.least(own, F.lit(most))


def segment_frequency(alleles: DataFrame, bubble: list[str], separator: str) -> DataFrame:
    """How many samples of a bubble pass each segment of its walks: (bubble..., seg, n)."""
    parts = alleles.select(*bubble, "n", F.explode(F.array_distinct(F.split("walk", separator))).alias("seg"))
    return parts.where("seg <> ''").groupBy(*bubble, "seg").agg(F.sum("n").alias("n"))


def transitions(steps: DataFrame, walk: list[str], order: str, stem: str) -> DataFrame:
    """The stretches of a walk between two stem steps with other steps between: (walk..., src, sink, n_inner)."""
    by = Window.partitionBy(*walk).orderBy(order)
    numbered = steps.withColumn("_i", F.row_number().over(by))
    stems = numbered.where(stem)
    by = Window.partitionBy(*walk).orderBy("_i")
    near = stems.select(*walk, F.lag(order).over(by).alias("src"), F.col(order).alias("sink"), (F.col("_i") - F.lag("_i").over(by) - 1).alias("n_inner"))
    return near.where("n_inner > 0")


def last_wins(calls: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of several calls of one bubble the last in order."""
    return calls.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).where("_r = 1").drop("_r")


def best_labels(lengths: DataFrame, key: list[str], total: str, high: float, low: float) -> DataFrame:
    """Each key's label with the largest covered length: the label from a share of `high` on, 'mixed' from `low` on
    if a second one comes near half of it, else 'none'. lengths: (key..., label, covered, total)."""
    order = Window.partitionBy(*key).orderBy(F.desc("covered"), "label")
    ranked = lengths.withColumn("_r", F.row_number().over(order))
    two = ranked.where("_r <= 2").groupBy(*key).agg(F.max(F.when(F.col("_r") == 1, F.col("label"))).alias("label"), F.max(F.when(F.col("_r") == 1, F.col("covered"))).alias("first"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("covered"))), F.lit(0)).alias("second"), F.max(total).alias("total"))
    verdict = F.when(F.col("first") >= F.col("total") * high, F.col("label")).when((F.col("first") >= F.col("total") * low) & (F.col("second") * 2 >= F.col("first")), F.lit("mixed")).when(F.col("first") >= F.col("total") * low, F.col("label")).otherwise(F.lit("none"))
    return two.withColumn("verdict", verdict)
