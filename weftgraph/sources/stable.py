"""Paths of alignments in stable coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.repeats import walk_intervals
from .alignments import path_steps


def stable_runs(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., run, sn, rev, sr, st, en): neighbours that follow each other on one strand of a stable sequence, and
    are of one rank, merged. steps: (keys..., ord, sn, rev, sr, so, len)."""
    by = Window.partitionBy(*keys).orderBy("ord")
    before = F.lag(F.struct("sn", "rev", "sr", "so", "len")).over(by)
    same = (before["sn"] == F.col("sn")) & (before["rev"] == F.col("rev")) & (before["sr"] == F.col("sr"))
    joined = same & F.when(F.col("rev"), F.col("so") + F.col("len") == before["so"]).otherwise(F.col("so") == before["so"] + before["len"])
    runs = steps.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.any_value("sn").alias("sn"), F.any_value("rev").alias("rev"), F.any_value("sr").alias("sr"), F.min("so").alias("st"), F.max(F.col("so") + F.col("len")).alias("en"))


def stable_paths(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., path, plen, n_runs, sn, rev, st, unknown): the path's text, its length, its first run, and whether a step
    has no stable sequence."""
    text = F.concat(F.when(F.col("rev"), "<").otherwise(">"), "sn", F.lit(":"), F.col("st").cast("string"), F.lit("-"), F.col("en").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("run", text.alias("t"))))
    return stable_runs(steps, keys).groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda x: x["t"]), "").alias("path"), F.sum(F.col("en") - F.col("st")).alias("plen"), F.count(F.lit(1)).alias("n_runs"),
        F.min_by("sn", "run").alias("sn"), F.min_by("rev", "run").alias("rev"), F.min_by("st", "run").alias("st"), F.bool_or(F.col("sn").isNull()).alias("unknown"),
    )


def to_stable(alignments: DataFrame, segments: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Alignments on paths of segments in stable coordinates, and the keys of those that fail: a path with an
    unknown segment, or whose length isn't the stated one. A path of one run on a reference sequence becomes that
    sequence, with places along its forward strand.

    alignments: (key, strand, path, plen, ps, pe, ...); segments: (name, len, sn, so, sr)."""
    one = alignments.select(key, F.posexplode(path_steps(F.col("path"))).alias("ord", "_s"))
    steps = one.select(key, "ord", F.col("_s.rev").alias("rev"), F.col("_s.name").alias("name")).join(segments.select("name", "len", "sn", "so", "sr"), "name", "left")
    paths = stable_paths(steps, [key]).select(key, F.col("path").alias("_path"), F.col("plen").alias("_plen"), "n_runs", F.col("sn").alias("_sn"), F.col("rev").alias("_rev"), F.col("st").alias("_st"), F.col("unknown").alias("_unknown"))
    size = segments.where("sr = 0").groupBy(F.col("sn").alias("_sn")).agg(F.max(F.col("so") + F.col("len")).alias("_total"))
    # one row a key: what fails is told by a column, not by a join with the keys that fail
    fails = F.col("_unknown") | F.coalesce(F.col("_plen") != F.col("plen"), F.lit(False))
    known = alignments.join(paths, key).withColumn("_fails", fails)
    failed = known.where("_fails").select(key).distinct()
    rows = known.where("NOT _fails").join(size, "_sn", "left")
    whole = (F.col("n_runs") == 1) & F.col("_total").isNotNull()
    back = whole & F.col("_rev")
    start = F.when(back, F.col("_st") + F.col("plen") - 1 - F.col("pe")).when(whole, F.col("_st") + F.col("ps")).otherwise(F.col("ps"))
    end = F.when(back, F.col("_st") + F.col("plen") - 1 - F.col("ps")).when(whole, F.col("_st") + F.col("pe")).otherwise(F.col("pe"))
    new = {
        "strand": F.when(back, F.translate("strand", "+-", "-+")).otherwise(F.col("strand")), "path": F.when(whole, F.col("_sn")).otherwise(F.col("_path")),
        "plen": F.when(whole, F.col("_total")).otherwise(F.col("plen")), "ps": start, "pe": end,
    }
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in alignments.columns]), failed


def in_region(alignments: DataFrame, ctg: str, st: int, en: int) -> DataFrame:
    """Alignments on stable paths that touch a region. The first interval of a path begins at ps, the last ends at pe."""
    parts = walk_intervals(F.col("path"))
    before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0).cast("long"), lambda a, x: a + x["en"] - x["st"])
    clipped = F.transform(parts, lambda x, i: F.struct(x["name"].alias("name"), F.when(i == 0, x["st"] + F.col("ps")).otherwise(x["st"]).alias("st"), F.when(before(i + 1) == F.col("plen"), x["en"] - (F.col("plen") - F.col("pe"))).otherwise(x["en"]).alias("en")))
    own = F.array(F.struct(F.col("path").alias("name"), F.col("ps").alias("st"), F.col("pe").alias("en")))
    touched = F.when(F.col("path").rlike("^[><]"), clipped).otherwise(own)
    return alignments.where(F.exists(touched, lambda x: (x["name"] == ctg) & (x["en"] > st) & (x["st"] < en)))
