"""What a sample's chains take in each bubble."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def call_bubbles(steps: DataFrame, bubbles: DataFrame, inside: DataFrame, segments: DataFrame, on_segments: DataFrame, on_queries: DataFrame, width: int = 4096) -> DataFrame:
    """(bid, qid, walk, wlen, strand, qs, qe): for each bubble the last passage of a chain through it, '' for a walk without
    segments; bubbles that no chain passes have none.

    steps: (qid, chain, step, v, y_first, y_last, span), y being null on vertices without anchors; bubbles: (bid, source,
    sink), bid rising along the reference; inside: (bid, v), all vertices; on_segments and on_queries: intervals of good
    chains. A passage whose query part or one of whose segments another good chain covers is no ortholog."""
    seg = lambda v: F.shiftright(v, 1)
    stems = bubbles.select(seg("source").alias("seg"), F.lit(True).alias("_stem"), F.lit(1).alias("_src")).unionByName(bubbles.select(seg("sink").alias("seg"), F.lit(True).alias("_stem"), F.lit(0).alias("_src")))
    marks = inside.groupBy(seg("v").alias("seg")).agg(F.max("bid").alias("bid")).join(stems.groupBy("seg").agg(F.first("_stem").alias("_stem"), F.max("_src").alias("_src")), "seg", "left")
    chain = Window.partitionBy("qid", "chain").orderBy("step")
    rows = steps.withColumn("seg", seg("v")).join(marks, "seg", "left")
    rows = rows.withColumns({"_last": F.last("y_last", ignorenulls=True).over(chain), "_next": F.first("y_first", ignorenulls=True).over(chain.rowsBetween(0, Window.unboundedFollowing))})
    before = lambda c: F.lag(c).over(chain)
    at = rows.where("_stem").withColumns({"_a": before("step"), "_bid": before("bid"), "_was": before("_src"), "qs": before("_last") + 1, "qe": F.col("_next") + 1 - F.col("span")}).where("_a IS NOT NULL")
    folded = (F.col("_bid") == F.col("bid")) & (F.col("_was") + F.col("_src") != 1)
    forward = (F.col("_bid") < F.col("bid")) | ((F.col("_bid") == F.col("bid")) & (F.col("_was") == 1))
    # the source belongs to the next bubble too, so a passage forward is that of the stem it leaves
    passed = at.where(~folded).select("qid", "chain", "_a", F.col("step").alias("_b"), forward.alias("_forward"), F.when(forward, F.col("_bid")).otherwise(F.col("bid")).alias("bid"), "qs", "qe")
    asked = passed.select("qid", "chain", "_a", F.col("qs").alias("st"), F.col("qe").alias("en"))
    twice = intervals.overlap_join(asked, on_queries.select("qid", "st", "en"), ["qid"], width).groupBy("qid", "chain", "_a").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("qid", "chain", "_a")
    inner = passed.where("_b > _a + 1").select("qid", "chain", "_a", "bid", "_forward", F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)).alias("step")).join(rows.select("qid", "chain", "step", "v", "seg", F.col("bid").alias("_own")), ["qid", "chain", "step"])
    inner = inner.join(segments.select("seg", "name", "len"), "seg")
    crowded = on_segments.where("en > st").groupBy("seg").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("seg")
    bad = inner.where(~F.col("_own").eqNullSafe(F.col("bid"))).select("qid", "chain", "_a").unionByName(inner.join(crowded, "seg", "left_semi").select("qid", "chain", "_a")).unionByName(twice).distinct()
    text = F.concat(F.when((F.col("v") % 2 == 1) == F.col("_forward"), "<").otherwise(">"), "name")
    order = F.when(F.col("_forward"), F.col("step")).otherwise(-F.col("step"))
    walks = inner.groupBy("qid", "chain", "_a").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "").alias("walk"), F.sum("len").alias("wlen"))
    good = passed.join(bad, ["qid", "chain", "_a"], "left_anti").join(walks, ["qid", "chain", "_a"], "left")
    last = Window.partitionBy("bid").orderBy(F.desc("qid"), F.desc("chain"), F.desc("_a"))
    chosen = good.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    return chosen.select("bid", "qid", F.coalesce("walk", F.lit("")).alias("walk"), F.coalesce("wlen", F.lit(0)).alias("wlen"), F.when(F.col("_forward"), "+").otherwise("-").alias("strand"), "qs", "qe")
