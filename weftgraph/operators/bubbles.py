"""Bubbles of a graph along its reference, by joins and windows.

A bubble is a stretch of a reference sequence between two segments that every walk through it passes, with
more than one way between them. On the reference line of a stable sequence each arc that leaves and comes back
spans a range of reference places; overlapping ranges, united, are the bubbles, and the reference vertices
between them are on every walk. Other segments are in a bubble if they can be reached from a place and reach a later
one off the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components, intervals
from .graph import vertices
from .lineage import cut
from .ordering import dense_numbers


def reference_line(segments: DataFrame) -> DataFrame:
    """(v, sn, place, so, len): the reference segments of each stable sequence in order, forward strand."""
    numbered = dense_numbers(segments.where("sr = 0 AND sn IS NOT NULL").select("sn", "so", "seg", "len"), ["sn", "so", "seg"], "_n")
    first = numbered.groupBy("sn").agg(F.min("_n").alias("_first"))
    return numbered.join(first, "sn").select((F.col("seg") * 2).alias("v"), "sn", (F.col("_n") - F.col("_first")).alias("place"), "so", "len")


def off_line(arcs: DataFrame, line: DataFrame) -> DataFrame:
    """(sn, v, a, b): vertices off the line with the first place that reaches them and the last place that they
    reach, both by walks off the line; only those with a before b, as a walk through them leads onward.

    Two numbers for each vertex and line, told on by a join a round until none changes, so cycles do no harm. The
    other strand of a line's vertex is on no such walk."""
    on = line.select("v", "sn", F.col("place").alias("p"))
    bare = arcs.select("v", "w").distinct()
    closed = on.select("v").unionByName(on.select((F.col("v") + 1).alias("v"))).distinct()
    inner = cut(bare.join(closed, "v", "left_anti").join(closed.withColumnRenamed("v", "w"), "w", "left_anti").select("v", "w"))

    def spread(start: DataFrame, steps: DataFrame, better) -> DataFrame:
        """Each vertex's best number; start: (sn, v, x), steps: (v, w)."""
        now = cut(start.groupBy("sn", "v").agg(better("x").alias("x")))
        front = now
        while not front.isEmpty():
            ahead = front.join(steps, "v").groupBy("sn", F.col("w").alias("v")).agg(better("x").alias("x"))
            both = now.select("sn", "v", "x", F.lit(False).alias("_new")).unionByName(ahead.withColumn("_new", F.lit(True)))
            now = cut(both.groupBy("sn", "v").agg(better("x").alias("x"), better(F.when(~F.col("_new"), F.col("x"))).alias("_old")))
            front = now.where("NOT x <=> _old").select("sn", "v", "x")
            now = now.select("sn", "v", "x")
        return now

    first = bare.join(on, "v").select("sn", F.col("w").alias("v"), F.col("p").alias("x")).join(closed, "v", "left_anti")
    last = bare.join(on.withColumnRenamed("v", "w"), "w").select("sn", "v", F.col("p").alias("x")).join(closed, "v", "left_anti")
    entry = spread(first, inner, F.min).withColumnRenamed("x", "a")
    exit_ = spread(last, inner.select(F.col("w").alias("v"), F.col("v").alias("w")), F.max).withColumnRenamed("x", "b")
    return entry.join(exit_, ["sn", "v"]).where("a < b")


def _inside(segments: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bubbles' ends (sn, st, en, source, sink, ss, se) and (sn, st, source, sink, v), all vertices of each."""
    line = cut(reference_line(segments))
    off = cut(off_line(arcs, line))
    on = line.select("sn", "v", F.col("place").alias("p"))
    jumps = arcs.select("v", "w").distinct().join(on.toDF("sn", "v", "a"), "v").join(on.toDF("_sn", "w", "b"), "w").where("sn = _sn AND b > a + 1")
    ways = jumps.select("sn", F.col("a").alias("st"), F.col("b").alias("en")).unionByName(off.select("sn", F.col("a").alias("st"), F.col("b").alias("en")))
    # neighbours that only touch share a vertex of every walk, so they are two bubbles
    spans = cut(intervals.union(ways.distinct(), ["sn"], 4096, touching=False).select("sn", "st", "en"))
    place = line.select("sn", "place", "v", "so", "len")
    ends = spans.join(place.toDF("sn", "st", "source", "_so", "_len"), ["sn", "st"]).join(place.toDF("sn", "en", "sink", "_to", "_tl"), ["sn", "en"])
    ends = cut(ends.select("sn", "st", "en", "source", "sink", (F.col("_so") + F.col("_len")).alias("ss"), F.col("_to").alias("se")))
    by_place = ends.select("sn", "st", "en", F.struct(F.col("st").alias("first"), "source", "sink").alias("_e"))
    at = place.select("sn", F.col("place").alias("st"), (F.col("place") + 1).alias("en"), "v")
    held = intervals.overlap_join(by_place.withColumn("en", F.col("en") + 1), at, ["sn"], 256)
    # a vertex off the line is in the bubble that holds its first step along the line
    step = off.select("sn", F.col("a").alias("st"), (F.col("a") + 1).alias("en"), "v")
    free = intervals.overlap_join(by_place, step, ["sn"], 256)
    every = held.select("sn", "_e", "v").unionByName(free.select("sn", "_e", "v"))
    return ends, cut(every.select("sn", F.col("_e.first").alias("st"), "_e.source", "_e.sink", "v").distinct())


def numbered(segments: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bubbles (bid, sn, ss, se, source, sink), bid rising along the reference, and all their vertices (bid, v)."""
    ends, inside = _inside(segments, arcs)
    found = cut(dense_numbers(ends, ["sn", "st"], "bid"))
    return found.select("bid", "sn", "ss", "se", "source", "sink"), inside.join(found.select("bid", "sn", "st"), ["sn", "st"]).select("bid", "v")


def _local_arcs(segments: DataFrame, arcs: DataFrame, inside: DataFrame) -> DataFrame:
    """(source, sink, v, w, len): arcs within a bubble; len is that of w, and 0 for the sink."""
    local = inside.select("source", "sink", "v").join(arcs.select("v", "w").distinct(), "v").join(inside.select("source", F.col("v").alias("w")), ["source", "w"]).where("v <> sink AND w <> source")
    size = segments.select(F.col("seg").alias("_s"), "len")
    return local.join(size, F.shiftright("w", 1) == F.col("_s")).select("source", "sink", "v", "w", F.when(F.col("w") == F.col("sink"), 0).otherwise(F.col("len")).cast("long").alias("len"))


def bubbles(segments: DataFrame, arcs: DataFrame) -> DataFrame:
    """(sn, ss, se, source, sink, n_seg, n_paths, len_min, len_max, is_inv): one row for each bubble. ss is the end of
    the source segment, se the start of the sink segment, lengths are of what stands between; is_inv tells that a
    segment is there on both strands. A bubble with a cycle inside has no end of paths: n_paths and lengths are null."""
    ends, inside = _inside(segments, arcs)
    size = inside.groupBy("sn", "st").agg(F.count(F.lit(1)).alias("n_seg"), (F.count(F.lit(1)) > F.count_distinct(F.shiftright("v", 1))).alias("is_inv"))
    local = _acyclic(_local_arcs(segments, arcs, inside))
    paths = _path_lengths(local, ends)
    return ends.join(size, ["sn", "st"]).join(paths, "source", "left").select("sn", "ss", "se", "source", "sink", "n_seg", "n_paths", "len_min", "len_max", "is_inv")


def _acyclic(local: DataFrame) -> DataFrame:
    """The arcs of bubbles without a cycle: arcs that nothing leads to or from go, again and again, and what is left
    tells the others."""
    keyed = cut(local)
    left = components.trim(keyed.select("source", "v", "w"), ["source"]).select("source").distinct()
    return keyed.join(left, "source", "left_anti")


def _path_lengths(local: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, n_paths, len_min, len_max) of the paths from source to sink inside each bubble; local has those without
    a cycle. Paths grow by an arc a round until none is left."""
    most = 2**31 - 1
    whole = ends.select("source", "sink").join(local.select("source").distinct(), "source", "left_semi")
    front = whole.select("source", "sink", F.col("source").alias("v"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    out = None
    while out is None or not front.isEmpty():
        grown = cut(front.join(local, ["source", "sink", "v"]).groupBy("source", "sink", F.col("w").alias("v")).agg(F.least(F.sum("n"), F.lit(most)).alias("n"), F.min(F.col("lo") + F.col("len")).alias("lo"), F.max(F.col("hi") + F.col("len")).alias("hi")))
        done = grown.where("v = sink").select("source", "n", "lo", "hi")
        # one row for each bubble, so that long paths leave no long plan
        every = done if out is None else out.unionByName(done)
        out = cut(every.groupBy("source").agg(F.least(F.sum("n"), F.lit(most)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        front = grown.where("v <> sink")
    return out.select("source", F.col("n").alias("n_paths"), F.col("lo").alias("len_min"), F.col("hi").alias("len_max"))


def shortest_and_longest(segments: DataFrame, arcs: DataFrame) -> DataFrame:
    """(source, sink, kind, path, seq): of each bubble without a cycle the shortest and the longest way between its ends,
    its vertices and their sequence ('' where nothing stands between); ties go to the smaller vertex, from the sink back.

    Distances rise or fall along arcs until none changes; the ways are then traced back from all sinks at once, a
    vertex a round."""
    ends, inside = _inside(segments, arcs)
    local = _acyclic(_local_arcs(segments, arcs, inside))
    spelled = []
    for kind, better, sign in (("shortest", F.min, 1), ("longest", F.max, -1)):
        now = cut(local.select("source").distinct().select("source", F.col("source").alias("v"), F.lit(0).cast("long").alias("d")))
        front = now
        while not front.isEmpty():
            ahead = front.join(local, ["source", "v"]).select("source", F.col("w").alias("v"), (F.col("d") + F.col("len")).alias("d"))
            both = now.withColumn("_old", F.col("d")).unionByName(ahead.withColumn("_old", F.lit(None).cast("long")))
            now = cut(both.groupBy("source", "v").agg(better("d").alias("d"), better("_old").alias("_old")))
            front = now.where("NOT d <=> _old").select("source", "v", "d")
            now = now.select("source", "v", "d")
        near = local.join(now.withColumnRenamed("d", "_a"), ["source", "v"]).join(now.select("source", F.col("v").alias("w"), F.col("d").alias("_b")), ["source", "w"]).where("_a + len = _b")
        before = cut(near.groupBy("source", F.col("w").alias("v")).agg(F.min("v").alias("u")))
        at = cut(local.select("source", "sink").distinct().select("source", "sink", F.col("sink").alias("v"), F.lit(0).alias("k")))
        passed = at.limit(0)
        while not at.isEmpty():
            at = cut(at.join(before, ["source", "v"]).where("u <> source").select("source", "sink", F.col("u").alias("v"), (F.col("k") + 1).alias("k")))
            passed = cut(passed.unionByName(at))
        seqs = vertices(segments).select("v", "seq")
        step = F.struct((-F.col("k")).alias("k"), F.concat(F.when(F.col("v") % 2 == 1, "<").otherwise(">"), F.shiftright("v", 1).cast("string")).alias("t"), "seq")
        told = passed.join(seqs, "v").groupBy("source").agg(F.array_sort(F.collect_list(step)).alias("_s"))
        text = lambda c: F.coalesce(F.array_join(F.transform("_s", lambda x: x[c]), ""), F.lit("")).alias("path" if c == "t" else c)
        spelled.append(local.select("source", "sink").distinct().join(told, "source", "left").select("source", "sink", F.lit(kind).alias("kind"), text("t"), text("seq")))
    return spelled[0].unionByName(spelled[1])


def attach_walks(steps: DataFrame, found: DataFrame) -> DataFrame:
    """What each walk takes between a bubble's ends: (walk, source, sink, path). steps: (walk, ord, v); a walk that
    passes a bubble twice keeps its last passage."""
    ends = found.select("source", "sink")
    a = steps.join(ends, steps["v"] == ends["source"]).select("walk", F.col("ord").alias("_a"), "source", "sink")
    b = steps.select(F.col("walk"), F.col("ord").alias("_b"), F.col("v").alias("sink"))
    near = a.join(b, ["walk", "sink"]).where("_b > _a").groupBy("walk", "source", "sink", "_a").agg(F.min("_b").alias("_b"))
    last = near.groupBy("walk", "source", "sink").agg(F.max(F.struct("_a", "_b")).alias("_s")).select("walk", "source", "sink", "_s.*")
    inner = last.join(steps.select("walk", "ord", F.col("v")), "walk").where("ord > _a AND ord < _b")
    text = F.concat(F.when(F.col("v") % 2 == 1, "<").otherwise(">"), F.shiftright("v", 1).cast("string"))
    spelled = inner.groupBy("walk", "source", "sink").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]), "").alias("path"))
    return last.select("walk", "source", "sink").join(spelled, ["walk", "source", "sink"], "left").withColumn("path", F.coalesce("path", F.lit("")))

