"""Sequence graphs as two tables.

segments(seg, name, seq, len, sn, so, sr, tags) and arcs(v, w, ov, ow, rank, link, comp, tags), where a vertex
is twice its segment's number, plus one for the reverse strand; the dual of arc (v, w) is (w ^ 1, v ^ 1).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nt import hash32, reverse_complement
from .lineage import cut
from .ordering import dense_numbers


@dataclass(frozen=True)
class SequenceGraph:
    segments: DataFrame
    arcs: DataFrame


def flip(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).bitwiseXOR(F.lit(1).cast("long"))


def dual(arcs: DataFrame) -> DataFrame:
    """Each arc as seen from the other strand."""
    own = {"v": flip("w"), "w": flip("v"), "ov": F.col("ow"), "ow": F.col("ov")}
    return arcs.select(*[own.get(c, F.col(c)).alias(c) for c in arcs.columns])


def number_segments(rows: DataFrame, order: list[str]) -> DataFrame:
    """A gapless number for each name, by its first appearance in some order."""
    first = rows.groupBy("name").agg(F.min(F.struct(*order)).alias("_first"))
    return dense_numbers(first, ["_first", "name"], "seg").drop("_first")


def symmetric(arcs: DataFrame) -> DataFrame:
    """arcs with the missing duals added, the added ones marked comp; both strands share their link's number."""
    marked = arcs.drop("comp").withColumn("comp", F.lit(False))
    missing = dual(marked).join(marked.select("v", "w", "ov", "ow"), ["v", "w", "ov", "ow"], "left_anti").withColumn("comp", F.lit(True))
    both = marked.unionByName(missing)
    # where both were given, the one with the larger (v, w) is the complement of the other
    other = dual(marked.where((F.col("v") != flip("w")))).select("v", "w", "ov", "ow", F.col("link").alias("_link")).dropDuplicates(["v", "w", "ov", "ow"])
    given = both.join(other, ["v", "w", "ov", "ow"], "left")
    second = F.col("_link").isNotNull() & ((flip("w") < F.col("v")) | ((flip("w") == F.col("v")) & (flip("v") < F.col("w")))) & ~F.col("comp")
    return given.withColumns({"comp": F.col("comp") | second, "link": F.when(second, F.col("_link")).otherwise(F.col("link"))}).drop("_link")


def infer_overlaps(arcs: DataFrame) -> DataFrame:
    """A missing overlap (null) is taken from the dual arc; arcs whose dual isn't unique lose out and go."""
    known = dual(arcs).groupBy("v", "w").agg(F.count(F.lit(1)).alias("_n"), F.max("ov").alias("_ov"), F.max("ow").alias("_ow"))
    joined = arcs.join(known, ["v", "w"], "left")
    fill = joined.withColumns({"ov": F.coalesce("ov", F.when(F.col("_n") == 1, F.col("_ov"))), "ow": F.coalesce("ow", F.when(F.col("_n") == 1, F.col("_ow")))})
    return fill.where("ov IS NOT NULL AND ow IS NOT NULL").drop("_n", "_ov", "_ow")


def has_overlaps(arcs: DataFrame) -> bool:
    """Whether some arc has an overlap: such a graph can't be mapped to."""
    return not arcs.where("ov <> 0 OR ow <> 0").isEmpty()


def number_sequences(segments: DataFrame) -> DataFrame:
    """(sn, snid): a gapless number for each stable sequence, by the smallest segment on it."""
    first = segments.where("sn IS NOT NULL").groupBy("sn").agg(F.min("seg").alias("_first"))
    return dense_numbers(first, ["_first"], "snid").drop("_first")


def drop_dangling(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """The arcs both of whose segments exist and have a length."""
    live = segments.where("len > 0").select(F.col("seg").alias("_seg"))
    for end in ("v", "w"):
        arcs = arcs.join(live, F.shiftright(arcs[end], 1) == live["_seg"], "left_semi")
    return arcs


def clip_overlaps(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """Overlaps cut to their segments' lengths; lv is what of the first segment comes before the second."""
    size = segments.select(F.col("seg").alias("_seg"), F.col("len").alias("_len"))
    a = arcs.join(size, F.shiftright("v", 1) == F.col("_seg")).withColumn("ov", F.least("ov", "_len")).withColumn("lv", F.col("_len") - F.col("ov")).drop("_seg", "_len")
    return a.join(size, F.shiftright("w", 1) == F.col("_seg")).withColumn("ow", F.least("ow", "_len")).drop("_seg", "_len")


def multi_edges(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def single_edges(arcs: DataFrame) -> DataFrame:
    """Of parallel arcs the one with the lowest non-negative rank stays, then the lowest link; duals go along. Arcs from a
    vertex to its own complement are their own duals and stay as they are."""
    rank = F.when(F.col("rank") >= 0, F.col("rank")).otherwise(F.lit(2**31 - 1))
    own = F.struct(rank.alias("r"), F.col("link").alias("l"))
    # both strands of a link stand under one key, so they are decided together
    first, second = F.struct("v", "w"), F.struct(flip("w").alias("v"), flip("v").alias("w"))
    keyed = arcs.withColumn("_key", F.least(first, second)).withColumn("_own", own)
    best = keyed.groupBy("_key").agg(F.min("_own").alias("_best"))
    loop = F.col("w") == flip("v")
    kept = keyed.where(~loop).join(best, "_key").where("_own = _best").dropDuplicates(["v", "w"])
    return kept.drop("_key", "_own", "_best").unionByName(keyed.where(loop).drop("_key", "_own"))


def normalize(graph: SequenceGraph) -> SequenceGraph:
    """Dangling arcs out, missing overlaps filled, both strands present, overlaps clipped."""
    arcs = symmetric(infer_overlaps(drop_dangling(graph.arcs, graph.segments)))
    return SequenceGraph(graph.segments, clip_overlaps(arcs, graph.segments))


def stable_bounds(segments: DataFrame) -> DataFrame:
    """Extent and rank of each stable sequence, and whether its segments disagree on the rank."""
    return segments.where("sn IS NOT NULL").groupBy("sn").agg(
        F.min("so").alias("min"), F.max(F.col("so") + F.col("len")).alias("max"), F.min("sr").alias("rank"), (F.min("sr") != F.max("sr")).alias("conflict")
    )


def find_arcs(wanted: DataFrame, arcs: DataFrame) -> DataFrame:
    """wanted (v, w) with the link of the arc: -1 where there is none, -2 where there are several."""
    known = arcs.groupBy("v", "w").agg(F.count(F.lit(1)).alias("_n"), F.min("link").alias("_link"))
    return wanted.join(known, ["v", "w"], "left").withColumn("link", F.when(F.col("_n").isNull(), F.lit(-1)).when(F.col("_n") > 1, F.lit(-2)).otherwise(F.col("_link")).cast("long")).drop("_n", "_link")


def successors(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """Arcs in order at each vertex; for reference vertices the arc along the reference comes first."""
    place = segments.select(F.col("seg").alias("_s"), "sn", "so", "sr", "len")
    a = arcs.join(place.toDF("_s", "_sn", "_so", "_sr", "_len"), F.shiftright("v", 1) == F.col("_s")).drop("_s")
    a = a.join(place.toDF("_s", "_tn", "_to", "_tr", "_tl"), F.shiftright("w", 1) == F.col("_s")).drop("_s")
    forward = (F.col("v").bitwiseAND(F.lit(1).cast("long")) == 0) & (F.col("_to") == F.col("_so") + F.col("_len"))
    backward = (F.col("v").bitwiseAND(F.lit(1).cast("long")) == 1) & (F.col("_so") == F.col("_to") + F.col("_tl"))
    along = (F.col("_sr") == 0) & (F.col("_tr") == 0) & (F.col("_sn") == F.col("_tn")) & (forward | backward)
    order = Window.partitionBy("v").orderBy(along.desc(), "w", "link")
    return a.withColumn("is_ref", along).withColumn("ord", F.row_number().over(order) - 1).select(*arcs.columns, "is_ref", "ord")


def vertices(segments: DataFrame) -> DataFrame:
    """The sequence of each segment on both strands."""
    both = segments.where("seq IS NOT NULL").withColumn("_rev", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select((F.col("seg") * 2 + F.col("_rev")).alias("v"), F.when(F.col("_rev") == 0, F.col("seq")).otherwise(reverse_complement(F.col("seq"))).alias("seq"), "len")


def delete(graph: SequenceGraph, segs: DataFrame) -> SequenceGraph:
    """The graph without some segments (column seg) and all arcs at them."""
    rest = graph.segments.join(segs, "seg", "left_anti")
    return SequenceGraph(rest, drop_dangling(graph.arcs, rest))


def spell(steps: DataFrame, vertex: DataFrame) -> DataFrame:
    """The sequence of each path: steps (path, ord, v, st, en) joined to vertices, in order."""
    parts = steps.join(vertex.select("v", "seq"), "v").select("path", F.struct("ord", F.expr("substring(seq, CAST(st + 1 AS INT), CAST(en - st AS INT))").alias("part")).alias("_p"))
    return parts.groupBy("path").agg(F.sort_array(F.collect_list("_p")).alias("_p")).select("path", F.array_join(F.transform("_p", lambda p: p["part"]), "").alias("seq"))


def reach(arcs: DataFrame, sources: DataFrame, most_dist: int | None = None) -> DataFrame:
    """Smallest distance from each source to what it reaches, and the fewest steps of that distance:
    (source, v, dist, steps).

    arcs: (v, w, dist), no distance below zero. One join and one aggregation a round; only vertices whose
    distance fell go on, until none did."""
    if not arcs.where("dist < 0").isEmpty():
        raise ValueError("distances below zero")
    found = cut(sources.select("source", F.col("source").alias("v"), F.lit(0).cast("long").alias("dist"), F.lit(0).alias("steps")).distinct())
    front, k = found, 0
    while not front.isEmpty():
        k += 1
        ahead = front.join(arcs.select("v", "w", F.col("dist").alias("_d")), "v").select("source", F.col("w").alias("v"), (F.col("dist") + F.col("_d")).alias("dist"), F.lit(k).alias("steps"))
        if most_dist is not None:
            ahead = ahead.where(F.col("dist") <= most_dist)
        found = cut(found.unionByName(ahead).groupBy("source", "v").agg(F.min(F.struct("dist", "steps")).alias("_b")).select("source", "v", "_b.*"))
        front = found.where(F.col("steps") == k)
    return found


def k_shortest(arcs: DataFrame, pairs: DataFrame, k: int, most_dist: int | None = None) -> DataFrame:
    """The k shortest walks of each (source, target), of at most some length, ties by the walk's vertices; pairs may
    have a length of their own, `most`, of which each source's largest bounds its walks.

    Walks grow from each source by one arc a round; at each vertex only its k shortest from a source stay, as
    only they can begin the k shortest to any other. It ends when no walk is new; distances must be over zero,
    so that walks around a cycle get longer."""
    best = _shortest_from(arcs, pairs, k, most_dist)
    return best.withColumnRenamed("v", "target").join(pairs.select("source", "target").distinct(), ["source", "target"]).select("source", "target", "rank", "dist", "walk")


def _shortest_from(arcs: DataFrame, pairs: DataFrame, k: int, most_dist: int | None = None) -> DataFrame:
    """(source, v, rank, dist, walk): the k shortest walks from the sources of pairs to all that they reach."""
    if not arcs.where("dist <= 0").isEmpty():
        raise ValueError("distances of zero or less")
    rank = F.row_number().over(Window.partitionBy("source", "v").orderBy("dist", "walk"))
    steps = arcs.select("v", "w", F.col("dist").alias("_d"))
    bound = F.max("most") if "most" in pairs.columns else F.lit(most_dist).cast("long")
    sources = pairs.groupBy("source").agg(bound.alias("_most"))
    best = cut(sources.select("source", "_most", F.col("source").alias("v"), F.lit(0).cast("long").alias("dist"), F.array("source").alias("walk"), F.lit(0).alias("round")))
    front, done = best, 0
    while not front.isEmpty():
        done += 1
        grown = front.join(steps, "v").select("source", "_most", F.col("w").alias("v"), (F.col("dist") + F.col("_d")).alias("dist"), F.concat("walk", F.array("w")).alias("walk"), F.lit(done).alias("round"))
        grown = grown.where("_most IS NULL OR dist <= _most")
        best = cut(best.unionByName(grown).withColumn("_r", rank).where(F.col("_r") <= k).drop("_r"))
        front = best.where(F.col("round") == done)
    return best.withColumn("rank", rank).select("source", "v", "rank", "dist", "walk")


def walk_hash(walk: Column) -> Column:
    """A hash of a walk's vertices in order."""
    return F.aggregate(walk, F.lit(0).cast("long"), lambda h, v: hash32(h.bitwiseXOR(hash32(v))))


def walks_of_length(arcs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted with dist and walk: of the k shortest walks from source to target that are no longer than `most`, the one
    whose length is nearest to `length` (ties: the shorter, then by vertices). Where wanted has `hash` and one of
    these walks has it (walk_hash), that walk is taken. Rows without a walk are left out.

    arcs: (v, w, dist); wanted: (source, target, length, most, ...). Walks are found once for each pair of vertices."""
    found = _shortest_from(arcs, wanted, k).select("source", F.col("v").alias("target"), "dist", "walk")
    both = wanted.join(found, ["source", "target"]).where("dist <= most")
    other = (walk_hash(F.col("walk")) != F.col("hash")) if "hash" in wanted.columns else F.lit(False)
    keys = wanted.columns
    near = F.struct(F.coalesce(other, F.lit(True)).alias("o"), F.abs(F.col("dist") - F.col("length")).alias("d"), "dist", "walk")
    return both.groupBy(*keys).agg(F.min(near).alias("_b")).select(*keys, "_b.dist", "_b.walk")


def count_paths(arcs: DataFrame, sources: DataFrame, most: int = 2**31 - 1) -> DataFrame:
    """The number of paths from each source to each vertex of an acyclic graph, saturating at `most`; a cycle that
    a source reaches is an error, as paths then have no end."""
    steps = arcs.select("v", "w")
    n_vertices = steps.select("v").unionByName(steps.select(F.col("w").alias("v"))).distinct().count()
    front = cut(sources.select("source", F.col("source").alias("v"), F.lit(1).cast("long").alias("n")).distinct())
    out, done = front, 0
    while not front.isEmpty():
        done += 1
        if done > n_vertices:
            raise ValueError("the graph has a cycle")
        front = cut(front.join(steps, "v").groupBy("source", F.col("w").alias("v")).agg(F.least(F.sum("n"), F.lit(most)).alias("n")))
        out = cut(out.unionByName(front).groupBy("source", "v").agg(F.least(F.sum("n"), F.lit(most)).alias("n")))
    return out
