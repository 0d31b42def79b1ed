"""Strong components of a graph by reach in both directions, and the order of what they condense to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, cut_telling


#: So many rows of a front and of what it tells go to all tasks; of more, the rows go by their vertex.
FEW = 1 << 17


def _near(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= FEW else rows


def _both_ways(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _way, v, w): v tells w along the arcs (0) and against them (1)."""
    against = arcs.select(*keys, F.lit(1).alias("_way"), F.col("w").alias("v"), F.col("v").alias("w"))
    return arcs.select(*keys, F.lit(0).alias("_way"), "v", "w").unionByName(against)


def trim(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """Without arcs at vertices that nothing leads to or from, again and again: they are on no cycle. Arcs are left just
    where there is a cycle. While many arcs go, what is left is written anew. Then a round takes the arcs of the
    vertices that went last from the counts of those beside them, which it tells to all tasks, so that arcs stay where they are."""
    n = FEW + 1
    while n > FEW:
        seen = _both_ways(arcs, keys).groupBy(*keys, "v").agg(F.min("_way").alias("_a"), F.max("_way").alias("_b"))
        lone, n = cut_telling(seen.where("_a = _b").select(*keys, "v"), F.count(F.lit(1)))
        if n:
            lone = _near(lone, n)
            arcs = cut(arcs.join(lone, [*keys, "v"], "left_anti").join(lone.withColumnRenamed("v", "w"), [*keys, "w"], "left_anti").select(*keys, "v", "w"))
    if not n:
        return arcs
    steps = cut(_both_ways(arcs, keys))
    along, against = F.count_if(F.col("_way") == 0), F.count_if(F.col("_way") == 1)
    now = steps.groupBy(*keys, "v").agg(along.alias("_out"), against.alias("_in"), F.count(F.lit(1)).alias("_size"))
    now, n = cut_telling(now.withColumn("_goes", F.expr("_in = 0 OR _out = 0")), F.expr("sum(IF(_goes, _size, 0))"))
    while n:
        front = now.where("_goes").select(*keys, "v")
        ahead = _near(front, n).join(steps, [*keys, "v"]).groupBy(*keys, F.col("w").alias("v")).agg(along.alias("_a"), against.alias("_b"))
        less = now.where("NOT _goes").drop("_goes").join(_near(ahead, n), [*keys, "v"], "left")
        less = less.select(*keys, "v", F.expr("_out - coalesce(_b, 0)").alias("_out"), F.expr("_in - coalesce(_a, 0)").alias("_in"), "_size")
        now, n = cut_telling(less.withColumn("_goes", F.expr("_in = 0 OR _out = 0")), F.expr("sum(IF(_goes, _size, 0))"))
    left = now.select(*keys, "v")
    return cut(arcs.join(left, [*keys, "v"], "left_semi").join(left.withColumnRenamed("v", "w"), [*keys, "w"], "left_semi").select(*keys, "v", "w"))


def _least_reaching(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, colour): the smallest vertex that reaches each vertex, itself included. Only vertices whose colour fell
    tell it on; few of them are told to all tasks, where arcs and colours stay."""
    told = [arcs.select(*keys, F.col(at).alias("v"), F.col(c).alias("colour"), F.lit(n).alias("_size")) for at, c, n in (("v", "v", 1), ("w", "w", 0), ("w", "v", 0))]
    now = told[0].unionByName(told[1]).unionByName(told[2]).groupBy(*keys, "v").agg(F.min("colour").alias("colour"), F.sum("_size").alias("_size"))
    now, n = cut_telling(now.withColumn("_fell", F.col("colour") < F.col("v")), F.expr("sum(IF(_fell, _size, 0))"))
    while n:
        front = now.where("_fell AND _size > 0").select(*keys, "v", "colour")
        ahead = _near(front, n).join(arcs, [*keys, "v"]).groupBy(*keys, F.col("w").alias("v")).agg(F.min("colour").alias("_up"))
        less = now.join(_near(ahead, n), [*keys, "v"], "left").select(*keys, "v", F.least("colour", "_up").alias("colour"), "_size", F.coalesce(F.col("_up") < F.col("colour"), F.lit(False)).alias("_fell"))
        now, n = cut_telling(less, F.expr("sum(IF(_fell, _size, 0))"))
    return now.select(*keys, "v", "colour")


def strong_components(arcs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, v, component): the smallest vertex of each vertex's strong component, in the graph of each key.

    Rounds: vertices on no cycle go (each is a component); each vertex gets as its colours the smallest vertex that
    reaches it and the smallest that it reaches. Where both are the same, this is its component; arcs between vertices
    with other colours are in no component. A round ends one component at least in each part that is left."""
    keys = keys or []
    every = arcs.select(*keys, "v").unionByName(arcs.select(*keys, F.col("w").alias("v"))).distinct()
    rest = trim(cut(arcs.select(*keys, "v", "w").where("v <> w").distinct()), keys)
    found = None
    while not rest.isEmpty():
        told = _least_reaching(cut(_both_ways(rest, keys)), [*keys, "_way"])
        colours = cut(told.groupBy(*keys, "v").agg(F.max(F.when(F.col("_way") == 0, F.col("colour"))).alias("_a"), F.max(F.when(F.col("_way") == 1, F.col("colour"))).alias("_b")))
        mine = colours.where("_a = _b").select(*keys, "v", F.col("_a").alias("component"))
        found = mine if found is None else found.unionByName(mine)
        open_ = colours.where("_a <> _b")
        left = rest.join(open_, [*keys, "v"]).join(open_.withColumnRenamed("v", "w"), [*keys, "w", "_a", "_b"]).select(*keys, "v", "w")
        rest = trim(cut(left), keys)
    if found is None:
        return every.withColumn("component", F.col("v"))
    return every.join(found, [*keys, "v"], "left").withColumn("component", F.coalesce("component", "v"))


def bidirected_components(arcs: DataFrame) -> DataFrame:
    """(v, component) of a graph whose vertices v and v ^ 1 are the strands of a segment: a vertex and its complement are
    never in one component. Where the arcs alone would put them in one, arcs between the strands don't count there."""
    first = cut(strong_components(arcs))
    twin = first.select(F.col("v").bitwiseXOR(F.lit(1).cast("long")).alias("v"), F.col("component").alias("_c"))
    torn = first.join(twin, "v").where("component = _c").select("component").distinct()
    mixed = cut(first.join(torn, "component", "left_semi"))
    inside = arcs.select("v", "w").join(mixed.select("v", "component"), "v").join(mixed.select(F.col("v").alias("w"), F.col("component").alias("_c")), "w").where("component = _c AND v % 2 = w % 2")
    again = strong_components(inside.select("v", "w"))
    out = first.join(mixed.select("v"), "v", "left_anti").select("v", "component").unionByName(mixed.select("v").join(again, "v", "left").select("v", F.coalesce("component", "v").alias("component")))
    return cut(out)


def condensation_order(components: DataFrame, arcs: DataFrame) -> DataFrame:
    """(component, level): the longest way, in components, that leads to each one; arcs between components rise in level.
    Levels are told on by one join a round until none rises. Arcs that lie in a cycle of components (which strands that
    were taken apart can make) are an error."""
    own = components.select("v", "component")
    steps = arcs.select("v", "w").join(own, "v").join(own.toDF("w", "to"), "w").where("component <> to").select("component", "to").distinct()
    steps = cut(steps)
    now = cut(own.select("component").distinct().withColumn("level", F.lit(0)))
    front, n, done = now, now.count(), 0
    while not front.isEmpty():
        done += 1
        if done > n:
            raise ValueError("the components are on a cycle")
        ahead = front.join(steps, "component").groupBy(F.col("to").alias("component")).agg((F.max("level") + 1).alias("up"))
        now = cut(now.join(ahead, "component", "left").select("component", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), F.coalesce(F.col("up") > F.col("level"), F.lit(False)).alias("rose")))
        front = now.where("rose").select("component", "level")
        now = now.select("component", "level")
    return now
