"""Half-open integer intervals [st, en) on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _levels(df: DataFrame, width: int) -> DataFrame:
    """df with _level: the first of the widths width, 2 width, 4 width ... that is no shorter than the interval."""
    long = F.greatest(F.col("en") - F.col("st"), F.lit(1))
    guess = F.greatest(F.ceil(F.log2(long / width)), F.lit(0))  # one too low or too high by rounding at most
    fits = lambda k: long <= F.call_function("shiftleft", F.lit(width).cast("long"), k.cast("int"))
    level = F.when(~fits(guess), guess + 1).when((guess > 0) & fits(guess - 1), guess - 1).otherwise(guess)
    return df.withColumn("_level", level.cast("int"))


def _in_bins(df: DataFrame, others: DataFrame, width: int, name: str) -> DataFrame:
    """df once or twice for each level of the others that is no lower than its own, in bins of that level, as _at;
    and once or twice in its own level."""
    found = others.agg(F.collect_set("_level")).scalar()  # one value, of 63 levels at most
    own = df.withColumn("_found", found).withColumn("_at", F.explode(F.array_union(F.array("_level"), F.filter("_found", lambda k: k > F.col("_level")))))
    size = F.expr(f"shiftleft({width}L, _at)")
    bins = F.sequence(F.floor(F.col("st") / size), F.floor(F.greatest(F.col("en") - 1, F.col("st")) / size))
    return own.withColumn("_bin", F.explode(bins)).withColumnRenamed("_level", name).drop("_found")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of rows of a and b on equal keys with a.st < b.en and b.st < a.en; b's other columns must have
    names of their own but st and en, which become b_st and b_en.

    An interval belongs to the level of bins that its length asks for, and a pair meets at the higher of its two
    levels: there both are in two bins at most, however long one and short the other is, and a key with very many
    intervals is many join keys. A pair is kept in the first bin that both have."""
    a_, b_ = _levels(a, width), _levels(b, width)
    left = _in_bins(a_, b_, width, "_la")
    right = _in_bins(b_, a_, width, "_lb").withColumnsRenamed({"st": "b_st", "en": "b_en"})
    met = (F.col("_at") == F.greatest("_la", "_lb")) & (F.col("_bin") == F.floor(F.greatest(F.col("st"), F.col("b_st")) / F.expr(f"shiftleft({width}L, _at)")))
    pairs = left.join(right, [*keys, "_at", "_bin"]).where(met & (F.col("st") < F.col("b_en")) & (F.col("b_st") < F.col("en"))).drop("_at", "_bin", "_la", "_lb")
    if how == "inner":
        return pairs
    missing = a.join(pairs.select(*keys, "st", "en").distinct(), [*keys, "st", "en"], "left_anti")
    return pairs.unionByName(missing, allowMissingColumns=True)


def contained(a: DataFrame, b: DataFrame, keys: list[str], width: int, of: bool = False) -> DataFrame:
    """The rows of a that lie whole in a row of b; with `of`, the rows of b that hold one of a.

    Rows of b are in one or two bins of the level that their length asks for; a row of a looks in the bin of its
    start at each of these levels."""
    held = _levels(b.withColumn("en", F.col("en") + 1), width).withColumn("en", F.col("en") - 1).withColumnRenamed("_level", "_at")  # an interval may start at a place where one ends
    found = held.agg(F.collect_set("_at")).scalar()
    size = F.expr(f"shiftleft({width}L, _at)")
    held = held.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("st") / size), F.floor(F.greatest("en", "st") / size))))
    own = a.withColumn("_found", found).withColumn("_at", F.explode("_found")).withColumn("_bin", F.floor(F.col("st") / size)).drop("_found")
    on = [*keys, "_at", "_bin"]
    if of:
        inner = own.select(*on, F.col("st").alias("_st"), F.col("en").alias("_en"))
        both = [held[k] == inner[k] for k in on] + [held["st"] <= inner["_st"], inner["_en"] <= held["en"]]
        return held.join(inner, both, "left_semi").drop("_at", "_bin").distinct()
    # a row of a is there once for each level: those that hold it are told apart by a number, not by a distinct
    outer = held.select(*on, F.col("st").alias("_st"), F.col("en").alias("_en"))
    both = [own[k] == outer[k] for k in on] + [outer["_st"] <= own["st"], own["en"] <= outer["_en"]]
    hit = own.join(outer, both, "left_semi").select(*keys, "st", "en").distinct()
    return a.join(hit, [*keys, "st", "en"], "left_semi")


def _beside(rows: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their bin's row; a null key is a key as any other."""
    names = {k: f"_k{i}" for i, k in enumerate([*keys, "_bin"])}
    other = bins.withColumnsRenamed(names)
    return rows.join(other, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]).drop(*names.values())


def _before(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows (with _bin) with the largest `value` of all earlier bins of their key: one row for each bin tells it, so
    only the table of bins is put in order by key."""
    tops = rows.groupBy(*keys, "_bin").agg(F.max(value).alias("_top"))
    by = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return _beside(rows, tops.withColumn(name, F.max("_top").over(by)).drop("_top"), keys)


def _merge(df: DataFrame, keys: list[str], touching: bool = True) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("st", "en")
    reach = F.max("en").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("st") > reach if touching else F.col("st") >= reach), 1).otherwise(0)
    marked = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.sum("n").alias("n")).drop("_run")


def union(df: DataFrame, keys: list[str], width: int | None = None, touching: bool = True) -> DataFrame:
    """The islands that the intervals of each key form: (keys, st, en, n intervals). Touching ones merge, unless
    `touching` is false.

    With `width`, intervals merge first among those that start in one bin. An island of a bin starts an island of its
    key, where all earlier bins end before it; the last such start, again told by one row for each bin, names the
    islands that it goes on in. So a hot key is as many groups as it has bins."""
    rows = df.select(*keys, "st", "en", F.lit(1).cast("long").alias("n"))
    if not width:
        return _merge(rows, keys, touching)
    rows = _merge(rows.withColumn("_bin", F.floor(F.col("st") / width)), [*keys, "_bin"], touching)
    rows = _before(rows, keys, "en", "_reach")
    starts = rows.withColumn("_head", F.when(F.col("_reach").isNull() | (F.col("st") > F.col("_reach") if touching else F.col("st") >= F.col("_reach")), F.col("st")))
    starts = _before(starts, keys, "_head", "_earlier")
    own = F.max("_head").over(Window.partitionBy(*keys, "_bin").orderBy("st").rowsBetween(Window.unboundedPreceding, 0))
    named = starts.withColumn("_island", F.coalesce(own, F.col("_earlier")))
    return named.groupBy(*keys, "_island").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.sum("n").alias("n")).drop("_island")


def union_length(df: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    return union(df, keys, width).groupBy(*keys).agg(F.sum(F.col("en") - F.col("st")).alias("length"), F.count(F.lit(1)).alias("islands"))


def subtract(a: DataFrame, b: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """The parts of a's union that no interval of b covers: a sweep over starts and ends.

    With `width`, each bin sweeps its own starts and ends from the depths that the bins before leave it with, which
    one row for each bin tells; so a hot key is as many groups as it has bins."""

    def ends(df: DataFrame, side: str) -> DataFrame:
        step = F.explode(F.array(F.struct(F.col("st").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("en").alias("pos"), F.lit(-1).alias("d"))))
        zero = F.lit(0).alias("b" if side == "a" else "a")
        return df.where("st < en").select(*keys, step.alias("_s")).select(*keys, F.col("_s.pos").alias("pos"), F.col("_s.d").alias(side), zero)

    steps = ends(a, "a").unionByName(ends(b, "b")).groupBy(*keys, "pos").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    steps = steps.withColumn("_bin", F.floor(F.col("pos") / width) if width else F.lit(0).cast("long"))
    bins = steps.groupBy(*keys, "_bin").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"), F.min("pos").alias("_first"))
    line = Window.partitionBy(*keys).orderBy("_bin")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", F.coalesce(F.sum("_a").over(earlier), F.lit(0)).alias("_a0"), F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_b0"), F.lead("_first").over(line).alias("_next"))
    by = Window.partitionBy(*keys, "_bin").orderBy("pos")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    swept = _beside(steps.withColumns({"_to": F.lead("pos").over(by), "_sa": F.sum("a").over(upto), "_sb": F.sum("b").over(upto)}), bins, keys)
    pieces = swept.select(*keys, F.col("pos").alias("st"), F.coalesce("_to", "_next").alias("en"), (F.col("_sa") + F.col("_a0")).alias("_a"), (F.col("_sb") + F.col("_b0")).alias("_b"))
    return union(pieces.where("_a > 0 AND _b = 0 AND en IS NOT NULL"), keys, width).drop("n")


def coverage(queries: DataFrame, b: DataFrame, keys: list[str], ids: list[str], width: int) -> DataFrame:
    """For each query the number of overlapping rows of b and the length of it that they cover together."""
    hits = overlap_join(queries, b.select(*keys, "st", "en"), keys, width)
    clipped = hits.select(*keys, *ids, F.greatest("st", "b_st").alias("st"), F.least("en", "b_en").alias("en"))
    found = union(clipped, [*keys, *ids]).groupBy(*keys, *ids).agg(F.sum("n").alias("n_overlaps"), F.sum(F.col("en") - F.col("st")).alias("covered"))
    return queries.join(found, [*keys, *ids], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_overlaps", "covered")})


def sliding_windows(lengths: DataFrame, keys: list[str], size: int, step: int) -> DataFrame:
    """Windows of `size` centred on every `step`-th place of [0, length), clipped to it."""
    at = lengths.where("length > 0").withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))))
    half = size // 2
    return at.select(*keys, F.greatest(F.col("_x") - half, F.lit(0)).alias("st"), F.least(F.col("_x") + half, F.col("length")).alias("en"), F.col("_x").alias("centre"))


def step_lookup(points: DataFrame, steps: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """points (keys, pos) with the interpolated value of a piecewise linear function given by steps
    (keys, pos, value; one for each pos), flat after its last step, null before its first.

    Both are cut into bins of `width`; each bin merges its points and steps in order and gets the last step
    before it and the first behind it, which one row for each bin tells. So a key with very many points is
    many groups."""
    own = F.floor(F.col("pos") / width)
    steps = steps.select(*keys, own.alias("_bin"), "pos", F.struct(F.col("pos").alias("p"), F.col(value).alias("v")).alias("_s"))
    points = points.withColumn("_bin", own)
    ends = steps.groupBy(*keys, "_bin").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    bins = points.select(*keys, "_bin").distinct().join(ends, [*keys, "_bin"], "full")
    by = Window.partitionBy(*keys).orderBy("_bin")
    before = F.last("_hi", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    # what is behind is what is before in the other order: a frame to the end is read anew for each row
    back = Window.partitionBy(*keys).orderBy(F.desc("_bin"))
    behind = F.last("_lo", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(*keys, "_bin", before.alias("_before"), behind.alias("_behind"))
    # a step comes before a point of its place, and after it no step of that place comes
    both = points.withColumns({"_s": F.lit(None).cast(steps.schema["_s"].dataType), "_side": F.lit(1)}).unionByName(steps.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy(*keys, "_bin").orderBy("pos", "_side")
    back = Window.partitionBy(*keys, "_bin").orderBy(F.desc("pos"), F.desc("_side"))
    near = both.withColumns({"_a": F.last("_s", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.last("_s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))})
    found = near.where("_side = 1").join(bins, [*keys, "_bin"])
    a, b = F.coalesce("_a", "_before"), F.coalesce("_b", "_behind")
    slope = (b["v"] - a["v"]) * (F.col("pos") - a["p"]) / (b["p"] - a["p"])
    return found.withColumn(value, a["v"] + F.coalesce(slope, F.lit(0.0))).drop("_bin", "_s", "_side", "_a", "_b", "_before", "_behind")
