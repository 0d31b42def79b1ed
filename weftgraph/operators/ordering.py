"""Dense numbers, ranks, top-k, exact quantiles and runs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt by range and sorted, with _range and _at, the place in it. This is written once: a second run of the
    same plan may deal rows otherwise."""
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    return dealt.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def dense_numbers(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with a gapless number in the order of some columns, without a sort in one task.

    Rows are dealt by range, numbered within their range, and the ranges' row counts are added up."""
    dealt = _in_ranges(df, order)
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at") + F.lit(start)).drop("_range", "_at", "_before")


def running_total(df: DataFrame, order: list[str], value: str, name: str, also: str | None = None) -> DataFrame:
    """df with the sum of a column over all rows before, in the order of some columns, without a sort in one task:
    sums of ranges, then of rows within a range. `also` names a column whose runs of equal neighbours share a sum,
    that of their first row, as `_run` + name."""
    dealt = _in_ranges(df, order)
    own = Window.partitionBy("_range").orderBy("_at")
    ranges = Window.orderBy("_range")
    held = {"_sum": F.sum(value)} | ({"_first": F.min_by(also, "_at"), "_last": F.max_by(also, "_at")} if also else {})
    sums = dealt.groupBy("_range").agg(*[v.alias(k) for k, v in held.items()])
    before = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if also:
        before = before.withColumn("_prev", F.lag("_last").over(ranges))
    found = dealt.join(F.broadcast(before.drop("_sum", "_first", "_last")), "_range")
    found = found.withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if not also:
        return found.drop("_range", "_at", "_base")
    head = ~F.coalesce(F.lag(also).over(own), F.col("_prev")).eqNullSafe(F.col(also))
    # a run that began in a range before takes that range's last head
    marked = cut(found.withColumn("_head", F.when(head, F.col(name))).drop("_base", "_prev"))
    tails = marked.groupBy("_range").agg(F.max("_head").alias("_h"))
    carried = tails.select("_range", F.last("_h", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    own_head = F.last("_head", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(F.broadcast(carried), "_range").withColumn("_run" + name, F.coalesce(own_head, F.col("_carried"))).drop("_range", "_at", "_head", "_carried")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def first_last(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys..., first, last): the value of each key's first and last row in an order."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def exact_quantile_of_counts(values: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """For each fraction f the value at place floor((1 - f) * n) of the sorted values.

    Works on the histogram of values, which is small where values are counts."""
    bars = values.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    sums = bars.select(F.col(value), F.sum("_n").over(Window.orderBy(value)).alias("_upto"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    wanted = F.explode(F.array(*[F.lit(f).cast("double") for f in fractions])).alias("fraction")
    asked = sums.select(value, "_upto", "_all", wanted)
    return asked.where(F.col("_upto") > F.floor((F.lit(1.0) - F.col("fraction")) * F.col("_all"))).groupBy("fraction").agg(F.min(value).alias("cap"), F.max("_all").alias("n"))


def runs(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """df with the number of the run of rows that each is in: a run starts where `starts` holds."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
