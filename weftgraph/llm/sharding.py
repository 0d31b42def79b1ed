"""Two-pass external shuffle into shards, from DataFrame functions only.

Pass 1 scatters the records into memory-sized buckets by a seeded hash of the record. Pass 2 puts each
bucket in order, permutes it with the seeded Fisher-Yates function `shuffle` and writes it. The place of a
record in the whole is the number of records in the buckets before plus its place in its bucket; shards
are equal ranges of places, so their row counts are at most one apart (the law `rows`).

Defined cases: null ids and null texts are records as any other (a null text has no bytes); repeated rows
are kept, each at a place of its own, and scatter over all buckets however many they are, as rows of one id and
text do; an empty table gives no rows. Other columns pass through, maps at the top too (maps inside of other
columns can't be compared and are an error of Spark's), but for those named shard or slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import col, others, shared_path, stored

#: Bytes of overhead that a record counts besides its text.
RECORD_OVERHEAD = 16


def record_size(text: str = "text"):
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + RECORD_OVERHEAD).cast("long")


def _numbered(packed: DataFrame, key, most: int) -> DataFrame:
    """packed with `_copy`: rows that are equal in all columns, if they are over `most`, get numbers; all others 0.
    Equal rows are counted before they move, and the counts become rows again."""
    names = packed.columns
    keyed = packed.withColumn("_key", key)
    often = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_key")
    rare = keyed.join(often, "_key", "left_anti").select(*map(col, names), F.lit(0).cast("long").alias("_copy"))
    counted = keyed.join(often, "_key", "left_semi").groupBy(*map(col, names)).agg(F.count(F.lit(1)).alias("_n"))
    return rare.unionByName(counted.select(*map(col, names), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")))


def external_shuffle(docs: DataFrame, shards: int, seed: int = 17, bucket_bytes: int = 64 << 20, buckets_per_shard: int = 8) -> DataFrame:
    """docs with the columns shard and slot: a uniform shuffle, dealt to `shards` shards of equal row counts.

    bucket_bytes bounds what one task holds of a bucket; there are `buckets_per_shard` buckets for each shard
    at least, and a task for each, so that the order depends on the rows and the seed alone. Places need the
    row counts of the buckets, a table of as many rows as there are buckets."""
    kept = others(docs, "shard", "slot")
    maps = {f.name for f in docs.schema if isinstance(f.dataType, MapType)}
    packed = docs.select(*[(F.array_sort(F.map_entries(col(c))) if c in maps else col(c)).alias(c) for c in kept])
    total, n = docs.select(F.sum(record_size()), F.count(F.lit(1))).first()
    n_buckets = max(shards * buckets_per_shard, -(-(total or 0) // bucket_bytes))
    every = [col(c) for c in kept]  # rows of one id and text that differ in another column scatter as well
    bucket = lambda copy: F.pmod(F.xxhash64(F.lit(seed), *every, copy), F.lit(n_buckets)).cast("int").alias("_bucket")
    numbered = packed.withColumn("_copy", F.lit(0).cast("long"))
    counts = stored(numbered.groupBy(bucket(F.col("_copy"))).agg(F.count(F.lit(1)).alias("_rows")), "bucket-counts")
    even = (n or 0) // n_buckets
    if (counts.agg(F.max("_rows")).first()[0] or 0) > even + max(1000, even):  # only many equal rows fill a bucket so
        numbered = _numbered(packed, F.xxhash64(F.lit(seed), *every), max(1000, (n or 0) // (16 * n_buckets)))
        counts = numbered.groupBy(bucket(F.col("_copy"))).agg(F.count(F.lit(1)).alias("_rows"))
    scattered = numbered.select(F.struct(*every).alias("_record"), bucket(F.col("_copy")))
    before = counts.selectExpr("_bucket", "sum(_rows) OVER (ORDER BY _bucket) - _rows AS _before")
    if n_buckets <= 1 << 16:  # 24 bytes each
        before = F.broadcast(before)
    dealt = (
        scattered.repartition(n_buckets, "_bucket")
        .groupBy("_bucket")
        .agg(F.array_sort(F.collect_list("_record")).alias("_records"))
        .sortWithinPartitions("_bucket")  # shuffle() draws from one stream for each partition
        .select("_bucket", F.shuffle("_records", F.lit(seed)).alias("_records"))
        .select("_bucket", F.posexplode("_records").alias("_at", "_record"))
        .join(before, "_bucket")
        .withColumn("_place", F.col("_before") + F.col("_at"))
        .withColumn("_shard", F.expr(f"(_place * {shards}) div {max(n, 1)}").cast("int"))
    )
    own = [(F.map_from_entries(F.col("_record")[c]) if c in maps else F.col("_record")[c]).alias(c) for c in kept]
    return dealt.select(*own, F.col("_shard").alias("shard"), F.expr(f"_place - (CAST(_shard AS BIGINT) * {n} + {shards - 1}) div {shards}").alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str | None = None, **how) -> str:
    """Writes the shuffled records to one folder for each shard; returns the path."""
    path = path or shared_path(docs.sparkSession, "shards")
    external_shuffle(docs, shards, **how).write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark, path: str, columns: str) -> DataFrame:
    """The written records; columns: their schema without the shard."""
    return spark.read.schema(f"{columns}, shard int").parquet(path)
