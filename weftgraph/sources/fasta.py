"""FASTA and FASTQ records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nt import name_stem, reverse_complement
from ..operators.lineage import cut
from ..operators.ordering import running_total


def _named(df: DataFrame, header: str) -> DataFrame:
    head = F.col(header)
    return df.withColumns({"name": F.regexp_extract(head, r"^(\S*)", 1), "comment": F.nullif(F.regexp_extract(head, r"^\S*\s+(.*)$", 1), F.lit("")), "seq": F.translate("seq", "Uu", "Tt")})


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, comment, seq) of each record; a record is what stands between line starts with '>'. ord
    puts the records of all files in order: the file, the part of it that a task reads, the place in that."""
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_name").alias("file"), place.alias("ord"), F.regexp_replace("value", r"^>", "").alias("_r")).where("trim(_r) <> ''")
    parts = rows.select("file", "ord", F.split("_r", "\n", 2).alias("_p"))
    body = F.regexp_replace(F.coalesce(F.try_element_at("_p", F.lit(2)), F.lit("")), r"\s", "")
    return _named(parts.select("file", "ord", F.col("_p")[0].alias("_h"), body.alias("seq")), "_h").select("file", "ord", "name", "comment", "seq")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, comment, seq, qual) of records of four lines, which may stand in different parts of a file:
    the lines of each part are counted, so each line's number in its file is known without a sort."""
    lines = cut(spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_l")))
    blocks = lines.groupBy("file", "_b").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_b")) - F.col("_n")
    rows = lines.join(blocks.select("file", "_b", (before - F.col("_first")).alias("_shift")), ["file", "_b"]).select("file", (F.col("_at") + F.col("_shift")).alias("_i"), "_l")
    four = rows.groupBy("file", F.floor(F.col("_i") / 4).alias("ord")).agg(*[F.max(F.when(F.col("_i") % 4 == k, F.col("_l"))).alias(c) for k, c in ((0, "_h"), (1, "seq"), (3, "qual"))])
    return _named(four.where("_h <> ''").withColumn("_h", F.regexp_replace("_h", "^@", "")), "_h").select("file", "ord", "name", "comment", "seq", "qual")


def rename(records: DataFrame, prefix: str) -> DataFrame:
    return records.withColumn("name", F.concat(F.lit(prefix), "name"))


def join_records(records: DataFrame, key: list[str], order: str, gap: int, least: int = 0) -> DataFrame:
    """The sequences of each key, of `least` length or more, in order, joined by runs of N."""
    kept = records.where(F.length("seq") >= least)
    return kept.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "seq"))), lambda x: x["seq"]), "N" * gap).alias("seq"))


def fragments(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """records with `fragment`, the number of the run of neighbours of one name stem, and the place in it."""
    by = Window.partitionBy(*keys).orderBy(order)
    stem = name_stem(F.col("name"))
    marked = records.withColumn("_new", F.when(F.lag(stem).over(by).isNull() | (F.lag(stem).over(by) != stem), 1).otherwise(0))
    numbered = marked.withColumn("fragment", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("fragment_ord", F.row_number().over(Window.partitionBy(*keys, "fragment").orderBy(order)) - 1).drop("_new")


def zip_records(first: DataFrame, second: DataFrame, order: str) -> DataFrame:
    """Records of two files paired by their place, as far as the shorter goes: `order` numbers both from 0 on."""
    return first.select(F.col(order).alias("ord"), F.struct("*").alias("first")).join(second.select(F.col(order).alias("ord"), F.struct("*").alias("second")), "ord")


def reverse_records(records: DataFrame) -> DataFrame:
    """Records on the other strand: sequences reversed and complemented, qualities reversed."""
    turned = records.withColumn("seq", reverse_complement(F.col("seq")))
    return turned.withColumn("qual", F.reverse("qual")) if "qual" in records.columns else turned


def clean_name(name: Column) -> Column:
    """A name without what stands before its last '#'."""
    return F.regexp_replace(name, r"^\S+#", "")


def contig_name(name: Column) -> Column:
    """A contig without 'sample#haplotype#' before it."""
    return F.regexp_replace(name, r"^[^\s#]+#[0-9]#", "")


def batches(records: DataFrame, order: list[str], bases: int, pairs: bool = False) -> DataFrame:
    """records with `batch`: the records in order, cut where their summed lengths pass a multiple of `bases`. With
    `pairs`, neighbours of one name stem stay in the batch of the first of them."""
    rows = records.withColumn("_size", F.length("seq").cast("long"))
    if not pairs:
        summed = running_total(rows, order, "_size", "_before")
        return summed.withColumn("batch", F.expr(f"_before div {bases}")).drop("_size", "_before")
    runs = running_total(rows.withColumn("_stem", name_stem(F.col("name"))), order, "_size", "_before", also="_stem")
    return runs.withColumn("batch", F.expr(f"_run_before div {bases}")).drop("_size", "_before", "_stem", "_run_before")
