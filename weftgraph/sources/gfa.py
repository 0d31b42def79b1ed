"""GFA and rGFA graphs: lines S and L to tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar, nt, tags
from ..operators.graph import SequenceGraph, flip, number_segments
from ..operators.ordering import dense_numbers


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (plain or gzipped) with their fields; `line` orders them: the file, then the place in it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return lines.where(F.length("value") >= 3).where(F.substring("value", 2, 1) == "\t").select(F.struct("_file", "_block", "_at").alias("line"), F.split("value", "\t").alias("f"))


def overlap(text: Column) -> Column:
    """(ov, ow) of an overlap: nulls for '*', 0 where it is missing, a CIGAR's lengths on both sides, or 'a:b'."""
    runs = cigar.parse(text)
    of = lambda ops: cigar.total(runs, ops)
    pair = F.split(text, ":")
    both = F.struct(pair[0].try_cast("long").alias("ov"), F.try_element_at(pair, F.lit(2)).try_cast("long").alias("ow"))
    none = F.struct(F.lit(None).cast("long").alias("ov"), F.lit(None).cast("long").alias("ow"))
    zero = F.struct(F.lit(0).cast("long").alias("ov"), F.lit(0).cast("long").alias("ow"))
    return F.when(text.isNull() | (text == ""), zero).when(text == "*", none).when(text.contains(":"), both).otherwise(F.struct(of("MDN=X").alias("ov"), of("MIS=X").alias("ow")))


def parse_gfa(lines: DataFrame) -> SequenceGraph:
    """Segments numbered by first appearance and arcs, as given: not yet normalized."""
    s = lines.where("f[0] = 'S' AND size(f) >= 3").select("line", F.col("f")[1].alias("name"), F.col("f")[2].alias("seq"), tags.parse(F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0)))).alias("tags"))
    l_ = lines.where("f[0] = 'L' AND size(f) >= 5").select("line", *[F.col("f")[k].alias(c) for k, c in ((1, "a"), (2, "ao"), (3, "b"), (4, "bo"))], F.try_element_at("f", F.lit(6)).alias("o"), tags.parse(F.slice("f", 7, F.greatest(F.size("f") - 6, F.lit(0)))).alias("tags")).where("ao IN ('+', '-') AND bo IN ('+', '-')")
    names = s.select("name", F.col("line")).unionByName(l_.select(F.explode(F.array("a", "b")).alias("name"), "line"))
    ids = number_segments(names, ["line"])
    long = lambda k: tags.get(F.col("tags"), k).try_cast("long")
    first = s.groupBy("name").agg(F.min_by(F.struct("seq", "tags"), "line").alias("x")).select("name", "x.*")
    seq = F.when(F.col("seq") != "*", nt.upper(F.col("seq")))
    # L1 and L2, the parts of the two segments outside the overlap, tell how long these are at least
    known = l_.where(F.map_contains_key("tags", F.lit("L1")) | F.map_contains_key("tags", F.lit("L2"))).withColumn("_o", overlap(F.col("o")))
    known = known.select(F.explode(F.array(F.struct(F.col("a").alias("name"), (F.col("_o.ov") + long("L1")).alias("_l")), F.struct(F.col("b").alias("name"), (F.col("_o.ow") + long("L2")).alias("_l")))).alias("_x")).select("_x.*")
    longest = known.where("_l IS NOT NULL").groupBy("name").agg(F.max("_l").alias("_l"))
    segments = ids.join(first, "name", "left").join(longest, "name", "left").select("seg", "name", seq.alias("seq"), F.greatest(F.coalesce(F.length(seq).cast("long"), long("LN"), F.lit(0).cast("long")), "_l").alias("len"), tags.get(F.col("tags"), "SN").alias("sn"), F.coalesce(long("SO"), F.lit(0).cast("long")).alias("so"), F.coalesce(long("SR"), F.lit(0).cast("long")).alias("sr"), tags.drop(F.col("tags"), "LN", "SN", "SO", "SR").alias("tags"))
    vertex = lambda seg, o: F.col(seg) * 2 + F.when(F.col(o) == "-", 1).otherwise(0)
    arcs = l_.withColumn("_o", overlap(F.col("o"))).withColumn("link", F.xxhash64("a", "ao", "b", "bo", "o", "line.*"))
    arcs = arcs.join(ids.select(F.col("name").alias("a"), F.col("seg").alias("_sa")), "a").join(ids.select(F.col("name").alias("b"), F.col("seg").alias("_sb")), "b")
    arcs = arcs.select(vertex("_sa", "ao").alias("v"), vertex("_sb", "bo").alias("w"), "_o.ov", "_o.ow", F.coalesce(long("SR"), F.lit(-1).cast("long")).alias("rank"), "link", F.lit(False).alias("comp"), tags.drop(F.col("tags"), "SR", "L1", "L2").alias("tags"))
    return SequenceGraph(segments, arcs)


def read_gfa(spark: SparkSession, path: str) -> SequenceGraph:
    return parse_gfa(read_lines(spark, path))


def fasta_graph(records: DataFrame) -> SequenceGraph:
    """FASTA records (ord, name, seq) as a graph of unlinked segments s1, s2, ... in order of the records."""
    numbered = dense_numbers(records.select("ord", "name", "seq"), ["ord"], "seg")
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<type:string,value:string>>>"))
    segments = numbered.select("seg", F.concat(F.lit("s"), (F.col("seg") + 1).cast("string")).alias("name"), nt.upper(F.col("seq")).alias("seq"), F.length("seq").cast("long").alias("len"), F.col("name").alias("sn"), F.lit(0).cast("long").alias("so"), F.lit(0).cast("long").alias("sr"), empty.alias("tags"))
    arcs = records.sparkSession.createDataFrame([], "v long, w long, ov long, ow long, rank long, link long, comp boolean, tags map<string,struct<type:string,value:string>>")
    return SequenceGraph(segments, arcs)


def gfa_lines(graph: SequenceGraph) -> DataFrame:
    """The lines of a graph, segments first; of each link one strand is written."""
    s = graph.segments
    parts = [F.lit("S"), F.col("name"), F.coalesce("seq", F.lit("*")), F.concat(F.lit("LN:i:"), "len"), F.concat(F.lit("SN:Z:"), "sn"), F.when(F.col("sn").isNotNull(), F.concat(F.lit("SO:i:"), "so")), F.when(F.col("sn").isNotNull(), F.concat(F.lit("SR:i:"), "sr"))]
    text = lambda parts: F.concat_ws("\t", *parts, tags.render(F.col("tags")))
    lines = s.select(F.lit(0).alias("_k"), F.col("seg").alias("_a"), F.lit(0).cast("long").alias("_b"), text(parts).alias("value"))
    hairpin = F.col("v") == flip("w")  # its own complement: one line
    arcs = graph.arcs.where(~F.col("comp") | hairpin)
    name = s.select(F.col("seg").alias("_s"), F.col("name").alias("_n"), F.col("len").alias("_l"))
    sign = lambda v: F.when(F.col(v).bitwiseAND(F.lit(1).cast("long")) == 1, "-").otherwise("+")
    a = arcs.join(name, F.shiftright("v", 1) == F.col("_s")).withColumnRenamed("_n", "_from").drop("_s").withColumnRenamed("_l", "_from_len").join(name, F.shiftright("w", 1) == F.col("_s"))
    parts = [F.lit("L"), F.col("_from"), sign("v"), F.col("_n"), sign("w"), F.concat(F.least("ov", "ow").cast("string"), F.lit("M")), F.when(F.col("rank") >= 0, F.concat(F.lit("SR:i:"), "rank")), F.concat(F.lit("L1:i:"), F.col("_from_len") - F.col("ov")), F.concat(F.lit("L2:i:"), F.col("_l") - F.col("ow"))]
    return lines.unionByName(a.select(F.lit(1).alias("_k"), F.col("v").alias("_a"), F.col("w").alias("_b"), text(parts).alias("value")))


def write_gfa(graph: SequenceGraph, path: str) -> None:
    """Text files, in order over the parts: segments by number, then links."""
    gfa_lines(graph).repartitionByRange("_k", "_a", "_b").sortWithinPartitions("_k", "_a", "_b", "value").select("value").write.text(path)
