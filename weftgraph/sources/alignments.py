"""Alignment and annotation text: GAF, PAF, BED, repeat tables and VCF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nt, tags

GAF = "qname string, qlen long, qs long, qe long, strand string, path string, plen long, ps long, pe long, mlen long, blen long, mapq int".split(", ")
#: name of a BED-like layout and its columns
LAYOUTS = {
    "bed": "ctg string, st long, en long",
    "segments": "ctg string, st long, en long, seg string, rank int",
    "bubbles": "ctg string, st long, en long, n_seg int, n_paths int, is_inv int, len_min long, len_max long, x1 string, x2 string, x3 string, segs string, seq_min string, seq_max string",
    "calls": "ctg string, st long, en long, src string, sink string, call string",
    "genes": "ctg string, st long, en long, gene string, score string, strand string",
    "lengths": "ctg string, length long",
    "motifs": "ctg string, st long, en long, score string, motif_len int",
    "centromeres": "ctg string, st long, en long, label int",
    "map": "ctg string, pos long, value double",
}


def read_table(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """TAB-separated text of a known layout; lines starting with # are skipped."""
    return spark.read.schema(LAYOUTS[layout]).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """GAF or PAF: the twelve columns and the tags. Lines that start with * belong to the alignment before and are left out."""
    f = spark.read.text(path).where("value NOT LIKE '*%'").select(F.split("value", "\t").alias("f")).where("size(f) >= 12")
    return f.select(*[F.col("f")[k].cast(c.split()[1]).alias(c.split()[0]) for k, c in enumerate(GAF)], tags.parse(F.slice("f", 13, F.greatest(F.size("f") - 12, F.lit(0)))).alias("tags"))


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """Repeat annotation in columns of white space: (key, st, en, divergence, repeat, class), 0-based."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) >= 15 AND f[0] RLIKE '^[0-9]+$'")
    return f.select(F.col("f")[4].alias("key"), (F.col("f")[5].cast("long") - 1).alias("st"), F.col("f")[6].cast("long").alias("en"), F.col("f")[1].cast("double").alias("divergence"), F.col("f")[9].alias("repeat"), F.col("f")[10].alias("class"))


def gaf_lines(alignments: DataFrame) -> DataFrame:
    """One line for each alignment: the twelve columns, then the tags; '*' for what is null."""
    columns = [F.coalesce(F.col(c.split()[0]).cast("string"), F.lit("*")) for c in GAF]
    return alignments.select(F.concat_ws("\t", *columns, tags.render(F.col("tags"))).alias("value"))


def with_unmapped(alignments: DataFrame, queries: DataFrame) -> DataFrame:
    """alignments and a row of nulls for each query (qname, qlen) without one."""
    missing = queries.select("qname", "qlen").join(alignments.select("qname"), "qname", "left_anti")
    return alignments.unionByName(missing, allowMissingColumns=True)


def path_steps(path: Column) -> Column:
    """'>a<b' as an array of (rev, name)."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"([><][^\s><]+)"), F.lit(1)), lambda s: F.struct((F.substring(s, 1, 1) == "<").alias("rev"), s.substr(F.lit(2), F.length(s)).alias("name")))


def call_lines(calls: DataFrame) -> DataFrame:
    """Bubble calls as BED lines; '.' for no call, '*' for a walk without segments."""
    call = F.when(F.col("qname").isNull(), F.lit(".")).otherwise(F.concat_ws(":", F.when(F.col("walk") == "", "*").otherwise(F.col("walk")), *[F.col(c).cast("string") for c in ("wlen", "strand", "qname", "qs", "qe")]))
    return calls.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("ctg", "st", "en", "src", "sink")], call).alias("value"))


def chain_lines(chains: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Linear chains (aln, step, v, name, len, n, mini_first, mini_last, span, ts, te, qs, qe) as lines that follow their
    alignment's, with the divergence; with anchors (aln, step, x, y) also the steps between them. n of 0: no anchors."""
    n = F.col("mini_last") - F.col("mini_first") + 1
    div = nt.divergence(n, F.col("n"), F.col("span"))
    shown = F.when(n == F.col("n"), "0").otherwise(F.format_string("%.4f", div))
    text = lambda *names: [F.col(c).cast("string") for c in names]
    head = [F.lit("*"), F.concat(F.when(F.col("v") % 2 == 1, "<").otherwise(">"), "name"), *text("len", "n")]
    if anchors is not None:
        by = Window.partitionBy("aln", "step").orderBy("x", "y")
        gaps = anchors.withColumns({"_dx": F.col("x") - F.lag("x").over(by), "_dy": F.col("y") - F.lag("y").over(by), "_k": F.row_number().over(by)}).where("_dx IS NOT NULL")
        listed = F.sort_array(F.collect_list(F.struct("_k", "_dx", "_dy")))
        joined = lambda c: F.array_join(F.transform(listed, lambda x: x[c].cast("string")), ",")
        chains = chains.join(gaps.groupBy("aln", "step").agg(joined("_dx").alias("_xs"), joined("_dy").alias("_ys")), ["aln", "step"], "left")
    more = [*text("span"), F.coalesce("_xs", F.lit("")), F.coalesce("_ys", F.lit(""))] if anchors is not None else []
    line = F.when(F.col("n") > 0, F.concat_ws("\t", *head, shown, *text("ts", "te", "qs", "qe"), *more)).otherwise(F.concat_ws("\t", *head))
    return chains.select("aln", "step", line.alias("value"))


def vcf_lines(merged: DataFrame, samples: list[str], source: str = "weftgraph") -> DataFrame:
    """Merged bubbles (ctg, st, en, ns, na, ac, awalk, gt) as VCF 4.2 lines with symbolic alleles, header first."""
    head = ["##fileformat=VCFv4.2", f"##source={source}", '##INFO=<ID=END,Number=1,Type=Integer,Description="End">', '##INFO=<ID=NS,Number=1,Type=Integer,Description="Samples called">', '##INFO=<ID=AC,Number=.,Type=Integer,Description="Allele counts">', '##INFO=<ID=AWALK,Number=.,Type=String,Description="Walks">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    top = merged.sparkSession.createDataFrame([(k, "", 0, x) for k, x in enumerate(head)], "_k int, _c string, _p long, value string")
    alts = F.when(F.col("na") > 1, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("na").cast("int") - 1, F.lit(1))), lambda i: F.concat(F.lit("<X:"), i.cast("string"), F.lit(">"))), ",")).otherwise(F.lit("."))
    info = F.concat(F.lit("END="), F.col("en").cast("string"), F.lit(";NS="), F.col("ns").cast("string"), F.lit(";AC="), F.col("ac"), F.lit(";AWALK="), F.col("awalk"))
    rows = merged.select(F.lit(len(head)).alias("_k"), F.col("ctg").alias("_c"), F.col("st").alias("_p"), F.concat_ws("\t", "ctg", F.col("st").cast("string"), F.lit("."), F.lit("N"), alts, F.lit("."), F.lit("."), info, F.lit("GT"), F.translate("gt", ",", "\t")).alias("value"))
    return top.unionByName(rows)
