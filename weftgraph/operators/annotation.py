"""Repeat annotation of events, evaluation against a truth set, and what is made of merged calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.repeats import class_label, info, repeat_class
from ..sources.fasta import contig_name
from . import intervals


def label_lengths(hits: DataFrame, event: list[str], least: int, width: int) -> DataFrame:
    """(event..., label, covered): the length that the hits (event..., label, st, en) of one label cover together on an
    event, from `least` on."""
    return intervals.union_length(hits, [*event, "label"], width).select(*event, "label", F.col("length").alias("covered")).where(F.col("covered") >= least)


def decide_labels(lengths: DataFrame, events: DataFrame, event: list[str]) -> DataFrame:
    """events (event..., len) with `type`: the label that covers most of an event, or what its covered lengths say
    together. Labels with '_' are sums of a family; LCR and self count apart. Ties go to the label first in order."""
    low = F.col("label").isin("mini", "micro")
    own = ~F.col("label").isin("LCR", "self") & ~F.col("label").startswith("_")
    of = lambda name: F.coalesce(F.max(F.when(F.col("label") == name, F.col("covered"))), F.lit(0)).alias(f"_{name}")
    by = Window.partitionBy(*event).orderBy(F.desc("covered"), "label")
    ranked = lengths.where(own).withColumn("_r", F.row_number().over(by)).where("_r <= 2")
    top = ranked.groupBy(*event).agg(
        F.max(F.when(F.col("_r") == 1, F.col("label"))).alias("_label"), F.max(F.when(F.col("_r") == 1, F.col("covered"))).alias("_max"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("covered"))), F.lit(0)).alias("_max2")
    )
    sums = lengths.groupBy(*event).agg(*[of(x) for x in ("LCR", "self", "mini", "micro", "_alu", "_l1", "_inter", "_sat")], F.sum(F.when(own, F.col("covered")).otherwise(0)).alias("_sum"), F.sum(F.when(own & ~low, F.col("covered")).otherwise(0)).alias("_misc"))
    rows = events.join(sums, event, "left").join(top, event, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda c, x: n(c) >= F.col("len") * x
    tandem = F.coalesce(F.col("_label").isin("mini", "micro"), F.lit(False))
    kind = (
        F.when(share("_max", 0.7) & F.col("_label").isNotNull(), F.col("_label"))
        .when(share("_LCR", 0.7), F.when(tandem & (n("_max") >= (n("_mini") + n("_micro")) * 0.7), F.col("_label")).otherwise("lcr"))
        .when(tandem & (n("_max2") < n("_max") * 0.1), F.col("_label"))
        .when(F.col("__alu").isNotNull() & (n("__alu") > 0) & share("__alu", 0.7), "SINE/Alu")
        .when((n("__l1") > 0) & share("__l1", 0.7), "LINE/L1")
        .when((n("__inter") > 0) & share("__inter", 0.7), "inter")
        .when((n("__sat") > 0) & share("__sat", 0.5), "Satellite")
        .when(n("_misc") + n("_LCR") >= F.col("len") * 0.7, "mixed")
        .when(n("_sum") + n("_LCR") > F.col("len") * 0.05, "partial")
        .when((n("_self") > 0) & share("_self", 0.5), "self")
        .otherwise("none")
    )
    return rows.select(*events.columns, kind.alias("type"))


def class_table(events: DataFrame) -> DataFrame:
    """Counts, lengths and lengths without dust by class and number of alleles (2, 3, over 3). events: (ctg, n_paths,
    len_max, total, dust, type); gaps and unplaced contigs don't count, and unknown totals (below 0) have no length."""
    rows = events.where("type <> 'gap' AND ctg NOT RLIKE 'chrUn|_random'").withColumns({"class": repeat_class(F.col("type")), "_na": F.least("n_paths", F.lit(4))})
    clear = F.when((F.col("total") >= 0) & (F.col("dust") >= 0), F.col("total") - F.col("dust")).otherwise(0)
    kinds = {"n": F.lit(1), "len": F.col("len_max"), "clear": clear}
    sums = [F.coalesce(F.sum(F.when(F.col("_na") == k, value)), F.lit(0)).cast("long").alias(f"{name}{k}") for name, value in kinds.items() for k in (2, 3, 4)]
    return rows.groupBy("class").agg(*sums).withColumn("label", class_label(F.col("class")))


def frequency_lengths(segments: DataFrame, least: float) -> DataFrame:
    """(class, two, three, more): summed lengths of the segments (len, rank, ns, ac, n_alleles, type) off the reference
    whose alleles at least a share of the samples has, by the number of alleles."""
    rows = segments.where((F.col("rank") > 0) & (F.col("ns") > 0) & (F.col("ac") >= F.col("ns") * least)).withColumn("class", repeat_class(F.col("type")))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("len"))), F.lit(0)).cast("long")
    return rows.groupBy("class").agg(part(F.col("n_alleles") == 2).alias("two"), part(F.col("n_alleles") == 3).alias("three"), part(F.col("n_alleles") > 3).alias("more"))


def confusion(truth: DataFrame, calls: DataFrame, regions: DataFrame, keys: list[str], least: int, flank: int, width: int) -> DataFrame:
    """Missed true events and false calls by sign: (kind, wrong, total, rate), kind N or P for missed or false and A, D
    or I for all, deletions or insertions. Events (keys, st, en, diff, sign) count from `least` on where they and
    `flank` beside them lie in a region; a partner may be of any size."""

    def side(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        wide = a.where(F.col("diff") >= least).withColumns({"st": F.greatest(F.col("st") - flank, F.lit(0)), "en": F.col("en") + flank, "_id": F.xxhash64(*keys, "st", "en", "id")})
        tested = intervals.contained(wide, regions, keys, width)
        hit = intervals.overlap_join(tested.select(*keys, "st", "en", "_id"), b.select(*keys, "st", "en"), keys, width).select("_id").distinct()
        wrong = tested.join(hit.withColumn("_hit", F.lit(1)), "_id", "left").select("sign", F.when(F.col("_hit").isNull(), 1).otherwise(0).alias("wrong"))
        kinds = F.explode(F.array(F.lit("A"), F.when(F.col("sign") < 0, "D").otherwise("I")))
        sums = wrong.select("wrong", kinds.alias("k")).groupBy("k").agg(F.sum("wrong").alias("wrong"), F.count(F.lit(1)).alias("total"))
        return sums.select(F.concat(F.lit(name), "k").alias("kind"), "wrong", "total", F.round(F.col("wrong") / F.col("total"), 4).alias("rate"))

    return side(truth, calls, "N").unionByName(side(calls, truth, "P"))


def reliable_matches(alignments: DataFrame, low: float = 0.01, high: float = 0.1, least_quality: int = 5, least_block: int = 500) -> DataFrame:
    """(ctg, st, en) of primary alignments whose divergence (tag de) is in a range; without the tag they don't count."""
    kind, de = F.col("tags")["tp"]["value"], F.col("tags")["de"]["value"].try_cast("double")
    good = alignments.where(~F.coalesce(kind.rlike("^[SI]"), F.lit(False)) & (F.col("mapq") >= least_quality) & (F.col("blen") >= least_block))
    return good.where((de >= low) & (de <= high)).select(F.col("path").alias("ctg"), F.col("ps").alias("st"), F.col("pe").alias("en"))


def low_complexity(merged: DataFrame, sample: int = 0, extend: int = 5, least: float = 0.7, least_count: int = 5) -> DataFrame:
    """(ctg, st, en, longest) of merged bubbles (ctg, st, en, info, gts) that are of low complexity by annotation, or
    by dust in segmental duplications, and have two alleles or more among the frequent ones and a sample's own."""
    at = F.col("_i")
    rows = merged.withColumn("_i", info(F.col("info"))).where(at["ALEN"].isNotNull())
    number = lambda k: F.coalesce(at[k].try_cast("long"), F.lit(0))
    low = F.coalesce(at["ANNO"].rlike("^(lcr|mini|micro|ldust)$"), F.lit(False)) | (F.coalesce(at["ANNO"] == "segdup", F.lit(False)) & (number("LBUBBLE") > 0) & (number("LDUST") >= number("LBUBBLE") * least))
    own = F.regexp_extract(F.get("gts", F.lit(sample)), "^([0-9]+)", 1).try_cast("int")
    longs = lambda k: F.transform(F.split(at[k], ","), lambda x: x.try_cast("long"))
    picked = rows.where(low).withColumns({"_own": own, "_n": longs("AC"), "_l": longs("ALEN")}).where("_own IS NOT NULL")
    chosen = F.filter(F.zip_with("_l", F.transform("_n", lambda n, i: (n >= least_count) | (i == F.col("_own"))), lambda n, ok: F.when(ok, n)), lambda n: n.isNotNull())
    found = picked.withColumn("_c", chosen).where("size(_c) >= 2")
    return found.select(contig_name(F.col("ctg")).alias("ctg"), F.greatest(F.col("st") - extend, F.lit(0)).alias("st"), (F.col("en") + extend).alias("en"), F.greatest(F.array_max("_c"), F.col("en") - F.col("st")).alias("longest"))


def call_tables(calls: DataFrame, bubble: str) -> tuple[DataFrame, DataFrame]:
    """calls (bubble, sample, walk, length, strand, ctg, st, en) as the two tables of a database: call, with one row
    for each sample's call, and bwalk, with one for each walk of a bubble; wid numbers a bubble's walks by sample."""
    made = calls.where("walk IS NOT NULL")
    first = made.groupBy(bubble, "walk").agg(F.min("sample").alias("_s"), F.min_by("length", "sample").alias("len"))
    walks = first.withColumn("wid", F.row_number().over(Window.partitionBy(bubble).orderBy("_s", "walk")) - 1).select(F.col(bubble).alias("bid"), "wid", "len", "walk")
    call = made.withColumnRenamed(bubble, "bid").join(walks.select("bid", "wid", "walk"), ["bid", "walk"]).select("bid", "sample", "wid", "ctg", F.col("st").alias("start"), F.col("en").alias("end"), F.when(F.col("strand") == "+", 1).otherwise(-1).alias("strand"))
    return call, walks


def with_samples(lines: DataFrame, samples: list[str]) -> DataFrame:
    """Merged calls as text (value) with the samples' names in the line of column names."""
    head = "\t".join(["#CHROM", "START", "END", "INFO", "FORMAT", *samples])
    return lines.withColumn("value", F.when(F.col("value").rlike("^#[^#]|^#$"), F.lit(head)).otherwise(F.col("value")))
