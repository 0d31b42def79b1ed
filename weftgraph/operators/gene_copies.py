"""Copies of genes in an assembly: alignments claim places in order of their scores, in rounds of local maxima."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .lineage import cut, stored

#: Names of genes that no copies are counted for: accessions with a version, or bare gene identifiers. A fixed value.
NO_GENE = r"\|([A-Z]+\d*\.\d+|ENSG\d+)$"


def gene_hits(alignments: DataFrame, least_cover: float = 0.8, least_of_first: float = 0.85) -> DataFrame:
    """Alignments (hit, gene, qlen, qs, qe, cigar, ...) that cover enough of their gene, and nearly as much as the gene's
    first one does, with score and de; hit is their place in the file.

    Matches score 1 a base, every other operation of the CIGAR 5 and its length less; de counts each of these once."""
    span = F.col("qe") - F.col("qs")
    rows = alignments.where(~F.col("gene").rlike(NO_GENE) & (span >= F.col("qlen") * least_cover))
    first = F.first(span).over(Window.partitionBy("gene").orderBy("hit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_first", first).where(span >= F.col("_first") * least_of_first).drop("_first")
    parts = F.expr(r"regexp_extract_all(cigar, '(\\d+)[MIDNSHP=X]', 1)")
    kinds = F.expr(r"regexp_extract_all(cigar, '\\d+([MIDNSHP=X])', 1)")
    ops = F.zip_with(parts, kinds, lambda n, k: F.struct(n.cast("long").alias("n"), (k == "=").alias("same")))
    total = lambda f: F.aggregate("_ops", F.lit(0).cast("long"), lambda a, x: a + f(x))
    rows = rows.withColumn("_ops", ops)
    same, block = total(lambda x: F.when(x["same"], x["n"]).otherwise(0)), total(lambda x: F.when(x["same"], x["n"]).otherwise(1))
    score = total(lambda x: F.when(x["same"], x["n"]).otherwise(-5 - x["n"]))
    return rows.withColumns({"score": score, "de": (block - same) / block}).drop("_ops")


def hit_intervals(hits: DataFrame) -> DataFrame:
    """(hit, part, ctg, strand, st, en) of the contigs that each hit lies on. hits: (hit, strand, path, plen, ps, pe), a path
    being a contig's name or steps like >ctg:10-20. A step is cut at its start if the alignment starts there, and only
    else at its end."""
    one = hits.where(~F.col("path").rlike("^[<>]")).select("hit", F.lit(0).alias("part"), F.col("path").alias("ctg"), F.when(F.col("strand") == "+", 1).otherwise(-1).alias("strand"), F.col("ps").cast("long").alias("st"), F.col("pe").cast("long").alias("en"))
    walk = hits.where(F.col("path").rlike("^[<>]")).select("hit", "plen", "ps", "pe", F.posexplode(F.expr(r"regexp_extract_all(path, '[><][^\\s><]+:\\d+-\\d+', 0)")).alias("part", "_s"))
    field = lambda k: F.regexp_extract("_s", r"^([><])([^\s><]+):(\d+)-(\d+)$", k)
    walk = walk.withColumns({"_forward": field(1) == ">", "ctg": field(2), "_a": field(3).cast("long"), "_b": field(4).cast("long")})
    by = Window.partitionBy("hit").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = walk.withColumn("_l", F.sum(F.col("_b") - F.col("_a")).over(by) - (F.col("_b") - F.col("_a")))
    here = lambda c: (F.col(c) >= F.col("_l")) & (F.col(c) < F.col("_l") + F.col("_b") - F.col("_a"))
    st = F.when(here("ps"), F.when(F.col("_forward"), F.col("_a") + F.col("ps")).otherwise(F.col("_a"))).when(here("pe") & ~F.col("_forward"), F.col("_a") + F.col("plen") - F.col("pe")).otherwise(F.col("_a"))
    en = F.when(here("ps"), F.when(F.col("_forward"), F.col("_b")).otherwise(F.col("_b") - F.col("ps"))).when(here("pe") & F.col("_forward"), F.col("_a") + F.col("pe") - F.col("_l")).otherwise(F.col("_b"))
    return one.unionByName(walk.select("hit", "part", "ctg", F.when(F.col("_forward"), 1).otherwise(-1).alias("strand"), st.alias("st"), en.alias("en")))


def claim(hits: DataFrame, parts: DataFrame, sources: DataFrame | None = None, most_claimed: float = 0.5, width: int = 1 << 14) -> DataFrame:
    """hits (hit, gene, score) with claimed, length and good: a hit is good if less than most_claimed of its intervals is
    claimed on the same strand when its turn comes; then its intervals are claimed. Turns go by score, ties by hit.

    parts: (hit, part, ctg, strand, st, en); sources: (gene, ctg, st, en), where the genes come from: an interval that lies
    to over 99% in its own gene's source is claimed from the start. A round decides every hit that overlaps no open
    one of an earlier turn, so that the outcome is that of the turns one by one, and rounds are as many as the
    longest chain of such overlaps."""
    own = parts
    if sources is not None:
        home = hits.select("hit", "gene").join(sources.select("gene", F.col("ctg").alias("_c"), F.col("st").alias("_st"), F.col("en").alias("_en")), "gene").drop("gene")
        own = own.join(home, "hit", "left")
        shared = F.least("en", "_en") - F.greatest("st", "_st")
        own = own.withColumn("free", ~F.coalesce((F.col("ctg") == F.col("_c")) & (shared > 0) & (shared > (F.col("en") - F.col("st")) * 0.99), F.lit(False))).drop("_c", "_st", "_en")
    else:
        own = own.withColumn("free", F.lit(True))
    turn = hits.select("hit", "score")
    length = F.sum(F.col("en") - F.col("st")).over(Window.partitionBy("hit"))
    own = stored(own.join(turn, "hit").withColumn("length", length), "hit-intervals")
    mine = own.select("ctg", "strand", "st", "en", "hit", "part", "score", "length")
    other = own.select("ctg", "strand", "st", "en", F.col("hit").alias("by"), F.col("score").alias("by_score"), F.col("length").alias("by_length"), "free")
    met = intervals.overlap_join(mine, other, ["ctg", "strand"], width)
    earlier = (F.col("by_score") > F.col("score")) | ((F.col("by_score") == F.col("score")) & (F.col("by") < F.col("hit")))
    met = cut(met.where(earlier | ~F.col("free")).select("hit", "part", "by", "length", "by_length", "free", F.greatest("st", "b_st").alias("st"), F.least("en", "b_en").alias("en")))
    # told: whether `by` has claimed its intervals, null until that is decided. Hits that meet none before them are
    # decided at once, so that rounds hold the others alone, and of these only those that still wait
    named = met.select(F.col("hit").alias("by"), F.lit(True).alias("_n")).distinct()
    told = F.when(~F.col("free"), F.lit(True)).when(F.col("_n").isNull(), F.lit(0) < F.col("by_length") * most_claimed)
    state = met.join(named, "by", "left").select("hit", "part", "by", "length", "st", "en", told.alias("told"))
    waits, verdicts = F.max(F.col("told").isNull()).over(Window.partitionBy("hit")), []
    while True:
        state = cut(state.withColumn("_waits", waits))
        if state.isEmpty():
            break
        ready = state.where("NOT _waits")
        covered = intervals.union_length(ready.where("told").select("hit", "part", "st", "en"), ["hit", "part"]).groupBy("hit").agg(F.sum("length").alias("claimed"))
        decided = ready.groupBy("hit").agg(F.max("length").alias("length")).join(covered, "hit", "left").withColumn("claimed", F.coalesce("claimed", F.lit(0).cast("long")))
        decided = cut(decided.select("hit", "claimed", (F.col("claimed") < F.col("length") * most_claimed).alias("good")))
        verdicts = [*verdicts, decided] if len(verdicts) < 16 else [cut(reduce(DataFrame.unionByName, [*verdicts, decided]))]
        state = state.where("_waits").join(decided.select(F.col("hit").alias("by"), F.col("good").alias("_g")), "by", "left").select("hit", "part", "by", "length", "st", "en", F.coalesce("told", "_g").alias("told"))
    sized = hits.join(own.groupBy("hit").agg(F.max("length").alias("length")), "hit", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))
    free = (F.lit(0) < F.col("length") * most_claimed).alias("good")
    if not verdicts:
        return sized.select("*", F.lit(0).cast("long").alias("claimed"), free)
    done = reduce(DataFrame.unionByName, verdicts).withColumnsRenamed({"claimed": "_claimed", "good": "_good"})
    return sized.join(done, "hit", "left").select(*sized.columns, F.coalesce("_claimed", F.lit(0).cast("long")).alias("claimed"), F.coalesce("_good", free).alias("good"))


def copy_counts(claimed: DataFrame) -> DataFrame:
    """(gene, n_hits, n_good)."""
    return claimed.groupBy("gene").agg(F.count(F.lit(1)).alias("n_hits"), F.count_if("good").alias("n_good"))
