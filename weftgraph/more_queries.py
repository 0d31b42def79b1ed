"""Driver queries of files, chains, annotation and generation; registered beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import cigar, nt, repeats, tags
from .operators import annotation, coverage, generation, graph, ordering, seeding, summary
from .operators.lineage import cut, shared_path
from .queries import ARCS, SECONDS, STEPS, _DNA, as_arcs, event_times, event_windows, nation_graph, query, table, walk_arcs, walk_steps
from .sources import alignments, fasta, gfa, stable

T = "chr(9)"


def written(spark, lines: DataFrame, name: str) -> str:
    """Lines (value) as text files in the shared folder."""
    path = shared_path(spark, name)
    lines.select("value").write.text(path)
    return path


# --- files ---------------------------------------------------------------------------------------------------
@query(
    """SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE upper(repeat('acgtn', (p_size % 4 + 1)::INT)) END AS seq,
    greatest(CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE 5 * (p_size % 4 + 1) END, coalesce(l, 0))::BIGINT AS len, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS sn, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE 0 END::BIGINT AS so, CASE WHEN p_partkey % 3 = 0 THEN p_size % 2 ELSE 0 END::BIGINT AS sr
    FROM part LEFT JOIN (SELECT p_partkey, max(2 + 30) AS l FROM part WHERE p_partkey % 7 = 0 GROUP BY ALL) USING (p_partkey)"""
)
def gfa_segments(spark, sf):
    """Segment lines written and read: upper case, lengths from LN, sequences and L1, stable names (SC-1 to SC-3, GR-4, FN-3)."""
    p = table(spark, sf, "part")
    third = F.col("p_partkey") % 3 == 0
    own = F.when(third, F.concat(F.lit("\tSN:Z:"), "p_brand", F.lit("\tSO:i:"), "p_partkey", F.lit("\tSR:i:"), (F.col("p_size") % 2).cast("string"))).otherwise("")
    seq = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("*\tLN:i:"), "p_size")).otherwise(F.repeat(F.lit("acgtn"), (F.col("p_size") % 4 + 1).cast("int")))
    lines = p.select(F.concat(F.lit("S\tp"), "p_partkey", F.lit("\t"), seq, own, F.lit("\tXX:Z:a b")).alias("value"))
    links = p.where("p_partkey % 7 = 0").select(F.concat(F.lit("L\tp"), "p_partkey", F.lit("\t+\tp"), "p_partkey", F.lit("\t-\t2:2\tL1:i:30")).alias("value"))
    return gfa.read_gfa(spark, written(spark, lines.unionByName(links), "gfa")).segments.select("name", "seq", "len", "sn", "so", "sr")


@query(
    f"""WITH a AS (SELECT *, v % 4 AS k FROM {ARCS} WHERE n >= 1) SELECT 'p' || (v >> 1) AS a, 'p' || (w >> 1) AS b, v % 2 AS ra, w % 2 AS rb, CASE k WHEN 0 THEN NULL WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 0 END::BIGINT AS ov, CASE k WHEN 0 THEN NULL WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 0 END::BIGINT AS ow,
    CASE WHEN rank % 2 = 0 THEN rank ELSE -1 END::BIGINT AS rank FROM a"""
)
def gfa_links(spark, sf):
    """Link lines written and read: orientations, the forms of an overlap, ranks (SC-3, GR-4, GR-5)."""
    k = F.col("v") % 4
    ov = F.when(k == 0, "\t*").when(k == 1, "\t5M2=").when(k == 2, "\t3:4").otherwise("")
    sign = lambda c: F.when(F.col(c) % 2 == 1, "-").otherwise("+")
    rank = F.when(F.col("rank") % 2 == 0, F.concat(F.when(k == 3, "\t").otherwise(""), F.lit("\tSR:i:"), "rank")).otherwise("")
    lines = walk_arcs(spark, sf).select(F.concat(F.lit("L\tp"), F.shiftright("v", 1), F.lit("\t"), sign("v"), F.lit("\tp"), F.shiftright("w", 1), F.lit("\t"), sign("w"), ov, rank).alias("value"))
    g = gfa.read_gfa(spark, written(spark, lines, "gfa"))
    name = cut(g.segments.select(F.col("seg"), F.col("name")))
    a = g.arcs.join(name.toDF("_s", "a"), F.shiftright("v", 1) == F.col("_s")).drop("_s").join(name.toDF("_s", "b"), F.shiftright("w", 1) == F.col("_s"))
    return a.select("a", "b", (F.col("v") % 2).alias("ra"), (F.col("w") % 2).alias("rb"), "ov", "ow", "rank")


NATIONS = """n AS (SELECT n_nationkey::BIGINT AS seg, n_regionkey::VARCHAR AS sn, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS next FROM nation),
    s AS (SELECT s_suppkey + 1000 AS sup, seg, next FROM supplier JOIN n ON s_nationkey = seg WHERE next IS NOT NULL),
    g AS (SELECT seg, 4::BIGINT AS len, sn, seg * 4 AS so, 0 AS sr FROM n UNION ALL SELECT sup, sup % 7 + 1, 's', 0, 1 FROM s), l AS (SELECT seg AS a, next AS b FROM n WHERE next IS NOT NULL UNION ALL SELECT seg, sup FROM s UNION ALL SELECT sup, next FROM s)"""


@query(
    f"""WITH {NATIONS} SELECT 'S' || {T} || 's' || seg || {T} || repeat('A', len::INT) || {T} || 'LN:i:' || len || {T} || 'SN:Z:' || sn || {T} || 'SO:i:' || so || {T} || 'SR:i:' || sr AS value FROM g
    UNION ALL SELECT 'L' || {T} || 's' || a || {T} || '+' || {T} || 's' || b || {T} || '+' || {T} || '0M' || {T} || 'SR:i:0' || {T} || 'L1:i:' || x.len || {T} || 'L2:i:' || y.len FROM l JOIN g x ON a = x.seg JOIN g y ON b = y.seg"""
)
def gfa_text(spark, sf):
    """The graph of nations as lines (SC-11)."""
    g = nation_graph(spark, sf)
    return gfa.gfa_lines(graph.SequenceGraph(g.segments, g.arcs.withColumn("tags", F.lit(None).cast(tags.KIND)))).select("value")


READS = "(SELECT conv_id, turn, 'c' || conv_id || '_' || turn AS name, role AS comment, translate(regexp_replace(text, '\\s', '', 'g'), 'Uu', 'Tt') AS seq, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord FROM conversations WHERE text IS NOT NULL)"


def read_lines_of(spark, sf, form) -> DataFrame:
    """The conversations' turns as records of a text form, in order over files."""
    rows = table(spark, sf, "conversations").where("text IS NOT NULL").withColumn("name", F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn"))
    return rows.repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").select(form.alias("value"))


def fasta_reads(spark, sf) -> DataFrame:
    return fasta.read_fasta(spark, written(spark, read_lines_of(spark, sf, F.concat(F.lit(">"), "name", F.lit(" "), "role", F.lit("\n"), "text")), "fasta"))


@query(f"SELECT name, comment, seq FROM {READS}")
def fasta_scan(spark, sf):
    """FASTA records written over several files and read (SC-7)."""
    return fasta_reads(spark, sf).select("name", "comment", "seq")


@query(f"SELECT 's' || (ord + 1) AS name, name AS sn, translate(seq, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq, length(seq)::BIGINT AS len FROM {READS}")
def fasta_as_graph(spark, sf):
    """FASTA records as segments numbered in order of the records (SC-4, GR-1)."""
    return gfa.fasta_graph(fasta_reads(spark, sf)).segments.select("name", "sn", "seq", "len")


@query(f"SELECT name, comment, seq, repeat('I', length(seq)::INT) AS qual FROM {READS} WHERE seq <> ''")
def fastq_scan(spark, sf):
    """FASTQ records written over several files and read by lines (SC-7)."""
    seq = F.translate(F.regexp_replace("text", r"\s", ""), "Uu", "Tt")
    lines = read_lines_of(spark, sf, F.concat(F.lit("@"), "name", F.lit(" "), "role", F.lit("\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(seq))))
    return fasta.read_fastq(spark, written(spark, lines, "fastq")).where("seq <> ''").select("name", "comment", "seq", "qual")


@query("SELECT conv_id, turn, ((sum(length(text)) OVER (ORDER BY conv_id, turn) - length(text)) // 5000)::BIGINT AS batch FROM conversations")
def mini_batches(spark, sf):
    """Turns in batches of five thousand characters (SC-8, STR-1)."""
    rows = table(spark, sf, "conversations").withColumnRenamed("text", "seq")
    return fasta.batches(rows, ["conv_id", "turn"], 5000).select("conv_id", "turn", "batch")


@query(
    """WITH r AS (SELECT *, sum(new) OVER (ORDER BY conv_id, turn) AS run FROM (SELECT *, CASE WHEN role = lag(role) OVER (ORDER BY conv_id, turn) THEN 0 ELSE 1 END AS new, sum(length(text)) OVER (ORDER BY conv_id, turn) - length(text) AS before FROM conversations))
    SELECT conv_id, turn, (min(before) OVER (PARTITION BY run) // 3000)::BIGINT AS batch FROM r"""
)
def mini_batches_of_mates(spark, sf):
    """The same with neighbours of one name kept together (SC-8)."""
    rows = table(spark, sf, "conversations").withColumnRenamed("text", "seq").withColumn("name", F.concat("role", F.lit("/"), (F.col("turn") % 2 + 1).cast("string")))
    return fasta.batches(rows, ["conv_id", "turn"], 3000, pairs=True).select("conv_id", "turn", "batch")


ALIGNED = """(SELECT 'q' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS qname, 100 + l_linenumber AS qlen, l_linenumber AS qs, 50 + l_linenumber AS qe, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, '>p' || l_partkey AS path, 500 AS plen,
    10 AS ps, (70 + l_partkey % 900)::BIGINT AS pe, 45 AS mlen, (60 + l_partkey % 900)::BIGINT AS blen, l_suppkey % 61 AS mapq, CASE WHEN l_linestatus = 'O' THEN 'P' ELSE 'S' END AS tp, l_partkey % 150 AS de FROM lineitem)"""


def aligned(spark, sf) -> DataFrame:
    n = lambda c, t="long": F.expr(c).cast(t)
    tag = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("q"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey", F.lit("_"), "l_suppkey").alias("qname"), n("100 + l_linenumber").alias("qlen"), n("l_linenumber").alias("qs"), n("50 + l_linenumber").alias("qe"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), F.concat(F.lit(">p"), "l_partkey").alias("path"), n("500").alias("plen"), n("10").alias("ps"), n("70 + l_partkey % 900").alias("pe"), n("45").alias("mlen"), n("60 + l_partkey % 900").alias("blen"), n("l_suppkey % 61", "int").alias("mapq"),
        F.map_from_arrays(F.array(F.lit("tp"), F.lit("de")), F.array(tag("A", F.when(F.col("l_linestatus") == "O", "P").otherwise("S")), tag("f", F.concat(F.lit("0."), F.lpad((F.col("l_partkey") % 150).cast("string"), 3, "0"))))).alias("tags"),
    )


@query(
    f"""SELECT qname || {T} || qlen || {T} || qs || {T} || qe || {T} || strand || {T} || path || {T} || plen || {T} || ps || {T} || pe || {T} || mlen || {T} || blen || {T} || mapq || {T} || 'de:f:0.' || lpad(de::VARCHAR, 3, '0') || {T} || 'tp:A:' || tp AS value FROM {ALIGNED}
    UNION ALL SELECT 'none' || c_custkey || {T} || c_custkey || repeat({T} || '*', 10) FROM customer"""
)
def gaf_text(spark, sf):
    """Alignments and queries without one as lines, written and read once between (SC-12, SC-16, SC-19)."""
    path = written(spark, alignments.gaf_lines(aligned(spark, sf)), "gaf")
    missing = table(spark, sf, "customer").select(F.concat(F.lit("none"), "c_custkey").alias("qname"), F.col("c_custkey").cast("long").alias("qlen"))
    return alignments.gaf_lines(alignments.with_unmapped(alignments.read_alignments(spark, path), missing))


@query(f"SELECT path AS ctg, ps AS st, pe AS en FROM {ALIGNED} WHERE tp = 'P' AND mapq >= 5 AND blen >= 500 AND de / 1000.0 BETWEEN 0.01 AND 0.1")
def paf_divergent(spark, sf):
    """Long primary alignments of some divergence (FL-12, FL-13, FL-4)."""
    return annotation.reliable_matches(aligned(spark, sf))


CALLED = f"(SELECT {SECONDS} // 86400 AS bid, user_id AS sample, string_agg(event_type, '>' ORDER BY ts, event_id) AS walk, count(*) AS length, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 'u' || user_id AS ctg, min({SECONDS}) AS st, max({SECONDS}) AS en FROM events GROUP BY 1, 2)"


def called(spark, sf) -> DataFrame:
    e = event_times(spark, sf).groupBy(F.expr("st div 86400").alias("bid"), F.col("user_id").alias("sample"))
    walk = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ">")
    return e.agg(walk.alias("walk"), F.count(F.lit(1)).alias("length"), F.min("st").alias("st"), F.max("st").alias("en")).withColumns({"strand": F.when(F.col("sample") % 2 == 0, "+").otherwise("-"), "ctg": F.concat(F.lit("u"), "sample")})


@query(f"SELECT 'd' || {T} || bid || {T} || bid + 1 || {T} || '>a' || {T} || '>b' || {T} || CASE WHEN sample % 5 = 0 THEN '.' ELSE CASE WHEN sample % 7 = 0 THEN '*' ELSE walk END || ':' || length || ':' || strand || ':' || ctg || ':' || st || ':' || en END AS value FROM {CALLED}")
def call_text(spark, sf):
    """Calls of bubbles as lines (SC-15)."""
    c = called(spark, sf).withColumns({"qname": F.when(F.col("sample") % 5 != 0, F.col("ctg")), "walk": F.when(F.col("sample") % 7 == 0, "").otherwise(F.col("walk"))})
    return alignments.call_lines(c.select(F.lit("d").alias("ctg"), F.col("bid").alias("_b"), (F.col("bid") + 1).alias("_e"), F.lit(">a").alias("src"), F.lit(">b").alias("sink"), "walk", F.col("length").alias("wlen"), "strand", "qname", F.col("st").alias("qs"), F.col("en").alias("qe")).withColumnsRenamed({"_b": "st", "_e": "en"}))


WIDS = f"(SELECT bid, walk, row_number() OVER (PARTITION BY bid ORDER BY min(sample), walk) - 1 AS wid, arg_min(length, sample) AS len FROM {CALLED} GROUP BY bid, walk)"


@query(f"SELECT c.bid, sample, wid, ctg, st AS start, en AS \"end\", CASE strand WHEN '+' THEN 1 ELSE -1 END AS strand FROM {CALLED} c JOIN {WIDS} w ON c.bid = w.bid AND c.walk = w.walk")
def call_table(spark, sf):
    """The table of calls (SC-18)."""
    return annotation.call_tables(called(spark, sf), "bid")[0]


@query(f"SELECT bid, wid, len, walk FROM {WIDS}")
def walk_table(spark, sf):
    """The table of walks (SC-18)."""
    return annotation.call_tables(called(spark, sf), "bid")[1]


@query(
    """WITH a AS (SELECT l_orderkey AS aln, l_partkey AS x, l_suppkey AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem),
    d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM a WINDOW w AS (PARTITION BY aln ORDER BY x, y, k)),
    c AS (SELECT aln, count(*) AS n, min(x) AS ts, max(x) AS te, min(y) AS qs, max(y) AS qe, coalesce(string_agg(dx, ',' ORDER BY k), '') AS xs, coalesce(string_agg(dy, ',' ORDER BY k), '') AS ys FROM d GROUP BY aln)
    SELECT '*' || chr(9) || (CASE WHEN aln % 2 = 1 THEN '<' ELSE '>' END) || 's' || aln || chr(9) || '900' || chr(9) || n || chr(9) || (CASE WHEN aln % 4 = 0 THEN '0' ELSE printf('%.4f', ln((n + 2)::DOUBLE / n) / 17) END) || chr(9) || ts || chr(9) || te || chr(9) || qs || chr(9) || qe || chr(9) || '17' || chr(9) || xs || chr(9) || ys AS value FROM c"""
)
def chain_text(spark, sf):
    """Linear chains with the steps between their anchors as lines (SC-13, FN-14)."""
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("aln"), F.lit(0).alias("step"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    c = a.groupBy("aln", "step").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("ts"), F.max("x").alias("te"), F.min("y").alias("qs"), F.max("y").alias("qe"))
    c = c.withColumns({"v": F.col("aln"), "name": F.concat(F.lit("s"), "aln"), "len": F.lit(900), "mini_first": F.lit(0), "mini_last": F.col("n") - 1 + F.when(F.col("aln") % 4 == 0, 0).otherwise(2), "span": F.lit(17)})
    return alignments.chain_lines(c, a).select("value")


@query("SELECT 'c' || event_id % 7 AS ctg, event_id AS st, event_id + 9 AS en, '.' AS score, (event_id % 5 + 1)::INT AS motif_len FROM events")
def motif_table_scan(spark, sf):
    """A table of tandem motifs written and read (SC-19)."""
    lines = table(spark, sf, "events").select(F.concat_ws("\t", F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")), F.col("event_id").cast("string"), (F.col("event_id") + 9).cast("string"), F.lit("."), (F.col("event_id") % 5 + 1).cast("string")).alias("value"))
    return alignments.read_table(spark, written(spark, lines, "motifs"), "motifs")


@query("SELECT CASE WHEN n_nationkey = 3 THEN '#CHROM' || chr(9) || 'START' || chr(9) || 'END' || chr(9) || 'INFO' || chr(9) || 'FORMAT' || chr(9) || 'a' || chr(9) || 'b' WHEN n_nationkey = 2 THEN '##x' ELSE n_name END AS value FROM nation")
def sample_header(spark, sf):
    """Sample names put into the line of column names (KN-31)."""
    lines = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") == 3, "#CHROM\tSTART").when(F.col("n_nationkey") == 2, "##x").otherwise(F.col("n_name")).alias("value"))
    return annotation.with_samples(lines, ["a", "b"])


# --- graphs --------------------------------------------------------------------------------------------------
@query("SELECT p_brand AS sn, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS snid FROM part GROUP BY p_brand")
def stable_name_ids(spark, sf):
    """Stable names numbered by first appearance (GR-2)."""
    return graph.number_sequences(table(spark, sf, "part").select(F.col("p_partkey").alias("seg"), F.col("p_brand").alias("sn")))


@query("SELECT c_name FROM customer WHERE c_name IN (SELECT 'Customer#' || lpad((o_custkey)::VARCHAR, 9, '0') FROM orders)")
def known_names(spark, sf):
    """Queries whose name is a stable sequence's already (JN-16)."""
    names = table(spark, sf, "orders").select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("c_name"))
    return table(spark, sf, "customer").select("c_name").join(names, "c_name", "left_semi")


OVERLAPS = f"(SELECT v, w, CASE WHEN v % 3 = 0 THEN NULL ELSE v % 50 END AS ov, CASE WHEN v % 3 = 0 THEN NULL ELSE w % 50 END AS ow FROM {ARCS})"


def overlapped(spark, sf) -> DataFrame:
    part = lambda c: F.when(F.col("v") % 3 != 0, F.col(c) % 50)
    return as_arcs(walk_arcs(spark, sf)).withColumns({"ov": part("v"), "ow": part("w")})


INFERRED = f"(SELECT a.v, a.w, coalesce(a.ov, d.ow) AS ov, coalesce(a.ow, d.ov) AS ow FROM {OVERLAPS} a LEFT JOIN {OVERLAPS} d ON d.v = xor(a.w, 1) AND d.w = xor(a.v, 1) WHERE coalesce(a.ov, d.ow) IS NOT NULL AND coalesce(a.ow, d.ov) IS NOT NULL)"


@query(f"SELECT * FROM {INFERRED}")
def overlap_inference(spark, sf):
    """Missing overlaps from the other strand (GR-8)."""
    return graph.infer_overlaps(overlapped(spark, sf)).select("v", "w", "ov", "ow")


@query(f"SELECT v, w, least(ov, a.p_size) AS ov, least(ow, b.p_size) AS ow, a.p_size - least(ov, a.p_size) AS lv FROM {INFERRED} JOIN part a ON v >> 1 = a.p_partkey JOIN part b ON w >> 1 = b.p_partkey")
def overlap_clipping(spark, sf):
    """Overlaps cut to segments' lengths (GR-10)."""
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("seg"), F.col("p_size").alias("len"))
    return graph.clip_overlaps(graph.infer_overlaps(overlapped(spark, sf)), size).select("v", "w", "ov", "ow", "lv")


@query(
    f"""WITH k AS (SELECT * FROM {OVERLAPS} WHERE (v >> 1) IN (SELECT p_partkey FROM part WHERE p_size > 10) AND (w >> 1) IN (SELECT p_partkey FROM part WHERE p_size > 10)),
    i AS (SELECT a.v, a.w, coalesce(a.ov, d.ow) AS ov, coalesce(a.ow, d.ov) AS ow FROM k a LEFT JOIN k d ON d.v = xor(a.w, 1) AND d.w = xor(a.v, 1) WHERE coalesce(a.ov, d.ow) IS NOT NULL AND coalesce(a.ow, d.ov) IS NOT NULL),
    s AS (SELECT v, w, ov, ow FROM i UNION SELECT xor(w, 1), xor(v, 1), ow, ov FROM i) SELECT v, w, least(ov, a.p_size) AS ov, least(ow, b.p_size) AS ow FROM s JOIN part a ON v >> 1 = a.p_partkey JOIN part b ON w >> 1 = b.p_partkey"""
)
def graph_finalize(spark, sf):
    """The whole normalization: dangling arcs, overlaps, both strands, lengths (GR-7 to GR-12, GR-16)."""
    live = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("seg"), F.col("p_size").alias("len"))
    return graph.normalize(graph.SequenceGraph(live, overlapped(spark, sf))).arcs.select("v", "w", "ov", "ow")


@query(f"SELECT DISTINCT v >> 1 AS seg FROM {OVERLAPS} WHERE ov <> 0 OR ow <> 0")
def overlap_predicate(spark, sf):
    """Segments with overlaps; the predicate refuses a graph that has any (GR-15)."""
    arcs = overlapped(spark, sf)
    found = arcs.where("ov <> 0 OR ow <> 0").select(F.shiftright("v", 1).alias("seg")).distinct()
    return found if graph.has_overlaps(arcs) else found.limit(0)


@query(
    f"""WITH {NATIONS}, b AS (SELECT a * 2 AS v, b * 2 AS w, a, b, false AS rev FROM l UNION ALL SELECT b * 2 + 1, a * 2 + 1, b, a, true FROM l)
    SELECT v, w, along AS is_ref, row_number() OVER (PARTITION BY v ORDER BY along DESC, w) - 1 AS ord FROM (SELECT v, w, x.sr = 0 AND y.sr = 0 AND x.sn = y.sn AND CASE WHEN rev THEN x.so = y.so + y.len ELSE y.so = x.so + x.len END AS along FROM b JOIN g x ON a = x.seg JOIN g y ON b = y.seg)"""
)
def reference_first(spark, sf):
    """Arcs in order, the one along the reference first (GR-18)."""
    g = nation_graph(spark, sf)
    return graph.successors(g.arcs, g.segments).select("v", "w", "is_ref", "ord")


@query(
    f"""WITH s AS (SELECT walk, ord, v, substr(repeat('ACGTN', 10), (seg % 5 + 1)::INT, (seg % 20 + 2)::INT) AS seq FROM {STEPS}),
    o AS (SELECT walk, ord, substr(CASE WHEN v % 2 = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, 2, length(seq) - 1) AS part FROM s) SELECT walk AS path, string_agg(part, '' ORDER BY ord) AS seq FROM o GROUP BY walk"""
)
def path_sequence(spark, sf):
    """The bases of walks, each step without its first base (GR-19, GR-20)."""
    s = walk_steps(spark, sf)
    segs = s.select("seg").distinct().select("seg", F.expr("substring(repeat('ACGTN', 10), CAST(seg % 5 + 1 AS INT), CAST(seg % 20 + 2 AS INT))").alias("seq")).withColumn("len", F.length("seq").cast("long"))
    steps = s.select(F.col("walk").alias("path"), "ord", "v", F.lit(1).cast("long").alias("st"), (F.col("seg") % 20 + 2).alias("en"))
    return graph.spell(steps, graph.vertices(segs))


@query(f"WITH t AS (SELECT v, lead(v) OVER (PARTITION BY walk ORDER BY ord) AS w FROM {STEPS}), n AS (SELECT v, w, count(*) AS n FROM t WHERE w IS NOT NULL GROUP BY ALL) SELECT v, w, 'dc:f:' || n || '.5' AS tag FROM n WHERE v % 3 <> 0 UNION ALL SELECT v, w, '' FROM n WHERE v % 3 = 0")
def coverage_tags(spark, sf):
    """Counts of arcs as tags, on given strands only (AG-10)."""
    a = walk_arcs(spark, sf)
    empty = F.lit(None).cast(tags.KIND)
    g = graph.SequenceGraph(a.select(F.shiftright("v", 1).alias("seg")).distinct().withColumn("tags", empty), as_arcs(a).withColumns({"tags": empty, "comp": F.col("v") % 3 == 0}))
    done = coverage.write_tags(g, "dc", links=a.select("v", "w", (F.col("n") + 0.5).cast("double").alias("value")))
    return done.arcs.select("v", "w", F.array_join(tags.render(F.col("tags")), "\t").alias("tag"))


# --- expressions ---------------------------------------------------------------------------------------------
@query("SELECT doc_id, list_sum(list_transform(string_split(text, ''), lambda c: coalesce(nullif(instr('ACGT', replace(upper(c), 'U', 'T')), 0) - 1, 4)))::BIGINT AS total FROM documents WHERE length(text) > 0")
def base_codes(spark, sf):
    """Codes of all characters as bases, summed (FN-1, FN-3)."""
    codes = F.transform(F.split("text", ""), nt.code)
    return table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


M32 = 4294967295


def _hash32(x: str, inner: str) -> str:
    """SQL for hash32 of an expression over a table, as column h with all others of the table."""
    inv = lambda v, n: f"({M32} - (({v} << {n}) & {M32}))"
    return f"""(SELECT * EXCLUDE (b0, b1, b2, b3, b4, b5), xor(b5, b5 >> 16) AS h FROM (SELECT *, (b4 + {inv('b4', 11)}) & {M32} AS b5 FROM (SELECT *, xor(b3, b3 >> 6) AS b4 FROM (SELECT *, (b2 + ((b2 << 3) & {M32})) & {M32} AS b3 FROM
        (SELECT *, xor(b1, b1 >> 10) AS b2 FROM (SELECT *, (b0 + {inv('b0', 15)}) & {M32} AS b1 FROM (SELECT *, (({x})::BIGINT & {M32}) AS b0 FROM {inner})))))))"""


_NAMED = "(SELECT c_custkey, c_nationkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: (a * 31 + b) & 4294967295) AS name FROM customer)"
_SIZES = "(SELECT c_custkey, name, h AS size FROM " + _hash32("c_custkey", _NAMED) + ")"
_SALTED = "(SELECT c_custkey, name, size, h AS seed FROM " + _hash32("11", _SIZES) + ")"
_SEEDS = _hash32("xor(name, (size + seed) & 4294967295)", _SALTED)


@query(f"SELECT c_custkey, name AS own, h AS seed FROM {_SEEDS}")
def query_seeds(spark, sf):
    """Hashes of names and of queries (FN-6, FN-8)."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", nt.hash_text(F.col("c_name")).alias("own"), nt.query_seed(F.col("c_name"), F.col("c_custkey"), 11).alias("seed"))


_STARTS = "(SELECT l_orderkey, l_linenumber, l_suppkey, h AS x FROM " + _hash32("l_partkey", "lineitem") + ")"
_ENDS = "(SELECT l_orderkey, l_linenumber, x, h AS y FROM " + _hash32("l_suppkey", _STARTS) + ")"
_SUMS = "(SELECT l_orderkey, sum(x + y + h)::BIGINT + 7 AS s FROM " + _hash32("l_linenumber", _ENDS) + " GROUP BY l_orderkey)"


@query(f"SELECT l_orderkey AS chain, h AS hash FROM {_hash32('s', _SUMS)}")
def chain_hashes(spark, sf):
    """Tie-breaking hashes of chains from their members (AG-6)."""
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chain"), F.lit(7).alias("seed"), F.col("l_partkey").alias("qs"), F.col("l_suppkey").alias("re"), F.col("l_linenumber").alias("v"))
    return summary.chain_hash(m, ["chain"], "seed")


@query(
    """WITH o AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN '=' WHEN 'view' THEN 'X' WHEN 'purchase' THEN 'I' ELSE 'D' END AS op FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, op ORDER BY ts, event_id) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM o),
    q AS (SELECT user_id, op, count(*) AS len, min(rn) AS rn FROM r GROUP BY user_id, op, g) SELECT user_id, string_agg(len || op, '' ORDER BY rn DESC) AS cigar FROM q GROUP BY user_id"""
)
def cigar_reversal(spark, sf):
    """Each user's events as a CIGAR from the other strand (FN-13)."""
    op = F.when(F.col("event_type") == "click", "=").when(F.col("event_type") == "view", "X").when(F.col("event_type") == "purchase", "I").otherwise("D")
    ops = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", op.alias("op")))).alias("_o"))
    return ops.select("user_id", cigar.render(cigar.reverse(cigar.merge_runs(F.transform("_o", lambda x: x["op"])))).alias("cigar"))


@query("SELECT p_partkey, '-' || 'gt' || '*ct:' || p_size || '+' || repeat('t', (p_size % 4 + 1)::INT) || 'g:3' AS ds FROM part")
def difference_reversal(spark, sf):
    """Difference strings from the other strand (FN-13)."""
    text = F.concat(F.lit(":3+c"), F.repeat(F.lit("a"), (F.col("p_size") % 4 + 1).cast("int")), F.lit(":"), "p_size", F.lit("*ga-ac"))
    return table(spark, sf, "part").select("p_partkey", cigar.reverse_differences(text).alias("ds"))


@query("SELECT p_partkey, p_size % 2 = 1 AS rev, 'p' || p_partkey AS name, p_partkey AS st, p_partkey + p_size AS en, p_size::VARCHAR AS ns FROM part")
def walk_projections(spark, sf):
    """Intervals of walks and values of info texts by patterns (FN-18)."""
    p = table(spark, sf, "part")
    walk = F.concat(F.when(F.col("p_size") % 2 == 1, "<").otherwise(">"), F.lit("p"), "p_partkey", F.lit(":"), "p_partkey", F.lit("-"), F.col("p_partkey") + F.col("p_size"), F.lit(">x:0-4"))
    rows = p.select("p_partkey", F.get(repeats.walk_intervals(walk), F.lit(0)).alias("w"), repeats.info(F.concat(F.lit("NA=3;NS="), "p_size", F.lit(";FLAG")))["NS"].alias("ns"))
    return rows.select("p_partkey", "w.rev", "w.name", "w.st", "w.en", "ns")


LABELS = ["mini", "micro", "lcr", "LINE/L1", "LINE/L1HS", "LINE/L2", "SINE/Alu", "Retroposon/SVA", "LTR/ERV", "LTR/x", "inter", "DNA/hAT", "Satellite/y", "alpha", "hsat2/3", "_sat", "self", "none", "mixed", "segdup", "partial", "gap", "other"]
_LABEL = "(" + str(LABELS) + ")[(p_partkey % 23 + 1)::INT]"
_CLASS = """CASE WHEN type = 'mini' THEN '11_VNTR' WHEN type = 'micro' THEN '12_STR' WHEN type = 'lcr' THEN '13_Other-LCR' WHEN type IN ('LINE/L1', 'LINE/L1HS') THEN '02_L1' WHEN type IN ('SINE/Alu', 'SINE/AluY') THEN '01_Alu' WHEN type = 'Retroposon/SVA' THEN '03_SVA' WHEN type = 'LTR/ERV' THEN '04_ERV'
    WHEN type = 'inter' OR regexp_matches(type, '^(DNA|LINE|SINE|LTR)') THEN '05_Other-TE' WHEN regexp_matches(type, '^Satellite') OR type IN ('alpha', 'hsat2/3', '_sat') THEN '10_Satellite' WHEN type IN ('self', 'none', 'partial') THEN '30_Low-repeat' WHEN type = 'segdup' THEN '21_SegDup' ELSE '20_Other-repeat' END"""


def labelled_parts(spark, sf) -> DataFrame:
    label = F.get(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % 23).cast("int"))
    return table(spark, sf, "part").withColumn("type", label)


@query(
    f"""WITH e AS (SELECT *, {_LABEL} AS type FROM part), c AS (SELECT {_CLASS} AS class, least(p_size % 5 + 1, 4) AS na, p_size AS len, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size * 3 - p_size // 2 END AS clear FROM e WHERE type <> 'gap' AND p_brand <> 'Brand#13')
    SELECT class, regexp_replace(class, '^[0-9]+_', '') AS label, count(*) FILTER (na = 2) AS n2, count(*) FILTER (na = 3) AS n3, count(*) FILTER (na = 4) AS n4, coalesce(sum(len) FILTER (na = 2), 0)::BIGINT AS len2, coalesce(sum(len) FILTER (na = 3), 0)::BIGINT AS len3, coalesce(sum(len) FILTER (na = 4), 0)::BIGINT AS len4,
    coalesce(sum(clear) FILTER (na = 2), 0)::BIGINT AS clear2, coalesce(sum(clear) FILTER (na = 3), 0)::BIGINT AS clear3, coalesce(sum(clear) FILTER (na = 4), 0)::BIGINT AS clear4 FROM c GROUP BY class"""
)
def repeat_class_table(spark, sf):
    """Classes of repeats by number of alleles: counts, lengths, lengths without dust (FN-19, AG-17)."""
    p = labelled_parts(spark, sf)
    total = F.when(F.col("p_size") % 3 == 0, -1).otherwise(F.col("p_size") * 3)
    e = p.select(F.when(F.col("p_brand") == "Brand#13", "chrUn_1").otherwise("chr1").alias("ctg"), (F.col("p_size") % 5 + 1).alias("n_paths"), F.col("p_size").alias("len_max"), total.alias("total"), F.expr("p_size div 2").alias("dust"), "type")
    return annotation.class_table(e)


@query(
    f"""WITH e AS (SELECT *, {_LABEL} AS type FROM part), c AS (SELECT {_CLASS} AS class, p_size AS len, p_size % 4 + 1 AS n FROM e WHERE p_partkey % 2 > 0 AND p_size % 7 > 0 AND p_size % 11 >= (p_size % 7) * 0.5)
    SELECT class, coalesce(sum(len) FILTER (n = 2), 0)::BIGINT AS two, coalesce(sum(len) FILTER (n = 3), 0)::BIGINT AS three, coalesce(sum(len) FILTER (n > 3), 0)::BIGINT AS more FROM c GROUP BY class"""
)
def frequency_table(spark, sf):
    """Lengths of frequent segments by class and number of alleles (AG-14)."""
    p = labelled_parts(spark, sf)
    return annotation.frequency_lengths(p.select(F.col("p_size").alias("len"), (F.col("p_partkey") % 2).alias("rank"), (F.col("p_size") % 7).alias("ns"), (F.col("p_size") % 11).alias("ac"), (F.col("p_size") % 4 + 1).alias("n_alleles"), "type"), 0.5)


_FORMS = "(SELECT unnest(['GGAAT', 'GAATG', 'AATGG', 'ATGGA', 'TGGAA', 'ATTCC', 'TTCCA', 'TCCAT', 'CCATT', 'CATTC']) AS f)"


@query(
    f"""WITH d AS (SELECT DISTINCT substr(seq, (i + 1)::INT, 5) AS seq FROM (SELECT {_DNA} AS seq FROM benchmark), range(length(seq) - 4) t(i)), h AS (SELECT seq, min(hamming(seq, f)) AS near, bool_or(hamming(seq, f) = 1) AS one FROM d, {_FORMS} GROUP BY seq)
    SELECT seq, CASE WHEN near = 0 THEN 'motif' WHEN one THEN 'mutant' END AS kind FROM h"""
)
def motif_kinds(spark, sf):
    """The benchmark's 5-mers by their likeness to a motif (FN-20)."""
    seq = table(spark, sf, "benchmark").select(nt.as_dna(F.col("text")).alias("seq"))
    mers = seq.where("length(seq) >= 5").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - 4), lambda i: F.substr("seq", i, F.lit(5)))).alias("seq")).distinct()
    return mers.select("seq", repeats.motif_kind(F.col("seq"), "GGAAT").alias("kind"))


@query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 9, '0') AS short, 'chr' || c_nationkey AS contig, 'Alu' AS class FROM customer")
def clean_names(spark, sf):
    """Names without samples, haplotypes and class numbers (FN-21)."""
    contig = F.concat(F.lit("NA1#1#chr"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", fasta.clean_name(F.col("c_name")).alias("short"), fasta.contig_name(contig).alias("contig"), repeats.class_label(F.lit("01_Alu")).alias("class"))


@query("SELECT conv_id, turn, reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) AS seq, reverse(repeat('I', (length(text) - 1)::INT) || '#') AS qual FROM (SELECT conv_id, turn, translate(text, 'BDGHKMRSVWYbdghkmrsvwyNnUu', '') AS text FROM conversations) WHERE length(text) > 0")
def reverse_reads(spark, sf):
    """Reads on the other strand, qualities along (FN-4)."""
    text = F.translate("text", "BDGHKMRSVWYbdghkmrsvwyNnUu", "")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("seq")).where("length(seq) > 0")
    return fasta.reverse_records(rows.withColumn("qual", F.concat(F.repeat(F.lit("I"), F.length("seq") - 1), F.lit("#"))))


# --- chains --------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n > 20 OR n // 8 > l_quantity AS isolated FROM (SELECT *, least(l_partkey, 2000 - l_partkey) AS n FROM lineitem)")
def isolated_chains(spark, sf):
    """Chains too far from their segment's ends (FL-5)."""
    i = table(spark, sf, "lineitem")
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", summary.isolated(F.col("l_partkey"), F.col("l_partkey"), F.lit(2000).cast("long"), F.col("l_quantity"), 20).alias("isolated"))


@query(
    """WITH a AS (SELECT user_id, event_id, value > 60 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS z FROM events),
    e AS (SELECT *, coalesce(min(z) FILTER (NOT f) OVER (PARTITION BY user_id), 999999999) AS fz FROM a), r AS (SELECT * FROM e WHERE NOT (z <= 3 AND z < fz)), s AS (SELECT *, coalesce(min(k) FILTER (NOT f) OVER (PARTITION BY user_id), 999999999) AS fk FROM r)
    SELECT user_id, event_id FROM s WHERE NOT (k <= 3 AND k < fk)"""
)
def chain_end_trim(spark, sf):
    """Chains without frequent anchors at their ends (FL-6)."""
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return summary.trim_ends(e, ["user_id"], "event_id", "value", 60, 3).select("user_id", "event_id")


CHAINED = """a AS (SELECT l_orderkey AS chain, l_linenumber AS step, l_partkey AS v, (l_partkey % 50)::BIGINT AS x, (l_suppkey % 90 + l_linenumber * 60)::BIGINT AS y, 9 AS span, (l_suppkey % 30 + l_linenumber * 20)::BIGINT AS mini FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
    f AS (SELECT *, sum(60) OVER (PARTITION BY chain ORDER BY step) - 60 + x AS p FROM a)"""


def chained(spark, sf) -> tuple[DataFrame, DataFrame]:
    one = ordering.top_k(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")], 1)
    a = one.select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("v"), (F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 90 + F.col("l_linenumber") * 60).alias("y"), F.lit(9).alias("span"), (F.col("l_suppkey") % 30 + F.col("l_linenumber") * 20).alias("mini"))
    return a.drop("v"), a.select("chain", "step", "v", F.lit(60).cast("long").alias("len"))


@query(
    f"""WITH {CHAINED}, g AS (SELECT *, p - lag(p) OVER w AS dp, y - lag(y) OVER w AS dq, CASE WHEN y < lag(y) OVER w THEN lag(mini) OVER w - mini ELSE 0 END AS again FROM f WINDOW w AS (PARTITION BY chain ORDER BY step, x, y)),
    s AS (SELECT chain, arg_min(y, step) + 1 - 9 AS qs, arg_max(y, step) + 1 AS qe, arg_min(p, step) + 1 - 9 AS ps, arg_max(p, step) + 1 AS pe, sum(greatest(coalesce(dp, 9), coalesce(abs(dq), 9)))::BIGINT AS blen, sum(least(coalesce(dp, 9), coalesce(abs(dq), 9), 9))::BIGINT AS mlen, count(*) AS n_anchor,
    (arg_max(mini, step) - arg_min(mini, step) + 1 + sum(coalesce(again, 0)))::BIGINT AS n_mini, (count(*) * 60)::BIGINT AS plen FROM g GROUP BY chain) SELECT chain, qs, qe, ps, pe, blen, mlen, n_anchor, n_mini, plen, round(abs(ln(n_mini / n_anchor)) / 9, 6) AS div FROM s WHERE n_mini > 0"""
)
def chain_summary(spark, sf):
    """Extents, lengths and divergence of chains over a graph (AG-5, FN-14)."""
    a, steps = chained(spark, sf)
    return summary.summarize(a, steps, ["chain"]).where("n_mini > 0").withColumn("div", F.round("div", 6))


@query(
    f"""WITH {CHAINED}, c AS (SELECT chain, count(*) AS n FROM f GROUP BY chain HAVING count(*) >= 2), m AS (SELECT f.*, min(step) OVER w AS lo, max(step) OVER w AS hi FROM f JOIN c USING (chain) WINDOW w AS (PARTITION BY chain)),
    e AS (SELECT v, CASE WHEN step = lo THEN x ELSE 0 END AS s, CASE WHEN step = hi THEN x + 9 ELSE 60 END AS e FROM m) SELECT v >> 1 AS seg, CASE WHEN v % 2 = 1 THEN 60 - e ELSE s END AS st, CASE WHEN v % 2 = 1 THEN 60 - s ELSE e END AS en, v % 2 = 1 AS rev FROM e"""
)
def segment_intervals(spark, sf):
    """What good chains take of each segment (JN-8)."""
    return _index(spark, sf)[0]


@query(f"WITH {CHAINED}, c AS (SELECT chain, count(*) AS n FROM f GROUP BY chain HAVING count(*) >= 2) SELECT round(sum(3) / sum(9), 6) AS density, (SELECT max(n) FROM c) AS most FROM f JOIN c USING (chain)")
def anchor_density(spark, sf):
    """Anchors to aligned bases, and the most anchors of a chain (AG-11)."""
    return _index(spark, sf)[2].withColumn("density", F.round("density", 6))


def _index(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, steps = chained(spark, sf)
    chains = a.groupBy("chain").agg(F.count(F.lit(1)).alias("n_anchor")).select("chain", F.col("chain").alias("qid"), F.lit(0).alias("qs"), F.lit(9).alias("qe"), F.lit(100).alias("blen"), F.when(F.col("n_anchor") >= 2, 9).otherwise(0).alias("mapq"), "n_anchor", F.lit(True).alias("primary"))
    members = a.join(steps, ["chain", "step"]).select("chain", "step", "v", "len", F.col("x").alias("st"), (F.col("x") + 9).alias("en"), F.lit(3).alias("minis"))
    return summary.interval_index(chains, members, ["chain"], 50, 5)


@query("WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS mini FROM events) SELECT m.user_id AS qid, event_id AS qpos, mini FROM m JOIN events USING (event_id) WHERE event_type = 'click'")
def anchor_ordinals(spark, sf):
    """Anchors with the ordinals of their minimizers (KN-7)."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("rid"), F.col("event_id").alias("pos"), "event_type")
    return summary.number_anchors(e.where("event_type = 'click'").select(F.col("rid").alias("qid"), F.col("pos").alias("qpos")), e.select("rid", "pos"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS total, string_agg(length(text), ',' ORDER BY turn) AS lengths FROM conversations GROUP BY conv_id")
def fragment_totals(spark, sf):
    """Lengths of the turns of each conversation (AG-23)."""
    return summary.fragment_totals(table(spark, sf, "conversations"), ["conv_id"], "turn", F.length("text"))


@query("SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))::BIGINT AS offset FROM conversations")
def joined_offsets(spark, sf):
    """Offsets of turns in their conversation, as for sketches of several segments (KN-2)."""
    return summary.joined_coordinates(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", F.length("text")).select("conv_id", "turn", "offset")


@query(
    f"""WITH g AS (SELECT item_id AS rid, i AS pos, substr(seq, (i + 1)::INT, 3) AS hash FROM (SELECT item_id, {_DNA} AS seq FROM benchmark), range(length(seq) - 2) t(i)), o AS (SELECT hash, count(*) AS occ FROM g GROUP BY hash), f AS (SELECT hash FROM o WHERE occ >= (SELECT quantile_disc(occ, 0.5) FROM o)),
    m AS (SELECT rid, pos - 2 AS st, pos + 1 AS en FROM (SELECT rid, pos + 2 AS pos, hash FROM g) JOIN f USING (hash)),
    i AS (SELECT rid, min(st) AS st, max(en) AS en FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY st) AS run FROM (SELECT *, CASE WHEN lag(en) OVER (PARTITION BY rid ORDER BY st) >= st THEN 0 ELSE 1 END AS new FROM m)) GROUP BY rid, run)
    SELECT rid AS qid, sum(en - st)::BIGINT AS rep_len FROM i GROUP BY rid"""
)
def repeat_lengths(spark, sf):
    """The length that frequent seeds cover of each item (AG-4)."""
    seq = table(spark, sf, "benchmark").select(F.col("item_id").alias("rid"), nt.as_dna(F.col("text")).alias("seq")).where("length(seq) >= 3")
    g = seq.select("rid", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("seq") - 2), lambda i: F.substr("seq", i, F.lit(3)))).alias("_p", "hash")).select("rid", "hash", (F.col("_p") + 2).alias("pos"))
    half = seeding.occurrences(g).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY occ)").alias("m")).first()[0]
    return seeding.repeat_length(g, g, 3, int(half))


# --- annotation ----------------------------------------------------------------------------------------------
@query(
    f"""WITH h AS (SELECT user_id AS ev, CASE event_type WHEN 'click' THEN 'mini' WHEN 'view' THEN 'LINE/L1' WHEN 'purchase' THEN 'LCR' ELSE CASE WHEN user_id % 2 = 0 THEN '_alu' ELSE 'self' END END AS label, {SECONDS} AS st, {SECONDS} + 3600 AS en FROM events),
    i AS (SELECT ev, label, min(st) AS st, max(en) AS en FROM (SELECT *, sum(new) OVER (PARTITION BY ev, label ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN max(en) OVER (PARTITION BY ev, label ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= st THEN 0 ELSE 1 END AS new FROM h)) GROUP BY ev, label, run),
    x AS (SELECT ev, label, sum(en - st)::BIGINT AS c FROM i GROUP BY ev, label HAVING sum(en - st) >= 3600), e AS (SELECT c_custkey AS ev, (c_custkey % 9 + 1) * 4000 AS len FROM customer),
    r AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY c DESC, label) AS r FROM x WHERE label IN ('mini', 'LINE/L1')),
    s AS (SELECT e.ev, e.len, max(r.label) FILTER (r = 1) AS l1, coalesce(max(r.c) FILTER (r = 1), 0) AS m1, coalesce(max(r.c) FILTER (r = 2), 0) AS m2, coalesce(sum(r.c), 0) AS total, coalesce(sum(r.c) FILTER (r.label = 'LINE/L1'), 0) AS misc, coalesce(sum(r.c) FILTER (r.label = 'mini'), 0) AS mini FROM e LEFT JOIN r ON e.ev = r.ev GROUP BY e.ev, e.len),
    z AS (SELECT s.*, coalesce((SELECT c FROM x WHERE x.ev = s.ev AND label = 'LCR'), 0) AS lcr, coalesce((SELECT c FROM x WHERE x.ev = s.ev AND label = '_alu'), 0) AS alu, coalesce((SELECT c FROM x WHERE x.ev = s.ev AND label = 'self'), 0) AS own FROM s)
    SELECT ev, len, CASE WHEN l1 IS NOT NULL AND m1 >= len * 0.7 THEN l1 WHEN lcr >= len * 0.7 THEN CASE WHEN l1 = 'mini' AND m1 >= mini * 0.7 THEN l1 ELSE 'lcr' END WHEN l1 = 'mini' AND m2 < m1 * 0.1 THEN l1 WHEN alu > 0 AND alu >= len * 0.7 THEN 'SINE/Alu' WHEN misc + lcr >= len * 0.7 THEN 'mixed'
    WHEN total + lcr > len * 0.05 THEN 'partial' WHEN own > 0 AND own >= len * 0.5 THEN 'self' ELSE 'none' END AS type FROM z"""
)
def annotation_types(spark, sf):
    """Events by the labels that cover them (AG-15, AG-16)."""
    e = event_windows(spark, sf, 3600)
    label = F.when(F.col("event_type") == "click", "mini").when(F.col("event_type") == "view", "LINE/L1").when(F.col("event_type") == "purchase", "LCR").otherwise(F.when(F.col("user_id") % 2 == 0, "_alu").otherwise("self"))
    hits = e.select(F.col("user_id").alias("ev"), label.alias("label"), "st", "en")
    events = table(spark, sf, "customer").select(F.col("c_custkey").alias("ev"), ((F.col("c_custkey") % 9 + 1) * 4000).alias("len"))
    return annotation.decide_labels(annotation.label_lengths(hits, ["ev"], 3600, 86_400), events, ["ev"])


_EVENTS = f"(SELECT user_id, event_id, {SECONDS} AS st, {SECONDS} + 600 AS en, event_type AS t, floor(value)::INT AS diff, CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END AS sign FROM events)"
_DAYS = f"(SELECT DISTINCT user_id, {SECONDS} // 86400 * 86400 AS st, {SECONDS} // 86400 * 86400 + 86400 AS en FROM events WHERE event_id % 3 = 0)"


def _side(a: str, b: str, name: str) -> str:
    return f"""SELECT '{name}' || k AS kind, sum(wrong)::BIGINT AS wrong, count(*) AS total, round(sum(wrong) / count(*), 4) AS rate FROM (SELECT unnest(['A', CASE WHEN sign < 0 THEN 'D' ELSE 'I' END]) AS k, CASE WHEN EXISTS (SELECT 1 FROM {_EVENTS} y WHERE y.t = '{b}' AND y.user_id = x.user_id AND y.st < x.en + 900 AND x.st - 900 < y.en) THEN 0 ELSE 1 END AS wrong
        FROM {_EVENTS} x WHERE t = '{a}' AND diff >= 20 AND EXISTS (SELECT 1 FROM {_DAYS} d WHERE d.user_id = x.user_id AND d.st <= x.st - 900 AND x.en + 900 <= d.en)) GROUP BY k"""


@query(f"{_side('click', 'view', 'N')} UNION ALL {_side('view', 'click', 'P')}")
def evaluation_counts(spark, sf):
    """Missed and false events by sign in confident regions (JN-13, AG-20)."""
    e = event_windows(spark, sf, 600).select("user_id", "st", "en", "event_type", F.floor("value").cast("int").alias("diff"), F.when(F.col("event_id") % 2 == 0, -1).otherwise(1).alias("sign"), F.col("event_id").alias("id"))
    days = event_times(spark, sf).where("event_id % 3 = 0").select("user_id", F.expr("st div 86400 * 86400").alias("st")).distinct().withColumn("en", F.col("st") + 86_400)
    return annotation.confusion(e.where("event_type = 'click'"), e.where("event_type = 'view'"), days, ["user_id"], 20, 900, 86_400)


@query(
    """WITH m AS (SELECT p_partkey AS st, p_partkey + p_size AS en, CASE p_size % 4 WHEN 0 THEN 'lcr' WHEN 1 THEN 'segdup' WHEN 2 THEN 'mini' ELSE 'x' END AS anno, p_size AS lb, p_partkey % 60 AS ld, p_size % 9 AS ac1, p_partkey % 9 AS ac2, p_partkey % 200 AS l0, p_partkey % 70 AS l1, p_size AS l2, p_partkey % 3 AS ref FROM part WHERE p_partkey % 5 > 0),
    k AS (SELECT *, list_filter([CASE WHEN ref = 0 THEN l0 END, CASE WHEN ac1 >= 5 OR ref = 1 THEN l1 END, CASE WHEN ac2 >= 5 OR ref = 2 THEN l2 END], lambda x: x IS NOT NULL) AS c FROM m WHERE anno IN ('lcr', 'mini') OR (anno = 'segdup' AND lb > 0 AND ld >= lb * 0.7))
    SELECT 'chr1' AS ctg, greatest(st - 5, 0) AS st, en + 5 AS en, greatest(list_max(c), en - st) AS longest FROM k WHERE len(c) >= 2"""
)
def low_complexity_regions(spark, sf):
    """Merged calls of low complexity (FL-15)."""
    s = lambda e: F.expr(e).cast("string")
    anno = F.when(F.col("p_size") % 4 == 0, "lcr").when(F.col("p_size") % 4 == 1, "segdup").when(F.col("p_size") % 4 == 2, "mini").otherwise("x")
    text = F.concat(F.lit("ANNO="), anno, F.lit(";LBUBBLE="), s("p_size"), F.lit(";LDUST="), s("p_partkey % 60"), F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit(";ALEN="), F.concat_ws(",", s("p_partkey % 200"), s("p_partkey % 70"), s("p_size")))).otherwise(""), F.lit(";AC=0,"), s("p_size % 9"), F.lit(","), s("p_partkey % 9"))
    m = table(spark, sf, "part").select(F.lit("HG1#2#chr1").alias("ctg"), F.col("p_partkey").alias("st"), (F.col("p_partkey") + F.col("p_size")).alias("en"), text.alias("info"), F.array(F.concat(s("p_partkey % 3"), F.lit(":+"))).alias("gts"))
    return annotation.low_complexity(m)


@query(
    f"""WITH p AS (SELECT l_orderkey AS aln, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord, l_partkey AS seg, l_linestatus = 'O' AS rev FROM lineitem),
    s AS (SELECT aln, ord, rev, 'r' || seg % 3 AS sn, seg // 3 * 10 AS so, 10 AS len FROM p), m AS (SELECT *, CASE WHEN sn = lag(sn) OVER w AND rev = lag(rev) OVER w AND CASE WHEN rev THEN so + len = lag(so) OVER w ELSE so = lag(so + len) OVER w END THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY aln ORDER BY ord)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY aln ORDER BY ord) AS run FROM m), u AS (SELECT aln, run, any_value(sn) AS sn, any_value(rev) AS rev, min(so) AS st, max(so + len) AS en FROM r GROUP BY aln, run),
    a AS (SELECT aln, count(*) AS n, arg_min(sn, run) AS sn, arg_min(rev, run) AS rev, arg_min(st, run) AS st, sum(en - st)::BIGINT AS plen, string_agg((CASE WHEN rev THEN '<' ELSE '>' END) || sn || ':' || st || '-' || en, '' ORDER BY run) AS path FROM u GROUP BY aln),
    t AS (SELECT 'r' || p_partkey % 3 AS sn, max(p_partkey // 3 * 10 + 10) AS total FROM part GROUP BY 1)
    SELECT aln, CASE WHEN n = 1 AND rev THEN '-' ELSE '+' END AS strand, CASE WHEN n = 1 THEN a.sn ELSE path END AS path, CASE WHEN n = 1 THEN total ELSE plen END AS plen, CASE WHEN n > 1 THEN 2 WHEN rev THEN st + plen - 1 - (plen - 1) ELSE st + 2 END AS ps, CASE WHEN n > 1 THEN plen - 1 WHEN rev THEN st + plen - 1 - 2 ELSE st + plen - 1 END AS pe FROM a JOIN t ON a.sn = t.sn WHERE aln % 10 <> 0"""
)
def stable_alignments(spark, sf):
    """Alignments in stable coordinates; those of a wrong length fail (KN-28, FN-15)."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    step = F.concat(F.when(F.col("l_linestatus") == "O", "<").otherwise(">"), F.lit("p"), "l_partkey")
    listed = F.sort_array(F.collect_list(F.struct(*order, step.alias("t"))))
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("aln")).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "").alias("path"), (F.count(F.lit(1)) * 10).alias("_n"))
    # every tenth states a wrong length; overlapping steps of one segment count once in a run and fail too
    a = a.select("aln", F.lit("+").alias("strand"), "path", (F.col("_n") + F.when(F.col("aln") % 10 == 0, 1).otherwise(0)).alias("plen"), F.lit(2).cast("long").alias("ps"), (F.col("_n") - 1).alias("pe"))
    segs = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.lit(10).cast("long").alias("len"), F.concat(F.lit("r"), F.col("p_partkey") % 3).alias("sn"), F.expr("p_partkey div 3 * 10").alias("so"), F.lit(0).alias("sr"))
    return stable.to_stable(a, segs, "aln")[0]


@query("SELECT qname FROM (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS qname, l_returnflag AS f, l_partkey AS a FROM lineitem) WHERE (f = 'N' AND a + 5 < 900 AND 300 < a + 30) OR (f = 'R' AND ((a + 30 > 300 AND a + 5 < 900) OR (a + 40 - 12 > 300 AND a < 900))) OR (f = 'A' AND 100 > 300)")
def region_subset(spark, sf):
    """Alignments that touch a region, on contigs and on stable paths (KN-29)."""
    i = table(spark, sf, "lineitem")
    a = F.col("l_partkey")
    part = lambda name, st, en: F.concat(F.lit(f">{name}:"), st.cast("string"), F.lit("-"), en.cast("string"))
    path = F.when(F.col("l_returnflag") == "R", F.concat(part("c1", a, a + 30), part("c1", a, a + 40))).when(F.col("l_returnflag") == "A", part("c2", a, a + 30)).otherwise(F.lit("c1"))
    plen = F.when(F.col("l_returnflag") == "R", 70).when(F.col("l_returnflag") == "A", 30).otherwise(5000)
    rows = i.select(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("qname"), path.alias("path"), plen.cast("long").alias("plen"), F.when(F.col("l_returnflag") == "N", a + 5).otherwise(5).alias("ps"), F.when(F.col("l_returnflag") == "N", a + 30).when(F.col("l_returnflag") == "A", 28).otherwise(58).alias("pe"))
    return stable.in_region(rows, "c1", 300, 900).select("qname")


# --- generation ----------------------------------------------------------------------------------------------
INSERTIONS = "(SELECT l_orderkey, l_linenumber, l_partkey * 2 + l_suppkey % 2 AS v0, (l_quantity % 11)::BIGINT AS off0, l_suppkey * 2 + l_partkey % 2 AS v1, (l_linenumber * 3 % 11)::BIGINT AS off1, 5 AS c0, 5 + l_linenumber % 2 AS c1 FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)"


def proposed(spark, sf) -> DataFrame:
    one = ordering.top_k(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")], 1)
    return one.select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2 + F.col("l_suppkey") % 2).alias("v0"), (F.col("l_quantity") % 11).cast("long").alias("off0"), (F.col("l_suppkey") * 2 + F.col("l_partkey") % 2).alias("v1"), (F.col("l_linenumber") * 3 % 11).cast("long").alias("off1"), F.lit(5).alias("c0"), (F.col("l_linenumber") % 2 + 5).alias("c1"))


def tens(spark, sf) -> DataFrame:
    """Segments of ten bases for all parts and suppliers."""
    i = table(spark, sf, "lineitem")
    return i.select(F.col("l_partkey").alias("seg")).union(i.select("l_suppkey")).distinct().withColumn("len", F.lit(10).cast("long"))


@query(
    f"""WITH i AS (SELECT *, CASE WHEN v0 % 2 = 1 THEN 10 - off0 ELSE off0 END AS p0, CASE WHEN v1 % 2 = 1 THEN 10 - off1 ELSE off1 END AS p1 FROM {INSERTIONS}),
    k AS (SELECT * FROM i WHERE NOT (p0 = 0 AND v0 % 2 = 0) AND NOT (p0 = 10 AND v0 % 2 = 1) AND NOT (p1 = 0 AND v1 % 2 = 1) AND NOT (p1 = 10 AND v1 % 2 = 0)),
    a AS (SELECT v, w, count(*) AS n FROM (SELECT v, lead(v) OVER (PARTITION BY walk ORDER BY ord) AS w FROM {STEPS}) WHERE w IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
    SELECT l_orderkey, l_linenumber FROM k WHERE NOT (v0 <> v1 AND c0 = c1 AND off0 IN (0, 10) AND off1 IN (0, 10) AND EXISTS (SELECT 1 FROM a WHERE a.v = CASE WHEN off0 = 0 THEN xor(v0, 1) ELSE v0 END AND a.w = CASE WHEN off1 = 0 THEN v1 ELSE xor(v1, 1) END))"""
)
def possible_insertions(spark, sf):
    """Insertions that can be and are no arc of the graph (FL-11)."""
    taken = coverage.traversals(walk_steps(spark, sf), ["walk"]).withColumn("link", F.col("walk"))
    return generation.possible(proposed(spark, sf), tens(spark, sf), taken).select("l_orderkey", "l_linenumber")


@query(
    f"""SELECT l_orderkey, l_linenumber, 0 AS part, v0, off0, v1, off1, c0, c1 FROM {INSERTIONS} WHERE l_linenumber % 3 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, 0, v0, off0, xor(v1, 1), 10 - off1, c0, c0 FROM {INSERTIONS} WHERE l_linenumber % 3 = 0
    UNION ALL SELECT l_orderkey, l_linenumber, 1, xor(v0, 1), 10 - off0, v1, off1, c1, c1 FROM {INSERTIONS} WHERE l_linenumber % 3 = 0"""
)
def inversion_events(spark, sf):
    """Inversions as two events each (KN-22)."""
    return generation.split_inversions(proposed(spark, sf).withColumn("inverted", F.col("l_linenumber") % 3 == 0), tens(spark, sf))
