"""Driver queries of the engine's own operators, with the same statements in SQL.

Each query applies one operator, or a few, to whole tables; the SQL says the same in one statement for an
independent engine. Queries whose operator SQL can't state have none and are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import cigar, nt, tags
from .operators import alleles, augment, bubbles, chaining, coverage, graph, intervals, ordering, ranking, seeding
from .plans import mapping
from .sources import alignments, fasta, stable
from .streaming import sessions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their time in whole seconds as st."""
    return table(spark, sf_dir, "events").withColumn("st", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))


def event_windows(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    """events as intervals [second, second + seconds) of their users."""
    return event_times(spark, sf_dir).withColumn("en", F.col("st") + seconds)


SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
GRAMS = "SELECT {key}, i AS pos, array_to_string(w[i + 1:i + {n}], ' ') AS gram FROM (SELECT {key}, string_split(translate({text}, chr(10), ' '), ' ') AS w FROM {table}), range(len(w) - {n} + 1) r(i) WHERE len(w) >= {n}"


# --- seeds ---------------------------------------------------------------------------------------------------
@query(
    f"""WITH q AS ({GRAMS.format(key="doc_id", text="text", table="documents", n=5)}), t AS ({GRAMS.format(key="item_id", text="text", table="benchmark", n=5)}),
    rare AS (SELECT gram FROM t GROUP BY gram HAVING count(*) < 50),
    pairs AS (SELECT doc_id, item_id, q.pos AS qpos, t.pos AS tpos FROM q JOIN t USING (gram) JOIN rare USING (gram)),
    runs AS (SELECT *, qpos - row_number() OVER (PARTITION BY doc_id, item_id, qpos - tpos ORDER BY qpos) AS run FROM pairs),
    chains AS (SELECT doc_id, item_id, min(qpos) AS qs, max(qpos) AS qe, min(tpos) AS ts, max(tpos) AS te, count(*) AS n_anchor FROM runs GROUP BY doc_id, item_id, qpos - tpos, run HAVING count(*) >= 3)
    SELECT * FROM chains QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_anchor DESC, item_id, qs, ts) = 1"""
)
def contained_passages(spark, sf):
    """Each document's longest passage of a benchmark item (JN-1, JN-2, FL-1, WN-4, WN-5)."""
    return mapping.contained_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(f"SELECT gram, count(*) AS occ, count(DISTINCT conv_id * 1000000 + turn) AS n_texts FROM ({GRAMS.format(key='conv_id, turn', text='text', table='conversations', n=4)}) GROUP BY gram HAVING count(*) >= 2")
def kgram_index_occ(spark, sf):
    """Posting lists of two or more of word 4-grams (AG-1)."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("key"), "text")
    grams = mapping.word_grams(turns, "key", "text", 4)
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("occ"), F.count_distinct("key").alias("n_texts")).where("occ >= 2")


@query(
    """WITH o AS (SELECT unnest(string_split(translate(text, chr(10), ' '), ' ')) AS w FROM documents), c AS (SELECT count(*) AS occ FROM o GROUP BY w),
    r AS (SELECT occ, row_number() OVER (ORDER BY occ) AS rn, count(*) OVER () AS n FROM c), f AS (SELECT unnest([0.1, 0.01, 0.0002]::DOUBLE[]) AS fraction)
    SELECT fraction, occ AS cap, n FROM r JOIN f ON rn = CAST(floor((1.0 - fraction) * n) AS BIGINT) + 1"""
)
def occ_quantile_caps(spark, sf):
    """Exact caps of the occurrence counts of the documents' words (AG-3)."""
    words = table(spark, sf, "documents").select(F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("w"))
    return seeding.occurrence_caps(words, [0.1, 0.01, 0.0002], "w")


def _hash_sql(x: str, bits: int) -> str:
    m = (1 << bits) - 1
    up = lambda v, n: f"((({v}) & {m >> n}) << {n})"
    return f"""SELECT *, (a7 + {up("a7", 31) if bits > 31 else 0}) & {m} AS hash FROM (SELECT *, xor(a6, a6 >> 28) AS a7 FROM (SELECT *, (((a5 + {up("a5", 2)}) & {m}) + {up("a5", 4)}) & {m} AS a6 FROM
    (SELECT *, xor(a4, a4 >> 14) AS a5 FROM (SELECT *, (((a3 + {up("a3", 3)}) & {m}) + {up("a3", 8)}) & {m} AS a4 FROM (SELECT *, xor(a2, a2 >> 24) AS a3 FROM
    (SELECT *, ({m} - a0 + {up("a0", 21)}) & {m} AS a2 FROM (SELECT *, ({x}) & {m} AS a0 FROM {{0}})))))))"""


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, hash FROM ({_hash_sql('l_orderkey * 1000003 + l_partkey * 7 + l_linenumber', 34).format('lineitem')})")
def minimizer_hash64(spark, sf):
    """The invertible hash of integer keys (FN-5)."""
    key = F.col("l_orderkey") * 1_000_003 + F.col("l_partkey") * 7 + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", nt.hash_bits(key, 34).alias("hash"))


_DNA = "array_to_string(list_transform(string_split(text, ''), lambda c: substr('ACGT', (unicode(c) % 4 + 1)::INT, 1)), '')"


@query(
    f"""WITH d AS (SELECT item_id AS rid, list_transform(string_split(text, ''), lambda c: (unicode(c) % 4)::BIGINT) AS b FROM benchmark),
    k AS (SELECT rid, i + 4 AS pos, b[i+1]*256 + b[i+2]*64 + b[i+3]*16 + b[i+4]*4 + b[i+5] AS f, (3-b[i+5])*256 + (3-b[i+4])*64 + (3-b[i+3])*16 + (3-b[i+2])*4 + (3-b[i+1]) AS r FROM d, range(len(b) - 4) t(i)),
    h AS ({_hash_sql("least(f, r)", 10).format("(SELECT * FROM k WHERE f <> r)")}),
    o AS (SELECT rid, pos, hash, (r < f)::INT AS strand, row_number() OVER (PARTITION BY rid ORDER BY pos) AS rn, count(*) OVER (PARTITION BY rid) AS n FROM h),
    m AS (SELECT *, CASE WHEN rn + 3 <= n THEN min(hash) OVER (PARTITION BY rid ORDER BY rn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) END AS least FROM o),
    s AS (SELECT *, list(least) OVER (PARTITION BY rid ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near FROM m)
    SELECT rid, hash, pos::INT AS pos, strand FROM s WHERE list_contains(near, hash)"""
)
def minimizer_sketch_clean(spark, sf):
    """The 5-mers of the benchmark, as bases, that are the smallest of some four in a row (WN-1, KN-1)."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("rid"), nt.as_dna(F.col("text")).alias("seq"))
    return seeding.sketch(items, 5, 4)


@query(f"SELECT item_id, {_DNA} AS seq, reverse(translate({_DNA}, 'ACGT', 'TGCA')) AS rev FROM benchmark")
def revcomp_projection(spark, sf):
    """Both strands of the benchmark as bases (FN-1 to FN-4, GR-19)."""
    items = table(spark, sf, "benchmark").select("item_id", nt.as_dna(F.col("text")).alias("seq"))
    return items.withColumn("rev", nt.reverse_complement(F.col("seq")))


@query("SELECT event_id, coalesce(lag(event_type) OVER w = event_type, false) OR coalesce(lead(event_type) OVER w = event_type, false) AS tandem FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def tandem_flags(spark, sf):
    """Events whose neighbour in time is of the same type (WN-2)."""
    e = table(spark, sf, "events")
    minis = e.select("event_id", F.col("user_id").alias("rid"), F.struct("ts", "event_id").alias("pos"), F.col("event_type").alias("hash"))
    return seeding.tandem(minis).select("event_id", "tandem")


@query(f"SELECT event_id, {SECONDS} - lag({SECONDS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events")
def anchor_gap_profile(spark, sf):
    """Seconds since a user's event before (WN-3)."""
    return seeding.gaps(event_times(spark, sf), ["user_id"], ["ts", "event_id"], "st").select("event_id", "gap")


@query(
    f"""WITH g AS ({GRAMS.format(key="item_id", text="text", table="benchmark", n=2)})
    SELECT q.item_id AS qid, t.item_id AS seg, count(*) AS n FROM g q JOIN g t USING (gram) WHERE NOT (q.item_id = t.item_id AND q.pos = t.pos) GROUP BY ALL"""
)
def self_hit_filter(spark, sf):
    """Seeds of the benchmark against itself without the diagonal (FL-2)."""
    g = mapping.word_grams(table(spark, sf, "benchmark"), "item_id", "text", 2)
    pairs = g.toDF("qid", "qpos", "gram").join(g.toDF("seg", "tpos", "gram"), "gram").withColumn("rev", F.lit(False))
    return seeding.drop_diagonal(pairs, F.col("qid"), F.col("seg")).groupBy("qid", "seg").agg(F.count(F.lit(1)).alias("n"))


# --- intervals -----------------------------------------------------------------------------------------------
WINDOWS = f"(SELECT *, {SECONDS} AS st, {SECONDS} + 3600 AS en FROM events)"
# equal intervals get places, so that both windows see them in one order
ISLANDS = """SELECT {key}, min(st) AS st, max(en) AS en, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, CASE WHEN max(en) OVER (PARTITION BY {key} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= st THEN 0 ELSE 1 END AS new FROM
    (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY st, en) AS place FROM {rows}))) GROUP BY {key}, run"""


@query(f"SELECT a.event_id AS a, b.event_id AS b FROM {WINDOWS} a JOIN {WINDOWS} b ON a.user_id = b.user_id AND a.st < b.en AND b.st < a.en AND a.event_id < b.event_id")
def interval_overlap_join(spark, sf):
    """Pairs of events of one user within an hour (JN-4, JN-5)."""
    e = event_windows(spark, sf, 3600)
    pairs = intervals.overlap_join(e.select("user_id", "st", "en", F.col("event_id").alias("a")), e.select("user_id", "st", "en", F.col("event_id").alias("b")), ["user_id"], 7200)
    return pairs.where("a < b").select("a", "b")


@query(f"SELECT event_id FROM {WINDOWS} a WHERE EXISTS (SELECT 1 FROM ({ISLANDS.format(key='user_id', rows=WINDOWS)}) b WHERE n > 1 AND a.user_id = b.user_id AND b.st <= a.st AND a.en <= b.en)")
def interval_containment_semi(spark, sf):
    """Events inside an island of several events (JN-7)."""
    e = event_windows(spark, sf, 3600)
    return intervals.contained(e, intervals.union(e, ["user_id"], 86_400).where("n > 1"), ["user_id"], 86_400).select("event_id")


@query(f"SELECT user_id, sum(en - st)::BIGINT AS length, count(*) AS islands FROM ({ISLANDS.format(key='user_id', rows=WINDOWS)}) GROUP BY user_id")
def interval_union_len(spark, sf):
    """Length and number of each user's islands of events (WN-4, AG-18, ST-2)."""
    return intervals.union_length(event_windows(spark, sf, 3600), ["user_id"], 86_400)


@query(
    f"""WITH a AS (SELECT user_id, st, en FROM {WINDOWS} WHERE event_type = 'click'), b AS (SELECT user_id, st, en FROM {WINDOWS} WHERE event_type <> 'click'),
    s AS (SELECT user_id, pos, sum(x) AS x, sum(y) AS y FROM (SELECT user_id, st AS pos, 1 AS x, 0 AS y FROM a UNION ALL SELECT user_id, en, -1, 0 FROM a UNION ALL SELECT user_id, st, 0, 1 FROM b UNION ALL SELECT user_id, en, 0, -1 FROM b) GROUP BY ALL),
    p AS (SELECT user_id, pos AS st, lead(pos) OVER w AS en, sum(x) OVER w AS x, sum(y) OVER w AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos))
    SELECT user_id, st, en FROM ({ISLANDS.format(key="user_id", rows="(SELECT * FROM p WHERE x > 0 AND y = 0 AND en IS NOT NULL)")})"""
)
def interval_subtract_blacklist(spark, sf):
    """Hours after clicks less those after other events (ST-5)."""
    e = event_windows(spark, sf, 3600)
    return intervals.subtract(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), ["user_id"], 86_400)


@query(
    f"""WITH d AS (SELECT DISTINCT user_id, {SECONDS} // 86400 * 86400 AS st FROM events), q AS (SELECT user_id, st AS q_st, st + 86400 AS q_en FROM d),
    h AS (SELECT q.*, greatest(q_st, st) AS st, least(q_en, en) AS en FROM q JOIN {WINDOWS} e ON q.user_id = e.user_id AND q_st < en AND st < q_en),
    c AS (SELECT user_id, q_st, sum(n) AS n_overlaps, sum(en - st) AS covered FROM ({ISLANDS.format(key="user_id, q_st", rows="h")}) GROUP BY ALL)
    SELECT user_id, q_st AS st, q_en AS en, coalesce(n_overlaps, 0)::BIGINT AS n_overlaps, coalesce(covered, 0)::BIGINT AS covered FROM q LEFT JOIN c USING (user_id, q_st)"""
)
def interval_coverage_by(spark, sf):
    """How much of each user's days the hours after events cover (AG-19)."""
    e = event_windows(spark, sf, 3600)
    days = e.select("user_id", F.expr("st div 86400 * 86400").alias("st")).distinct().withColumn("en", F.col("st") + 86_400).withColumns({"q_st": F.col("st"), "q_en": F.col("en")})
    return intervals.coverage(days, e, ["user_id"], ["q_st"], 86_400).select("user_id", "st", "en", "n_overlaps", "covered")


@query(
    """WITH p AS (SELECT l_linestatus AS ctg, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS day FROM lineitem), n AS (SELECT ctg, max(day) + 1 AS length FROM p GROUP BY ctg),
    w AS (SELECT ctg, greatest(x - 45, 0) AS st, least(x + 45, length) AS en, x AS centre FROM n, LATERAL (SELECT unnest(range(0, length, 30)) AS x))
    SELECT w.ctg, st, en, centre, count(day) AS n FROM w LEFT JOIN p ON w.ctg = p.ctg AND day >= st AND day < en GROUP BY ALL"""
)
def sliding_genomic_window(spark, sf):
    """Shipments in sliding 90-day windows (WN-11)."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    p = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("ctg"), day.alias("st")).agg(F.count(F.lit(1)).alias("n")).withColumn("en", F.col("st") + 1)
    lengths = p.groupBy("ctg").agg(F.max("en").alias("length"))
    w = intervals.sliding_windows(lengths, ["ctg"], 90, 30)
    hits = intervals.overlap_join(w, p, ["ctg"], 90).groupBy("ctg", "st", "en", "centre").agg(F.sum("n").alias("n"))
    return w.join(hits, ["ctg", "st", "en", "centre"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    f"""WITH e AS (SELECT *, {SECONDS} AS pos FROM events), s AS (SELECT *, lead(pos) OVER w AS nx, lead(value) OVER w AS vx FROM (SELECT event_type, pos, max(value) AS value FROM e WHERE event_id % 10 = 0 GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY pos))
    SELECT e.event_id, round(s.value + coalesce((vx - s.value) * (e.pos - s.pos) / (nx - s.pos), 0.0), 6) AS value FROM (SELECT * FROM e WHERE event_id % 10 <> 0) e ASOF LEFT JOIN s ON e.event_type = s.event_type AND e.pos >= s.pos"""
)
def step_function_asof(spark, sf):
    """Values between the steps that every tenth event sets (JN-14)."""
    e = event_times(spark, sf).withColumnRenamed("st", "pos")
    steps = e.where("event_id % 10 = 0").groupBy("event_type", "pos").agg(F.max("value").alias("value"))
    found = intervals.step_lookup(e.where("event_id % 10 <> 0").select("event_type", "pos", "event_id"), steps, ["event_type"], "value", 3600)
    return found.select("event_id", F.round("value", 6).alias("value"))


@query(
    f"""WITH t AS (SELECT * FROM {WINDOWS} WHERE event_type = 'click'), c AS (SELECT * FROM {WINDOWS} WHERE event_type = 'view')
    SELECT 'FN' AS kind, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = t.user_id AND c.st < t.en AND t.st < c.en)) AS n, count(*) AS total FROM t
    UNION ALL SELECT 'FP', count(*) FILTER (NOT EXISTS (SELECT 1 FROM t WHERE c.user_id = t.user_id AND c.st < t.en AND t.st < c.en)), count(*) FROM c"""
)
def overlap_anti_eval(spark, sf):
    """Clicks without a view and views without a click near them (JN-13, AG-20)."""
    e = event_windows(spark, sf, 3600)
    truth, calls = e.where("event_type = 'click'"), e.where("event_type = 'view'")

    def missed(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        hit = intervals.overlap_join(a.select("user_id", "st", "en", "event_id"), b.select("user_id", "st", "en"), ["user_id"], 7200).select("event_id").distinct().withColumn("hit", F.lit(1))
        return a.join(hit, "event_id", "left").agg(F.count_if(F.col("hit").isNull()).alias("n"), F.count(F.lit(1)).alias("total")).select(F.lit(kind).alias("kind"), "n", "total")

    return missed(truth, calls, "FN").unionByName(missed(calls, truth, "FP"))


# --- records -------------------------------------------------------------------------------------------------
@query(
    """SELECT conv_id, turn, fragment, row_number() OVER (PARTITION BY conv_id, fragment ORDER BY turn) - 1 AS fragment_ord FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS fragment FROM
    (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS new FROM conversations))"""
)
def frag_grouping(spark, sf):
    """Runs of turns of one role (SC-10)."""
    turns = table(spark, sf, "conversations").withColumn("name", F.concat("role", F.lit("/1")))
    return fasta.fragments(turns, ["conv_id"], "turn").select("conv_id", "turn", "fragment", "fragment_ord")


@query(
    """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents), l AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id, quality, toxic) - 1 AS ord FROM labels)
    SELECT ord, d.doc_id AS a, l.doc_id AS b, toxic FROM d JOIN l USING (ord)"""
)
def zip_scan_positional(spark, sf):
    """Documents and labels paired by their place (SC-9, GR-1)."""
    d = ordering.dense_numbers(table(spark, sf, "documents").select("doc_id"), ["doc_id"], "n")
    lab = ordering.dense_numbers(table(spark, sf, "labels"), ["doc_id", "quality", "toxic"], "n")
    return fasta.zip_records(d, lab, "n").select("ord", F.col("first.doc_id").alias("a"), F.col("second.doc_id").alias("b"), F.col("second.toxic").alias("toxic"))


@query("SELECT conv_id, string_agg(text, repeat('N', 5) ORDER BY turn) AS seq FROM conversations WHERE length(text) >= 10 GROUP BY conv_id")
def join_with_separator(spark, sf):
    """Texts of each conversation in one, N between (FL-14)."""
    turns = table(spark, sf, "conversations").withColumnRenamed("text", "seq")
    return fasta.join_records(turns, ["conv_id"], "turn", 5, 10)


@query("SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS block FROM conversations")
def island_by_header(spark, sf):
    """Turns in blocks that a user's turn starts (WN-14)."""
    return ordering.runs(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "block").select("conv_id", "turn", "block")


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'et:Z:' || event_type || chr(9) || 'k0:i:' || CAST(json_extract(props, '$.k') AS BIGINT) || chr(9) || 'up:i:1' AS line FROM events"""
)
def tag_codec(spark, sf):
    """Tags parsed from text, one dropped, one set, and written again (SC-5, SC-6)."""
    text = F.concat(F.lit("k0:i:"), F.get_json_object("props", "$.k"), F.lit("\tet:Z:"), F.col("event_type"), F.lit("\txx:f:1.5\tup:i:0\tbad"))
    parsed = tags.put(tags.drop(tags.parse(F.split(text, "\t")), "xx"), "up", "i", F.lit(1))
    return table(spark, sf, "events").select("event_id", tags.get(parsed, "k0").cast("long").alias("k"), F.array_join(tags.render(parsed), "\t").alias("line"))


@query(
    """WITH o AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN '=' WHEN 'view' THEN 'X' WHEN 'purchase' THEN 'I' ELSE 'D' END AS op FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, op ORDER BY ts, event_id) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM o),
    q AS (SELECT user_id, op, g, count(*) AS len, min(rn) AS rn FROM r GROUP BY ALL)
    SELECT user_id, string_agg(len || op, '' ORDER BY rn) AS cigar, coalesce(sum(len) FILTER (op = '='), 0)::BIGINT AS mlen, sum(len)::BIGINT AS blen, coalesce(sum(len) FILTER (op <> 'I'), 0)::BIGINT AS tlen, coalesce(sum(len) FILTER (op <> 'D'), 0)::BIGINT AS qlen,
    round(coalesce(sum(len) FILTER (op = '='), 0) / nullif(coalesce(sum(len) FILTER (op IN ('=', 'X')), 0) + count(*) FILTER (op IN ('I', 'D')), 0), 9) AS gap_compressed FROM q GROUP BY user_id"""
)
def cigar_summary(spark, sf):
    """Each user's events as a CIGAR and its lengths (FN-11, FN-12, FN-22)."""
    op = F.when(F.col("event_type") == "click", "=").when(F.col("event_type") == "view", "X").when(F.col("event_type") == "purchase", "I").otherwise("D")
    ops = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", op.alias("op")))).alias("_o"))
    runs = ops.select("user_id", cigar.render(cigar.merge_runs(F.transform("_o", lambda x: x["op"]))).alias("cigar"))
    s = runs.select("user_id", "cigar", cigar.summary(cigar.parse(F.col("cigar"))).alias("s"))
    return s.select("user_id", "cigar", "s.mlen", "s.blen", "s.tlen", "s.qlen", F.round("s.gap_compressed", 9).alias("gap_compressed"))


# --- graphs --------------------------------------------------------------------------------------------------
STEPS = "(SELECT l_orderkey AS walk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord, l_partkey AS seg, l_partkey * 2 + (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS v FROM lineitem)"
ARCS = f"(SELECT v, w, min(walk) AS rank, count(*) AS n FROM (SELECT walk, v, lead(v) OVER (PARTITION BY walk ORDER BY ord) AS w FROM {STEPS}) WHERE w IS NOT NULL GROUP BY v, w)"


#: The columns that put the steps of an order in order.
STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def ordered_steps(spark, sf) -> DataFrame:
    """Orders as walks over parts, in STEP_ORDER; returned lines run on the reverse strand."""
    rev = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("walk"), *STEP_ORDER, (F.col("l_partkey") * 2 + rev).alias("v"))


def walk_steps(spark, sf) -> DataFrame:
    """The steps of walks, numbered."""
    return ordered_steps(spark, sf).select("walk", F.row_number().over(Window.partitionBy("walk").orderBy(*STEP_ORDER)).alias("ord"), F.col("l_partkey").alias("seg"), "v")


def walk_arcs(spark, sf) -> DataFrame:
    taken = coverage.traversals(ordered_steps(spark, sf), ["walk"], STEP_ORDER)
    return taken.groupBy("v", "w").agg(F.min("walk").alias("rank"), F.count(F.lit(1)).alias("n"))


def as_arcs(df: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.select("v", "w", zero.alias("ov"), zero.alias("ow"), "rank", (F.col("v") * 1_000_000 + F.col("w")).alias("link"), F.lit(False).alias("comp"))


@query(f"SELECT v, w, rank, n FROM {ARCS}")
def graph_build_from_walks(spark, sf):
    """The arcs that walks take (GR-1, GR-5, GR-6)."""
    return walk_arcs(spark, sf)


@query(
    f"""WITH a AS (SELECT v, w, v * 1000000 + w AS link FROM {ARCS}), d AS (SELECT xor(w, 1) AS v, xor(v, 1) AS w, link FROM a), g AS (SELECT a.v, a.w, a.link, d.link AS other FROM a LEFT JOIN d ON a.v = d.v AND a.w = d.w AND a.v <> xor(a.w, 1))
    SELECT v, w, CASE WHEN second THEN other ELSE link END AS link, second AS comp FROM (SELECT *, other IS NOT NULL AND (xor(w, 1) < v OR (xor(w, 1) = v AND xor(v, 1) < w)) AS second FROM g)
    UNION ALL SELECT v, w, link, true FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.v = d.v AND a.w = d.w)"""
)
def graph_symmetric_closure(spark, sf):
    """Arcs and their duals with shared link numbers (GR-9)."""
    return graph.symmetric(as_arcs(walk_arcs(spark, sf))).select("v", "w", "link", "comp")


@query(f"SELECT v, w, count(*) AS n FROM (SELECT v, lead(v) OVER (PARTITION BY walk ORDER BY ord) AS w FROM {STEPS}) WHERE w IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def graph_multi_edge_count(spark, sf):
    """Parallel arcs (GR-13)."""
    return graph.multi_edges(coverage.traversals(walk_steps(spark, sf), ["walk"]))


@query(
    f"""WITH a AS (SELECT walk AS rank, v, lead(v) OVER (PARTITION BY walk ORDER BY ord) AS w FROM {STEPS}), k AS (SELECT v, w, rank, CASE WHEN (v, w) <= (xor(w, 1), xor(v, 1)) THEN (v, w) ELSE (xor(w, 1), xor(v, 1)) END AS key FROM a WHERE w IS NOT NULL),
    b AS (SELECT key, min(rank) AS best FROM k GROUP BY key) SELECT DISTINCT v, w, rank FROM k JOIN b USING (key) WHERE rank = best"""
)
def graph_multi_edge_dedup(spark, sf):
    """Of parallel arcs, on either strand, those of the lowest rank (GR-14)."""
    taken = coverage.traversals(walk_steps(spark, sf), ["walk"]).withColumn("rank", F.col("walk")).withColumn("link", F.lit(0).cast("long"))
    return graph.single_edges(taken).select("v", "w", "rank")


@query(f"SELECT v, w FROM {ARCS} WHERE (v >> 1) IN (SELECT p_partkey FROM part WHERE p_size > 10) AND (w >> 1) IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def graph_dangling_filter(spark, sf):
    """Arcs both of whose parts stay (GR-7, GR-16)."""
    live = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("seg"), F.col("p_size").alias("len"))
    return graph.drop_dangling(walk_arcs(spark, sf), live).select("v", "w")


@query(
    f"""WITH t AS (SELECT v, lead(v) OVER (PARTITION BY walk ORDER BY ord) AS w, walk FROM {STEPS}), a AS (SELECT v, w, count(*) AS n, min(walk) AS link FROM t WHERE w IS NOT NULL GROUP BY ALL), q AS (SELECT DISTINCT l_partkey * 2 AS v, l_suppkey * 2 AS w FROM lineitem)
    SELECT q.v, q.w, CASE WHEN n IS NULL THEN -1 WHEN n > 1 THEN -2 ELSE a.link END AS link FROM q LEFT JOIN a ON q.v = a.v AND q.w = a.w"""
)
def arc_lookup_unique(spark, sf):
    """The one arc between two vertices, -1 for none, -2 for several (GR-17)."""
    arcs = coverage.traversals(walk_steps(spark, sf), ["walk"]).withColumn("link", F.col("walk"))
    wanted = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("v"), (F.col("l_suppkey") * 2).alias("w")).distinct()
    return graph.find_arcs(wanted, arcs)


@query("SELECT c_mktsegment AS sn, min(c_custkey) AS min, max(c_custkey + c_nationkey) AS max, min(c_nationkey) AS rank, min(c_nationkey) <> max(c_nationkey) AS conflict FROM customer GROUP BY 1")
def stable_seq_bounds(spark, sf):
    """Extent, rank and rank conflicts of stable sequences (GR-3)."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("sn"), F.col("c_custkey").alias("so"), F.col("c_nationkey").alias("len"), F.col("c_nationkey").alias("sr"))
    return graph.stable_bounds(c)


# a small layered graph: regions (0..), nations (1000..), suppliers (100000..), and short cuts from nation to nation
DAG = """(SELECT r_regionkey::BIGINT AS v, 1000 + n_nationkey::BIGINT AS w, n_nationkey + 1::BIGINT AS dist FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT 1000 + a.n_nationkey, 1000 + b.n_nationkey, 2 FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5
    UNION ALL SELECT 1000 + s_nationkey, 100000 + s_suppkey, s_suppkey % 7 + 1 FROM supplier)"""


def layered(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    down = n.select(F.col("n_regionkey").cast("long").alias("v"), (F.col("n_nationkey") + 1000).cast("long").alias("w"), (F.col("n_nationkey") + 1).cast("long").alias("dist"))
    side = n.alias("a").join(n.alias("b"), F.col("b.n_nationkey") == F.col("a.n_nationkey") + 5).select((F.col("a.n_nationkey") + 1000).cast("long").alias("v"), (F.col("b.n_nationkey") + 1000).cast("long").alias("w"), F.lit(2).cast("long").alias("dist"))
    leaf = table(spark, sf, "supplier").select((F.col("s_nationkey") + 1000).cast("long").alias("v"), (F.col("s_suppkey") + 100_000).alias("w"), (F.col("s_suppkey") % 7 + 1).alias("dist"))
    return down.unionByName(side).unionByName(leaf)


PATHS = f"WITH RECURSIVE a AS MATERIALIZED {DAG}, p(source, v, dist, walk) AS (SELECT r_regionkey::BIGINT, r_regionkey::BIGINT, 0::BIGINT, [r_regionkey::BIGINT] FROM region UNION ALL SELECT source, w, p.dist + a.dist, list_append(walk, w) FROM p JOIN a ON p.v = a.v)"


@query(f"{PATHS} SELECT source, v, min(dist) AS dist FROM p GROUP BY ALL")
def reachability_min_dist(spark, sf):
    """Smallest distances from the regions (JN-10)."""
    sources = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("source"))
    return graph.reach(layered(spark, sf), sources).select("source", "v", "dist")


@query(f"{PATHS} SELECT source, v AS target, row_number() OVER (PARTITION BY source, v ORDER BY dist, walk) AS rank, dist, array_to_string(walk, '>') AS walk FROM p WHERE v >= 100000 QUALIFY rank <= 3")
def k_shortest_walks(spark, sf):
    """The three shortest walks from each region to each supplier (JN-10, SO-4)."""
    pairs = table(spark, sf, "region").crossJoin(table(spark, sf, "supplier").select((F.col("s_suppkey") + 100_000).alias("target"))).select(F.col("r_regionkey").cast("long").alias("source"), "target")
    found = graph.k_shortest(layered(spark, sf), pairs, 3)
    return found.withColumn("walk", F.array_join(F.transform("walk", lambda x: x.cast("string")), ">"))


@query(f"{PATHS} SELECT source, v, count(*) AS n FROM p GROUP BY ALL")
def path_count_dp(spark, sf):
    """The number of paths from each region (AG-12)."""
    return graph.count_paths(layered(spark, sf), table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("source")))


@query("WITH c AS (SELECT l_partkey AS seg, sum(CAST(l_quantity AS BIGINT)) AS c FROM lineitem GROUP BY 1) SELECT p_partkey AS seg, round(coalesce(c, 0) / p_size, 6) AS depth FROM part LEFT JOIN c ON seg = p_partkey")
def walk_depth_coverage(spark, sf):
    """Depth of each part (AG-8)."""
    steps = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("seg"), F.lit(0).cast("long").alias("st"), F.col("l_quantity").cast("long").alias("en"))
    return coverage.depth(steps, table(spark, sf, "part").select(F.col("p_partkey").alias("seg"), F.col("p_size").alias("len"))).withColumn("depth", F.round("depth", 6))


@query(
    f"""WITH t AS (SELECT v, lead(v) OVER (PARTITION BY walk ORDER BY ord) AS w FROM {STEPS}), b AS (SELECT v, w FROM t WHERE w IS NOT NULL UNION ALL SELECT xor(w, 1), xor(v, 1) FROM t WHERE w IS NOT NULL) SELECT a.v, a.w, count(*) AS n FROM {ARCS} a JOIN b ON a.v = b.v AND a.w = b.w GROUP BY ALL"""
)
def walk_link_counts(spark, sf):
    """Traversals of each arc on either strand (AG-8, JN-17)."""
    return coverage.link_counts(ordered_steps(spark, sf), ["walk"], walk_arcs(spark, sf), STEP_ORDER)


@query(
    f"""WITH s AS (SELECT l_suppkey AS sample, l_partkey AS seg, CAST(l_quantity AS BIGINT) % 40 AS st, CAST(l_quantity AS BIGINT) % 40 + 5 AS en FROM lineitem),
    u AS ({ISLANDS.format(key="sample, seg", rows="s")}), c AS (SELECT seg, sum(en - st) AS c FROM u GROUP BY seg) SELECT p_partkey AS seg, round(coalesce(c, 0) / 45 / 10, 9) AS breadth FROM part LEFT JOIN c ON seg = p_partkey"""
)
def walk_breadth_coverage(spark, sf):
    """Breadth of each part over samples (AG-9)."""
    q = F.col("l_quantity").cast("long") % 40
    steps = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("seg"), q.alias("st"), (q + 5).alias("en"))
    segs = table(spark, sf, "part").select(F.col("p_partkey").alias("seg"), F.lit(45).alias("len"))
    return coverage.breadth(steps, segs, "sample", 10).withColumn("breadth", F.round("breadth", 9))


@query(
    f"""WITH t AS (SELECT walk % 50 AS sample, v, lead(v) OVER (PARTITION BY walk ORDER BY ord) AS w FROM {STEPS}) SELECT v, w, round(count(DISTINCT sample) / 50, 6) AS use FROM t WHERE w IS NOT NULL GROUP BY v, w"""
)
def walk_link_use(spark, sf):
    """Share of samples that take each arc (AG-9)."""
    steps = ordered_steps(spark, sf).withColumn("sample", F.col("walk") % 50)
    return coverage.link_use(steps, "sample", ["walk"], 50, STEP_ORDER).withColumn("use", F.round("use", 6))


def nation_graph(spark, sf) -> graph.SequenceGraph:
    """Nations in order as their region's reference; suppliers as other ways from a nation to the next."""
    n = table(spark, sf, "nation")
    by = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    line = n.select(F.col("n_nationkey").cast("long").alias("seg"), F.col("n_regionkey").cast("string").alias("sn"), F.lead("n_nationkey").over(by).cast("long").alias("next"))
    own = line.select("seg", F.lit(4).cast("long").alias("len"), "sn", (F.col("seg") * 4).alias("so"), F.lit(0).cast("long").alias("sr"))
    s = table(spark, sf, "supplier").join(line, F.col("s_nationkey") == F.col("seg")).where("next IS NOT NULL").select((F.col("s_suppkey") + 1000).alias("sup"), "seg", "next")
    other = s.select(F.col("sup").alias("seg"), (F.col("sup") % 7 + 1).alias("len"), F.lit("s").alias("sn"), F.lit(0).cast("long").alias("so"), F.lit(1).cast("long").alias("sr"))
    ends = line.where("next IS NOT NULL").select("seg", "next").unionByName(s.select("seg", F.col("sup").alias("next"))).unionByName(s.select(F.col("sup").alias("seg"), "next"))
    arcs = as_arcs(ends.select((F.col("seg") * 2).alias("v"), (F.col("next") * 2).alias("w"), F.lit(0).cast("long").alias("rank")))
    name = F.concat(F.lit("s"), F.col("seg").cast("string")).alias("name")
    seq = F.repeat(F.lit("A"), F.col("len").cast("int")).alias("seq")
    tags_ = F.lit(None).cast(tags.KIND).alias("tags")
    return graph.SequenceGraph(own.unionByName(other).select("seg", name, seq, "len", "sn", "so", "sr", tags_), graph.symmetric(arcs))


@query(
    """WITH n AS (SELECT n_nationkey::BIGINT AS seg, n_regionkey::VARCHAR AS sn, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS next FROM nation)
    SELECT sn, seg * 4 + 4 AS ss, next * 4 AS se, seg * 2 AS source, next * 2 AS sink, count(*) + 2 AS n_seg, count(*) + 1 AS n_paths, 0 AS len_min, max((s_suppkey + 1000) % 7 + 1)::BIGINT AS len_max, false AS is_inv
    FROM n JOIN supplier ON s_nationkey = seg WHERE next IS NOT NULL GROUP BY ALL"""
)
def bubble_detect(spark, sf):
    """Bubbles of the graph of nations (KN-24, KN-25, AG-12)."""
    g = nation_graph(spark, sf)
    return bubbles.bubbles(g.segments, g.arcs)


@query(
    """WITH n AS (SELECT n_nationkey::BIGINT AS seg, n_regionkey::VARCHAR AS sn, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS next, row_number() OVER (ORDER BY n_nationkey) - 1 AS r, count(*) OVER () AS total FROM nation),
    s AS (SELECT s_suppkey + 1000 AS sup, seg, next, 2 * total + row_number() OVER (ORDER BY s_suppkey) - 1 AS id FROM supplier JOIN n ON s_nationkey = seg WHERE next IS NOT NULL),
    i AS (SELECT seg, r, sn, 2 * total + (SELECT count(*) FROM s) + r AS id FROM n), m AS (SELECT a.r AS ra, b.r AS rb FROM n a JOIN n b ON a.next = b.seg),
    l AS (SELECT 4 * r AS v, 4 * r + 2 AS w FROM n UNION ALL SELECT 4 * ra + 2, 4 * rb FROM m UNION ALL SELECT 4 * r + 2, 2 * id FROM s JOIN n USING (seg) UNION ALL SELECT 2 * id, 4 * r FROM s JOIN n ON s.next = n.seg UNION ALL SELECT 4 * r, 2 * id FROM i UNION ALL SELECT 2 * id, 4 * r + 2 FROM i)
    SELECT 'S' AS kind, 2 * r AS a, 2::BIGINT AS b, sn, seg * 4 AS so FROM n UNION ALL SELECT 'S', 2 * r + 1, 2, sn, seg * 4 + 2 FROM n UNION ALL SELECT 'S', id, sup % 7 + 1, 's', 0 FROM s UNION ALL SELECT 'S', id, 3, 'ins' || seg, 0 FROM i
    UNION ALL SELECT 'L', v, w, NULL, NULL FROM l UNION ALL SELECT 'L', xor(w, 1), xor(v, 1), NULL, NULL FROM l"""
)
def graph_augment(spark, sf):
    """Three bases put into the middle of each nation's segment: all segments and arcs of the grown graph (KN-23, ST-1)."""
    g = nation_graph(spark, sf)
    mid = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ins"), (F.col("n_nationkey") * 2).cast("long").alias("v0"), F.lit(2).cast("long").alias("off0"))
    grown = augment.augment(g, mid.select("ins", "v0", "off0", F.col("v0").alias("v1"), F.col("off0").alias("off1"), F.lit("TTT").alias("seq")))
    segs = grown.segments.select(F.lit("S").alias("kind"), F.col("seg").alias("a"), F.col("len").alias("b"), "sn", "so")
    return segs.unionByName(grown.arcs.select(F.lit("L").alias("kind"), F.col("v").alias("a"), F.col("w").alias("b"), F.lit(None).cast("string").alias("sn"), F.lit(None).cast("long").alias("so")))


# --- ranks ---------------------------------------------------------------------------------------------------
CHAINS = "(SELECT l_orderkey AS qid, CAST(l_quantity AS BIGINT) AS score, CAST(round(l_extendedprice * 100) AS BIGINT) AS hash, l_partkey % 100 AS qs, l_partkey % 100 + l_linenumber * 10 AS qe, l_suppkey AS ts, l_suppkey + l_linenumber AS te, l_linenumber::BIGINT AS cnt FROM lineitem)"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, hash DESC, qs, qe, ts, te) - 1 AS rank FROM {CHAINS})"


def order_chains(spark, sf) -> DataFrame:
    """The lines of an order as chains of a query."""
    c = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("qid"), F.col("l_quantity").cast("long").alias("score"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("hash"), (F.col("l_partkey") % 100).alias("qs"),
        (F.col("l_partkey") % 100 + F.col("l_linenumber") * 10).alias("qe"), F.col("l_suppkey").alias("ts"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("te"), F.col("l_linenumber").cast("long").alias("cnt"),
    )
    return c.withColumn("rank", (F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("hash"), "qs", "qe", "ts", "te")) - 1).cast("long"))


@query(f"SELECT qid, rank, score, hash FROM {RANKED} WHERE rank < 3")
def chain_rank_topn(spark, sf):
    """The three best chains of each query (WN-5, WN-8, SO-5)."""
    return ordering.top_k(order_chains(spark, sf).drop("rank"), ["qid"], [F.desc("score"), F.desc("hash"), F.col("qs"), F.col("qe"), F.col("ts"), F.col("te")], 3).select("qid", (F.col("rank") - 1).cast("long").alias("rank"), "score", "hash")


@query(
    f"""WITH r AS {RANKED}, j AS (SELECT r.*, p.score AS ps, (r.qs, r.qe, r.ts, r.te) = (p.qs, p.qe, p.ts, p.te) AS same FROM r JOIN r p ON r.qid = p.qid AND p.rank = 0),
    g AS (SELECT *, rank > 0 AND NOT same AND (score >= ps * 0.8 OR score + 5 >= ps) AS good FROM j)
    SELECT qid, rank, score FROM (SELECT *, sum(good::INT) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS k FROM g) WHERE rank = 0 OR (good AND k <= 2)"""
)
def secondary_filter_ratio(spark, sf):
    """Secondary chains near their parent, two a query (WN-7)."""
    c = order_chains(spark, sf).withColumn("parent", F.lit(0).cast("long"))
    return ranking.filter_secondary(c, 0.8, 5, 2).select("qid", "rank", "score")


@query(
    f"""WITH r AS {RANKED}, q AS (SELECT qid, max(score)::DOUBLE AS score, coalesce(max(score) FILTER (rank = 1), 0)::DOUBLE AS sub, count(*) - 1 AS n_sub, sum(cnt)::DOUBLE AS anchors, count(*)::DOUBLE * 20 AS qlen, count(*) * 3 AS mini, sum(score)::DOUBLE AS total FROM r GROUP BY qid),
    u AS (SELECT *, greatest(sub, 10.0) AS top, least(least(1.0, score / least(qlen, 100.0)) * (score / total), least(1.0, anchors / greatest(5.0, least(10.0, mini::DOUBLE)))) AS pen FROM q),
    m AS (SELECT *, greatest(0, least(60, (floor(pen * 40.0 * (1.0 - top / score) * ln(score)) - floor(4.343 * ln(n_sub + 1) + 0.499))::INT)) AS raw FROM u) SELECT qid, CASE WHEN raw = 0 AND score > top THEN 1 ELSE raw END::INT AS mapq FROM m"""
)
def mapq_estimate(spark, sf):
    """Mapping quality from scores, counts and uniqueness (AG-7, WN-9)."""
    q = order_chains(spark, sf).groupBy("qid").agg(F.max("score").cast("double").alias("score"), F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))), F.lit(0)).cast("double").alias("sub"), (F.count(F.lit(1)) - 1).alias("n_sub"), F.sum("cnt").cast("double").alias("anchors"), F.count(F.lit(1)).alias("n"), F.sum("score").cast("double").alias("total"))
    quality = ranking.mapping_quality(F.col("score"), F.col("sub"), F.col("n_sub"), F.col("anchors"), F.col("score") / F.col("total"), F.col("n") * 20, F.col("n") * 3, 10.0)
    return q.select("qid", quality.alias("mapq"))


@query("SELECT user_id, round(ln(count(*) / count(*) FILTER (event_type = 'click')) / 17, 6) AS div FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'click') > 0")
def divergence_estimate(spark, sf):
    """Divergence from the share of matching seeds (FN-14)."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("m"))
    return g.where("m > 0").select("user_id", F.round(nt.divergence(F.col("n"), F.col("m"), F.lit(17)), 6).alias("div"))


@query(
    f"""WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM {RANKED}),
    w(qid, rank, prim, parent) AS (SELECT DISTINCT qid, -1::BIGINT, []::STRUCT(j BIGINT, a BIGINT, b BIGINT)[], -1::BIGINT FROM c
        UNION ALL SELECT qid, rank, CASE WHEN p IS NULL THEN list_append(prim, {{'j': rank, 'a': qs, 'b': qe}}) ELSE prim END, coalesce(p, rank) FROM (SELECT *, list_filter(prim, lambda x: least(qe, x.b) > greatest(qs, x.a) AND (least(qe, x.b) - greatest(qs, x.a)) / least(qe - qs, x.b - x.a) - free / greatest(qe - qs, x.b - x.a) > 0.5)[1].j AS p
            FROM (SELECT w.qid, w.rank + 1 AS rank, w.prim, c.qs, c.qe, c.qe - c.qs - len(list_filter(range(c.qs, c.qe), lambda y: len(list_filter(w.prim, lambda x: x.a <= y AND y < x.b)) > 0)) AS free FROM w JOIN c ON c.qid = w.qid AND c.rank = w.rank + 1)))
    SELECT c.qid, c.rank, c.qs, c.qe, c.score, c.cnt, w.parent, coalesce(max(k.score), 0)::BIGINT AS sub, (count(*) FILTER (k.cnt >= c.cnt))::INT AS n_sub FROM c JOIN w ON c.qid = w.qid AND c.rank = w.rank
    LEFT JOIN (SELECT c.qid, c.rank, c.score, c.cnt, w.parent FROM c JOIN w ON c.qid = w.qid AND c.rank = w.rank WHERE w.parent <> c.rank) k ON k.qid = c.qid AND k.parent = c.rank GROUP BY ALL"""
)
def greedy_parent(spark, sf):
    """Primary and secondary chains by a scan of each query (WN-6)."""
    return ranking.assign_parents(order_chains(spark, sf), 0.5)


@query(
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, floor(value)::BIGINT - 50 AS x FROM events), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY i)::BIGINT AS hi, sum(x) OVER (PARTITION BY user_id ORDER BY i)::BIGINT - x AS lo FROM e),
    m AS (SELECT a.user_id, a.i AS st, b.i + 1 AS en, b.hi - a.lo AS score FROM s a JOIN s b ON a.user_id = b.user_id AND a.i <= b.i AND a.lo < b.hi
        WHERE a.x > 0 AND b.x > 0 AND NOT EXISTS (SELECT 1 FROM s c WHERE c.user_id = a.user_id AND c.i > a.i AND c.i <= b.i AND c.lo <= a.lo) AND NOT EXISTS (SELECT 1 FROM s c WHERE c.user_id = a.user_id AND c.i >= a.i AND c.i < b.i AND c.hi >= b.hi))
    SELECT user_id, st, en, score FROM m WHERE score >= 40 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.user_id = m.user_id AND o.st <= m.st AND m.en <= o.en AND (o.st < m.st OR m.en < o.en))"""
)
def max_scoring_segments(spark, sf):
    """All maximal scoring stretches of each user's values around 50 (KN-18)."""
    e = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.floor("value") - 50).cast("long").alias("x"))
    return ranking.maximal_segments(e, "user_id", "at", "x", 40).withColumn("score", F.col("score").cast("long"))


@query()
def linear_chain_dp(spark, sf):
    """Colinear chains with gaps of the benchmark's 3-grams in documents (KN-3, KN-5)."""
    pairs = mapping.shared_grams(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 3, 50)
    pairs = pairs.select(F.col("doc_id").alias("qid"), F.col("item_id").alias("seg"), F.lit(False).alias("rev"), (F.col("tpos") + 2).alias("tpos"), (F.col("qpos") + 2).alias("qpos"), F.lit(3).alias("span"))
    return chaining.linear_chains(pairs, chaining.ChainOptions(max_dist=60, bandwidth=20, min_count=3, min_score=6))


# --- alleles -------------------------------------------------------------------------------------------------
CALLS = f"(SELECT {SECONDS} // 86400 AS bid, user_id AS sample, string_agg(event_type, '>' ORDER BY ts, event_id) AS walk, count(*) AS length FROM events GROUP BY 1, 2)"
ALLELES = f"(SELECT bid, walk, count(*) AS n, min(sample) AS first, arg_min(length, sample) AS length, row_number() OVER (PARTITION BY bid ORDER BY count(*) DESC, min(sample), walk) - 1 AS allele FROM {CALLS} GROUP BY bid, walk)"


def day_calls(spark, sf) -> DataFrame:
    """Days as bubbles, users as samples, their events of a day as walks."""
    e = event_times(spark, sf).groupBy(F.expr("st div 86400").alias("bid"), F.col("user_id").alias("sample")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("_e"))
    return e.select("bid", "sample", F.array_join(F.transform("_e", lambda x: x["event_type"]), ">").alias("walk"), F.size("_e").cast("long").alias("length"))


@query(
    f"""WITH a AS {ALLELES}, s AS (SELECT bid, sum(n)::BIGINT AS ns, count(*) AS na, string_agg(n::VARCHAR, ',' ORDER BY allele) AS ac, string_agg(length::VARCHAR, ',' ORDER BY allele) AS alen, string_agg(walk, ',' ORDER BY allele) AS awalk FROM a GROUP BY bid),
    g AS (SELECT c.bid, string_agg(a.allele::VARCHAR, ',' ORDER BY c.sample) AS gt FROM {CALLS} c JOIN a ON c.bid = a.bid AND c.walk = a.walk GROUP BY c.bid) SELECT s.*, gt FROM s JOIN g USING (bid)"""
)
def allele_merge(spark, sf):
    """Alleles of each bubble by frequency and the samples' genotypes (AG-13, JN-15)."""
    return alleles.merge_alleles(day_calls(spark, sf), ["bid"])


@query(
    f"""WITH a AS {ALLELES}, s AS (SELECT bid, sum(n)::BIGINT AS ns, count(*) AS na, string_agg(n::VARCHAR, ',' ORDER BY allele) AS ac, string_agg(walk, ',' ORDER BY allele) AS awalk FROM a GROUP BY bid),
    g AS (SELECT c.bid, string_agg(a.allele::VARCHAR, chr(9) ORDER BY c.sample) AS gt FROM {CALLS} c JOIN a ON c.bid = a.bid AND c.walk = a.walk GROUP BY c.bid)
    SELECT concat_ws(chr(9), 'day', bid, '.', 'N', CASE WHEN na > 1 THEN array_to_string(list_transform(range(1, na), lambda i: '<X:' || i || '>'), ',') ELSE '.' END, '.', '.', 'END=' || (bid + 1) || ';NS=' || ns || ';AC=' || ac || ';AWALK=' || awalk, 'GT', gt) AS line FROM s JOIN g USING (bid)"""
)
def vcf_text(spark, sf):
    """The merged bubbles as VCF lines, without the header (SC-17)."""
    merged = alleles.merge_alleles(day_calls(spark, sf), ["bid"])
    rows = merged.select(F.lit("day").alias("ctg"), F.col("bid").alias("st"), (F.col("bid") + 1).alias("en"), "ns", "na", "ac", "awalk", "gt")
    return alignments.vcf_lines(rows, []).where("value NOT LIKE '#%'").select(F.col("value").alias("line"))


@query("SELECT c_name AS qname, c_custkey AS qlen, o_orderkey AS qs FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def unmapped_rows(spark, sf):
    """Alignments and a row for each query without one (SC-16)."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("qname"), F.col("c_custkey").alias("qlen"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("qlen"), F.col("o_orderkey").alias("qs")).join(c, "qlen")
    return alignments.with_unmapped(rows.select("qname", "qlen", "qs"), c)


@query(f"SELECT bid, seg, sum(n)::BIGINT AS n FROM (SELECT bid, allele, n, unnest(list_distinct(string_split(walk, '>'))) AS seg FROM {ALLELES}) GROUP BY bid, seg")
def segment_frequency(spark, sf):
    """Samples that pass each segment of a bubble (AG-14)."""
    return alleles.segment_frequency(alleles.allele_numbers(day_calls(spark, sf), ["bid"]), ["bid"], ">")


@query(
    f"""WITH a AS {ALLELES}, g AS (SELECT c.bid, sample, allele FROM {CALLS} c JOIN a ON c.bid = a.bid AND c.walk = a.walk), r AS (SELECT bid, arg_min(allele, sample) AS ref FROM g GROUP BY bid)
    SELECT g.bid, sample, least(CASE WHEN allele = ref THEN 0 WHEN allele < ref THEN allele + 1 ELSE allele END, 3) AS gt FROM g JOIN r USING (bid)"""
)
def vcf_recode(spark, sf):
    """Genotypes with the first sample's allele as 0, three at most (AG-22)."""
    calls = day_calls(spark, sf)
    g = calls.join(alleles.allele_numbers(calls, ["bid"]).select("bid", "walk", "allele"), ["bid", "walk"]).select("bid", "sample", F.col("allele").cast("long").alias("allele"))
    ref = g.groupBy("bid").agg(F.min_by("allele", "sample").alias("_ref"))
    return g.join(ref, "bid").select("bid", "sample", alleles.recode(F.col("allele"), F.col("_ref"), 3).alias("gt"))


@query(
    """WITH c AS (SELECT CASE WHEN p_type LIKE '%BRASS%' OR p_type LIKE '%COPPER%' THEN '01_alloy' WHEN p_type LIKE '%STEEL%' THEN '02_steel' ELSE '03_other' END AS class, least(p_size // 10, 3) AS bucket, p_size FROM part)
    SELECT class, count(*) AS n, count(*) FILTER (bucket = 0) AS n0, count(*) FILTER (bucket = 1) AS n1, count(*) FILTER (bucket = 2) AS n2, count(*) FILTER (bucket = 3) AS n3, sum(p_size)::BIGINT AS length FROM c GROUP BY class"""
)
def class_crosstab(spark, sf):
    """Classes by size: counts and lengths (AG-17, FN-19)."""
    kind = F.when(F.col("p_type").rlike("BRASS|COPPER"), "01_alloy").when(F.col("p_type").rlike("STEEL"), "02_steel").otherwise("03_other")
    c = table(spark, sf, "part").select(kind.alias("class"), F.least(F.expr("p_size div 10"), F.lit(3)).alias("bucket"), "p_size")
    return c.groupBy("class").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("bucket") == k).alias(f"n{k}") for k in range(4)], F.sum("p_size").alias("length"))


@query(
    """WITH s AS (SELECT source, lang AS label, sum(n_chars)::BIGINT AS covered FROM documents GROUP BY ALL), t AS (SELECT source, sum(covered)::BIGINT AS total FROM s GROUP BY source),
    r AS (SELECT s.*, total, row_number() OVER (PARTITION BY source ORDER BY covered DESC, label) AS r FROM s JOIN t USING (source)),
    w AS (SELECT source, max(label) FILTER (r = 1) AS label, max(covered) FILTER (r = 1) AS first, coalesce(max(covered) FILTER (r = 2), 0) AS second, max(total) AS total FROM r WHERE r <= 2 GROUP BY source)
    SELECT *, CASE WHEN first >= total * 0.7 THEN label WHEN first >= total * 0.5 AND second * 2 >= first THEN 'mixed' WHEN first >= total * 0.5 THEN label ELSE 'none' END AS verdict FROM w"""
)
def label_argmax(spark, sf):
    """Each source's main language (AG-15, AG-16)."""
    s = table(spark, sf, "documents").groupBy("source", F.col("lang").alias("label")).agg(F.sum("n_chars").alias("covered"))
    t = s.groupBy("source").agg(F.sum("covered").alias("total"))
    return alleles.best_labels(s.join(t, "source"), ["source"], "total", 0.7, 0.5)


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT * FROM n WHERE event_type = 'click')
    SELECT * FROM (SELECT user_id, lag(event_id) OVER w AS src, event_id AS sink, i - lag(i) OVER w - 1 AS n_inner FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE n_inner > 0"""
)
def path_transitions(spark, sf):
    """Stretches of other events between two clicks (WN-12, JN-11)."""
    return alleles.transitions(table(spark, sf, "events"), ["user_id"], "event_id", "event_type = 'click'").withColumn("n_inner", F.col("n_inner").cast("long"))


@query("SELECT user_id, arg_min(event_id, ts) AS first_click, arg_max(event_id, ts) AS last_click FROM events WHERE event_type = 'click' GROUP BY user_id")
def first_last_extract(spark, sf):
    """First and last click of each user (WN-13)."""
    found = ordering.first_last(table(spark, sf, "events").where("event_type = 'click'"), ["user_id"], "ts", "event_id")
    return found.select("user_id", F.col("first").alias("first_click"), F.col("last").alias("last_click"))


@query(
    """WITH s AS (SELECT l_orderkey AS walk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord, l_returnflag AS sn, l_linestatus = 'O' AS rev, (l_linenumber * 10)::BIGINT AS so, (10 + l_partkey % 2)::BIGINT AS len FROM lineitem),
    m AS (SELECT *, CASE WHEN sn = lag(sn) OVER w AND rev = lag(rev) OVER w AND ((NOT rev AND so = lag(so + len) OVER w) OR (rev AND so + len = lag(so) OVER w)) THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY walk ORDER BY ord)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY walk ORDER BY ord) AS run FROM m), p AS (SELECT walk, run, any_value(sn) AS sn, any_value(rev) AS rev, min(so) AS st, max(so + len) AS en FROM r GROUP BY walk, run)
    SELECT walk, string_agg((CASE WHEN rev THEN '<' ELSE '>' END) || sn || ':' || st || '-' || en, '' ORDER BY run) AS path FROM p GROUP BY walk"""
)
def stable_path_merge(spark, sf):
    """Walks in stable coordinates, neighbours on one strand merged (KN-28, FN-15)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("walk"), F.row_number().over(order).alias("ord"), F.col("l_returnflag").alias("sn"), (F.col("l_linestatus") == "O").alias("rev"), (F.col("l_linenumber") * 10).cast("long").alias("so"), (F.col("l_partkey") % 2 + 10).alias("len"))
    return stable.stable_paths(s.withColumn("sr", F.lit(0)), ["walk"]).select("walk", "path")


# --- streams -------------------------------------------------------------------------------------------------
@query(
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, epoch_us(min(ts)) AS st, epoch_us(max(ts) + INTERVAL 1 HOUR) AS en, count(*) AS n FROM r GROUP BY user_id, run"""
)
def session_batch(spark, sf):
    """Sessions of each user with gaps of under an hour, by the plan that streams run too (section 2.10)."""
    return streams.sessions(table(spark, sf, "events"), "user_id", "ts", "1 hour").select("user_id", *[F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})").alias(c) for c in ("st", "en")], "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import graph_queries, more_queries  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
