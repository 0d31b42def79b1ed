"""Intervals, ordering, expressions, chains and sources against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftgraph.functions import cigar, nt, tags
from weftgraph.operators import chaining, intervals, ordering, ranking, seeding
from weftgraph.plans import mapping
from weftgraph.sources import alignments, fasta
from weftgraph.streaming import sessions

rng = random.Random(8)


def spans(n, keys="ab", top=200):
    out = []
    for i in range(n):
        st = rng.randrange(top)
        out.append((rng.choice(keys), st, st + rng.randrange(1, 30), i))
    return out


def covered(rows):
    return {x for st, en in rows for x in range(st, en)}


def test_overlap_join(spark):
    a, b = spans(80), spans(60)
    left = spark.createDataFrame(a, "k string, st long, en long, a int")
    right = spark.createDataFrame(b, "k string, st long, en long, b int")
    want = Counter((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    for width in (1, 7, 1000):
        assert Counter((r.a, r.b) for r in intervals.overlap_join(left, right, ["k"], width).collect()) == want


def test_union_subtract_coverage(spark):
    a, b = spans(40), spans(25)
    left = spark.createDataFrame(a, "k string, st long, en long, a int")
    right = spark.createDataFrame(b, "k string, st long, en long, b int")
    for width in (None, 13):
        got = {r.k: r.length for r in intervals.union_length(left, ["k"], width).collect()}
        assert got == {k: len(covered([(s, e) for q, s, e, _ in a if q == k])) for k in got}
    rest = intervals.subtract(left, right, ["k"]).collect()
    for k in "ab":
        want = covered([(s, e) for q, s, e, _ in a if q == k]) - covered([(s, e) for q, s, e, _ in b if q == k])
        assert covered([(r.st, r.en) for r in rest if r.k == k]) == want
    found = intervals.coverage(left, right, ["k"], ["a"], 20).collect()
    for r in found:
        hits = [(max(s, r.st), min(e, r.en)) for q, s, e, _ in b if q == r.k and s < r.en and r.st < e]
        assert (r.n_overlaps, r.covered) == (len(hits), len(covered(hits)))
    assert len(found) == 40
    assert {r.a for r in intervals.contained(left, right, ["k"], 8).collect()} == {i for k, s, e, i in a if any(q == k and t <= s and e <= u for q, t, u, _ in b)}


def test_dense_numbers_and_runs(spark):
    rows = [(rng.randrange(50), i) for i in range(300)]
    got = ordering.dense_numbers(spark.createDataFrame(rows, "x int, y int").repartition(7), ["x", "y"], "n").collect()
    assert [(r.x, r.y) for r in sorted(got, key=lambda r: r.n)] == sorted(rows) and sorted(r.n for r in got) == list(range(300))


def test_tags(spark):
    df = spark.createDataFrame([(["LN:i:5", "bad", "SN:Z:a:b", "LN:i:7"],), ([],)], "f array<string>").select(tags.parse(F.col("f")).alias("t"))
    rows = df.select(tags.render(F.col("t")).alias("r"), tags.get(F.col("t"), "SN").alias("s"), tags.render(tags.put(F.col("t"), "LN", "i", F.lit(9))).alias("p")).collect()
    assert rows[0].r == ["LN:i:7", "SN:Z:a:b"] and rows[0].s == "a:b" and rows[0].p == ["LN:i:9", "SN:Z:a:b"] and rows[1].r == [] and rows[1].p == ["LN:i:9"]


def test_cigar(spark):
    df = spark.createDataFrame([(list("==XIID="),), ([],)], "o array<string>").select(cigar.merge_runs(F.col("o")).alias("r"))
    rows = df.select(cigar.render(F.col("r")).alias("c"), cigar.summary(F.col("r")).alias("s")).collect()
    assert rows[0].c == "2=1X2I1D1=" and rows[0].s[:4] == (3, 7, 5, 6) and rows[0].s.gap_compressed == 3 / 6 and rows[1].c == ""


def test_sketch_and_hash(spark):
    seq = "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(400))
    for k, w in ((5, 4), (15, 10)):
        value, pos, strand = seeding.minimizers(seq.encode(), k, w)
        comp = str.maketrans("ACGT", "TGCA")
        every = []
        for i in range(len(seq) - k + 1):
            f = seq[i : i + k]
            r = f[::-1].translate(comp)
            if "N" not in f and f != r:
                code = lambda x: sum("ACGT".index(c) << 2 * (k - 1 - j) for j, c in enumerate(x))
                every.append((min(code(f), code(r)), i + k - 1, int(code(r) < code(f))))
        hashed = seeding._mix(np.array([e[0] for e in every], np.uint64), 2 * k).astype(np.int64).tolist()
        chosen = {j for a in range(len(every) - w + 1) for j in range(a, a + w) if hashed[j] == min(hashed[a : a + w])}
        assert list(zip(value.tolist(), pos.tolist(), strand.tolist())) == [(hashed[j], every[j][1], every[j][2]) for j in sorted(chosen)]
        keys = spark.createDataFrame([(e[0],) for e in every], "x long").select(nt.hash_bits(F.col("x"), 2 * k).alias("h"))
        assert [r.h for r in keys.collect()] == hashed
    short = seeding.minimizers(b"ACGTTGCA", 5, 10)
    assert len(short[0]) == 1


def test_chains_are_colinear():
    o = chaining.ChainOptions(max_dist=50, bandwidth=20, min_count=3, min_score=20)
    for _ in range(20):
        pts = sorted({(rng.randrange(200), rng.randrange(200)) for _ in range(60)} | {(10 * i, 10 * i + 3) for i in range(1, 8)})
        t, q, span = np.array([p[0] for p in pts]), np.array([p[1] for p in pts]), np.full(len(pts), 9)
        used = set()
        for score, at in chaining.chain(t, q, span, o):
            assert (np.diff(t[at]) > 0).all() and (np.diff(q[at]) > 0).all() and (np.diff(q[at]) <= 50).all()
            gap, skip = (np.float32(x * np.exp(-o.divergence * 9)) for x in (o.pen_gap, o.pen_skip))
            again = 9 + sum(int(chaining.pair_scores(np.array([q[b] - q[a]]), np.array([t[b] - t[a]]), 9, gap, skip)[0]) for a, b in zip(at, at[1:]))
            # a chain that would go on in a used anchor counts from there
            assert (score == again or used) and score >= 20 and not used & set(at.tolist())
            used |= set(at.tolist())


def test_mapping_finds_reads(spark):
    genome = "".join(rng.choice("ACGT") for _ in range(4000))
    comp = str.maketrans("ACGT", "TGCA")
    reads = [(1, "f", genome[500:1500]), (2, "r", genome[2000:2800][::-1].translate(comp)), (3, "none", "".join(rng.choice("ACGT") for _ in range(600)))]
    segs = spark.createDataFrame([(0, "s0", genome, len(genome))], "rid long, name string, seq string, len long")
    got = mapping.map_sequences(spark.createDataFrame(reads, "rid long, name string, seq string"), segs).collect()
    by = {r.qname: r for r in got}
    assert set(by) == {"f", "r"} and by["f"].path == ">s0" and by["r"].path == "<s0"
    assert abs(by["f"].forward_start - 500) < 30 and abs(by["r"].forward_start - 2000) < 30
    assert all(r.mapq > 20 and r.tags["tp"].value == "P" for r in got)
    lines = [r.value for r in alignments.gaf_lines(alignments.with_unmapped(spark.createDataFrame(got), spark.createDataFrame(reads, "rid long, name string, seq string").select(F.col("name").alias("qname"), F.length("seq").cast("long").alias("qlen")))).collect()]
    assert len(lines) == 3 and any(x.startswith("none\t600\t*") for x in lines)


def test_maximal_segments(spark):
    rows = [(k, i, rng.choice([-3, -2, -1, 1, 2, 3])) for k in range(3) for i in range(40)]
    got = ranking.maximal_segments(spark.createDataFrame(rows, "k int, i int, x int"), "k", "i", "x", 1).collect()
    for k in range(3):
        x = [v for q, _, v in sorted(rows) if q == k]

        def split(a, b):
            best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
            if best[0] <= 0:
                return []
            return [*split(a, best[2]), (best[2], best[3], best[0]), *split(best[3], b)]

        assert sum(s for _, _, s in split(0, 40)) == sum(r.score for r in got if r.k == k)
        assert max(s for _, _, s in split(0, 40)) == max(r.score for r in got if r.k == k)


def test_parents(spark):
    rows = [(q, r, (a := rng.randrange(100)), a + rng.randrange(5, 60), 100 - r, rng.randrange(1, 9)) for q in range(5) for r in range(12)]
    got = {(r.qid, r.rank): r for r in ranking.assign_parents(spark.createDataFrame(rows, "qid int, rank int, qs long, qe long, score long, cnt int"), 0.5).collect()}
    for q in range(5):
        chain = {r: (s, e) for k, r, s, e, _, _ in rows if k == q}
        primary = []
        for r in range(12):
            s, e = chain[r]
            free = (e - s) - len(set(range(s, e)) & {x for p in primary for x in range(*chain[p])})
            want = next((p for p in primary if (o := min(e, chain[p][1]) - max(s, chain[p][0])) > 0 and o / min(e - s, chain[p][1] - chain[p][0]) - free / max(e - s, chain[p][1] - chain[p][0]) > 0.5), r)
            assert got[q, r].parent == want
            if want == r:
                primary.append(r)


def test_fasta_and_alignment_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first read\nACGU\nac\n>two\nGG\n>three x\n\n")
    got = [(r.name, r.comment, r.seq) for r in fasta.read_fasta(spark, f"file://{tmp_path}/a.fa").collect()]
    assert got == [("one", "first read", "ACGTac"), ("two", None, "GG"), ("three", "x", "")]
    (tmp_path / "a.fq").write_text("@r/1 c\nACGT\n+\nIIII\n@r/2\nGG\n+\n##\n")
    rows = fasta.fragments(fasta.read_fastq(spark, f"file://{tmp_path}/a.fq"), ["file"], "ord").collect()
    assert [(r.name, r.seq, r.qual, r.fragment, r.fragment_ord) for r in sorted(rows, key=lambda r: r.ord)] == [("r/1", "ACGT", "IIII", 1, 0), ("r/2", "GG", "##", 1, 1)]
    (tmp_path / "a.gaf").write_text("q\t9\t0\t9\t+\t>s1<s2\t20\t3\t12\t9\t9\t60\ttp:A:P\n*\t>s1\t5\n")
    row = alignments.read_alignments(spark, f"file://{tmp_path}/a.gaf").select("qname", "mapq", alignments.path_steps(F.col("path")).alias("p"), tags.get(F.col("tags"), "tp").alias("tp")).collect()
    assert len(row) == 1 and [tuple(x) for x in row[0].p] == [(False, "s1"), (True, "s2")] and row[0].tp == "P"


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i % 3, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(3000)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, x int")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    want = Counter(tuple(r) for r in sessions.sessions(df, "user_id", "ts", "1 hour").collect())
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = sessions.sessions(stream, "user_id", "ts", "1 hour").writeStream.outputMode("complete").format("memory").queryName("got").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert Counter(tuple(r) for r in spark.table("got").collect()) == want


def test_intervals_of_all_lengths_and_hot_keys(spark):
    """One key, lengths from 0 to a million at a width of 4: a pair meets in few bins, islands run over many."""
    rows = lambda n: [("k", (s := rng.randrange(3000)), s + rng.choice([0, 1, 3, 4, 5, 40, 900]), i) for i in range(n)]
    a, b = [*rows(150), ("k", 5, 10**9, -1), ("j", 0, 1, 7)], [*rows(150), ("k", -4, 10**6, -2)]
    left, right = spark.createDataFrame(a, "k string, st long, en long, a int"), spark.createDataFrame(b, "k string, st long, en long, b int")
    found = intervals.overlap_join(left, right, ["k"], 4)
    assert Counter((r.a, r.b) for r in found.collect()) == Counter((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    inside = {x[3] for x in a if any(y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] for y in b)}
    assert sorted(r.a for r in intervals.contained(left, right, ["k"], 4).collect()) == sorted(inside)
    a += [(None, 3, 9, 900), (None, 8, 30, 901), (None, 40, 41, 902)]  # a null key is a key
    left = spark.createDataFrame(a, "k string, st long, en long, a int")
    short = [x for x in a if x[2] - x[1] < 50]
    some, holes = left.where("en - st < 50"), right.where("en - st < 50")
    for width in (None, 16):
        assert sorted((r.st, r.en, r.n) for r in intervals.union(some, ["k"], width).collect()) == sorted((r.st, r.en, r.n) for r in intervals.union(some, ["k"]).collect())
        rest = intervals.subtract(some, holes, ["k"], width).collect()
        assert sorted((r.st, r.en) for r in rest if r.k is None) == [(3, 30), (40, 41)]
        got = {x for r in rest if r.k == "k" for x in range(r.st, r.en)}
        assert got == covered([(x[1], x[2]) for x in short if x[0] == "k"]) - covered([(y[1], y[2]) for y in b if y[2] - y[1] < 50])


def test_islands_of_equal_intervals_in_sql():
    import duckdb

    from weftgraph.queries import ISLANDS

    db = duckdb.connect()
    db.execute("SET threads = 8")  # sorts of several threads may leave equal rows in another order each time
    db.execute("CREATE TABLE s AS SELECT i % 33333 AS k, (hash(i) % 3)::BIGINT * 10 AS st, (hash(i) % 3)::BIGINT * 10 + 5 AS en FROM range(200000) r(i)")
    got = db.execute(f"SELECT k, st, en, n FROM ({ISLANDS.format(key='k', rows='s')}) ORDER BY ALL").fetchall()
    assert got == db.execute("SELECT k, st, en, count(*) FROM s GROUP BY ALL ORDER BY ALL").fetchall()


def test_step_lookup_frames_start_at_the_first_row(spark):
    """A frame to the last row is read anew for each row, so that a bin would cost the square of its rows."""
    points = spark.range(40).selectExpr("'a' AS k", "id AS pos", "id")
    steps = spark.range(40).where("id % 9 = 4").selectExpr("'a' AS k", "id AS pos", "id * 2.0D AS value")
    found = intervals.step_lookup(points, steps, ["k"], "value", 10)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["id"]: r["value"] for r in found.collect()} == {i: None if i < 4 else 2.0 * min(i, 31) for i in range(40)}
