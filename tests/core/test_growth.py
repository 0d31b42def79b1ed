"""Insertions from alignments, calls of bubbles, growing graphs, and numbers over written ranges."""

import random
from collections import Counter

import pytest

from weftgraph.operators import calling, generation, graph, intervals, ordering, ranking
from weftgraph.operators.augment import augment
from weftgraph.operators.lineage import cut
from weftgraph.streaming import growth

rng = random.Random(12)


def bases(n):
    return "".join(rng.choice("ACGT") for _ in range(n))


S0, S1 = bases(200), bases(200)
INS = {"A": "CG", "C": "AG", "G": "AC", "T": "AC"}[S0[150]][0] + bases(58) + {"A": "C", "C": "A", "G": "A", "T": "A"}[S0[149]]


@pytest.fixture(scope="module")
def pair(spark):
    """Two segments in a row."""
    segs = spark.createDataFrame([(0, "a", S0, 200, "r", 0, 0, None), (1, "b", S1, 200, "r", 200, 0, None)], "seg long, name string, seq string, len long, sn string, so long, sr long, tags map<string,struct<type:string,value:string>>")
    arcs = spark.createDataFrame([(0, 2, 0, 0, 0, 1, False, None), (3, 1, 0, 0, 0, 1, True, None)], "v long, w long, ov long, ow long, rank long, link long, comp boolean, tags map<string,struct<type:string,value:string>>")
    return graph.SequenceGraph(segs, arcs)


def found(spark, pair, cases, n_cover=1):
    """The insertions of alignments along both segments: (query, runs) each."""
    size = {k: len(q) for k, (q, _) in enumerate(cases)}
    alns = spark.createDataFrame([(k, 7 + k, n, 0, 0) for k, n in size.items()], "aln long, qid long, qlen long, ps long, qs long")
    runs = spark.createDataFrame([(k, i, op, n) for k, (_, ops) in enumerate(cases) for i, (n, op) in enumerate(ops)], "aln long, k int, op string, len long")
    steps = spark.createDataFrame([(k, i, v, 200) for k in size for i, v in enumerate((0, 2))], "aln long, step int, v long, len long")
    queries = spark.createDataFrame([(7 + k, q) for k, (q, _) in enumerate(cases)], "qid long, seq string")
    on_segs = spark.createDataFrame([(s, 0, 200) for s in (0, 1) for _ in range(n_cover)], "seg long, st long, en long")
    on_q = spark.createDataFrame([(7 + k, 0, n) for k, n in size.items()], "qid long, st long, en long")
    out = generation.find_insertions(alns, runs, steps, graph.vertices(pair.segments), queries, pair.segments, pair.arcs, on_segs, on_q)
    return {r.aln: (r.v0, r.off0, r.v1, r.off1, r.seq) for r in out.collect()}


def test_insertions_from_alignments(spark, pair):
    query = S0[:150] + INS + S0[150:] + S1
    ops = [(150, "="), (60, "I"), (50, "="), (200, "=")]
    cases = [
        (query, ops),
        (query.replace(INS, INS[:30] + "N" + INS[31:]), ops),  # ambiguous
        (query, [(150, "="), (25, "I"), (5, "="), (30, "I"), (50, "="), (200, "=")]),  # a short match parts nothing
        (S0[:170] + S1[40:], [(170, "="), (70, "D"), (160, "=")]),  # 30 bases before and 40 behind the junction go
        (query[:150] + INS[:20] + query[210:], [(150, "="), (20, "I"), (250, "=")]),  # too short
    ]
    got = found(spark, pair, cases)
    assert got.pop(0) == (0, 150, 0, 150, INS) and got.pop(2)[:4] == (0, 150, 0, 155) and got.pop(3) == (0, 170, 2, 40, "") and not got
    assert found(spark, pair, cases[:1], n_cover=2) == {}  # another alignment covers the segments too
    rows = spark.createDataFrame([(0, 0, 150, 0, 150, INS)], "ins long, v0 long, off0 long, v1 long, off1 long, seq string")
    assert sorted(r.len for r in augment(pair, rows).segments.collect()) == [50, 60, 150, 200]


def test_matched_ends():
    for _ in range(300):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randrange(12))) for _ in range(2))
        pen = rng.choice([1, 2, 9])
        score = top = best = 0
        for k, (x, y) in enumerate(zip(a, b)):
            score += 1 if x == y else -pen
            if score > top:
                top, best = score, k + 1
            if score < top - pen * pen:
                break
        assert generation.matched_ends(a, b, pen) == best


def test_maximal_segments_with_a_drop():
    assert ranking.maximal([5, -20, 5], 1) == [(0, 1, 5), (2, 3, 5)]
    assert ranking.maximal([5, -4, 6], 1) == [(0, 3, 7)]
    assert ranking.maximal([5, -4, 6], 1, 3) == [(0, 1, 5), (2, 3, 6)]  # the sum fell by more than 3
    for _ in range(300):
        x = [rng.randrange(-4, 5) for _ in range(rng.randrange(9))]
        s = [0]
        for v in x:
            s.append(s[-1] + v)
        good = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if all(s[k] > s[i] for k in range(i + 1, j + 1)) and all(s[k] < s[j] for k in range(i, j))]
        want = [(i, j, s[j] - s[i]) for i, j in good if not any((a, b) != (i, j) and a <= i and j <= b for a, b in good)]
        assert sorted(ranking.maximal(x, 1)) == want


def test_calls_of_bubbles(spark):
    bubbles = spark.createDataFrame([(0, 0, 4), (1, 4, 8)], "bid long, source long, sink long")
    inside = spark.createDataFrame([(0, v) for v in (0, 2, 6, 4)] + [(1, v) for v in (4, 10, 8)], "bid long, v long")
    segs = spark.createDataFrame([(k, f"s{k}", 10) for k in range(6)], "seg long, name string, len long")
    schema = "qid long, chain int, step int, v long, y_first long, y_last long, span int"
    ahead = [(1, 0, k, v, 100 * k + 10, 100 * k + 50, 5) for k, v in enumerate((0, 6, 4, 8))]
    back = [(2, 0, k, v, 100 * k + 10, 100 * k + 50, 5) for k, v in enumerate((9, 11, 5, 3, 1))]

    def calls(rows, n=1):
        on_segs = spark.createDataFrame([(s, 0, 10) for s in range(6) for _ in range(n)], "seg long, st long, en long")
        on_q = spark.createDataFrame([(q, 0, 600) for q in (1, 2)], "qid long, st long, en long")
        return {(r.bid, r.qid, r.walk, r.wlen, r.strand, r.qs, r.qe) for r in calling.call_bubbles(spark.createDataFrame(rows, schema), bubbles, inside, segs, on_segs, on_q).collect()}

    assert calls(ahead) == {(0, 1, ">s3", 10, "+", 51, 206), (1, 1, "", 0, "+", 251, 306)}
    assert calls(back) == {(1, 2, ">s5", 10, "-", 51, 206), (0, 2, ">s1", 10, "-", 251, 406)}
    assert {r[:2] for r in calls(ahead + back)} == {(0, 2), (1, 2)}  # the last call wins
    assert calls(ahead, 2) == {(1, 1, "", 0, "+", 251, 306)}  # a walk that two chains cover is no ortholog


def test_growing_stream(spark, pair, tmp_path):
    path = f"file://{tmp_path}/graph"
    growth.write_graph(pair, path, 0)
    schema = "ins long, v0 long, off0 long, v1 long, off1 long, seq string"
    spark.createDataFrame([(0, 0, 100, 0, 100, "ACGT")], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    growth.grow_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), path, f"file://{tmp_path}/ck").awaitTermination()
    assert sorted(r.len for r in growth.read_graph(spark, path, 1).segments.collect()) == [4, 100, 100, 200]


@pytest.mark.parametrize("merge", ["true", "false"])
def test_numbers_of_wide_rows(spark, merge):
    """Numbers are gapless and no row is lost, however the planner deals the ranges."""
    n = 30_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
    rows = spark.range(n).selectExpr("hash(id) % 1000 AS k", "id", "repeat(string(id), 200) AS wide").repartition(6)
    got = cut(ordering.dense_numbers(rows, ["k"], "n")).selectExpr("count(*)", "count(DISTINCT id)", "count(DISTINCT n)", "min(n)", "max(n)").first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(got) == (n, n, n, 0, n - 1)


def test_running_totals(spark):
    rows = [(i, rng.choice("ab"), rng.randrange(5)) for i in range(200)]
    got = {r.i: (r.t, r["_runt"]) for r in ordering.running_total(spark.createDataFrame(rows, "i int, s string, x long").repartition(5), ["i"], "x", "t", also="s").collect()}
    total, head, last = 0, 0, None
    for i, s, x in rows:
        head = total if s != last else head
        assert got[i] == (total, head)
        total, last = total + x, s


def test_long_walks(spark):
    """Long chains of arcs are followed to their end, and cycles are told."""
    chain = spark.createDataFrame([(k, k + 1, 1) for k in range(40)] + [(k, k + 1, 3) for k in range(0, 40, 20)], "v long, w long, dist long")
    start = spark.createDataFrame([(0,)], "source long")
    assert {r.v: r.n for r in graph.count_paths(chain, start).collect()}[40] == 4
    best = graph.k_shortest(chain, spark.createDataFrame([(0, 40)], "source long, target long"), 2).collect()
    assert sorted((r.rank, r.dist) for r in best) == [(1, 40), (2, 42)]
    with pytest.raises(ValueError):
        graph.count_paths(spark.createDataFrame([(0, 1, 1), (1, 0, 1)], "v long, w long, dist long"), start)


def test_step_lookup_over_bins(spark):
    steps = [("a", p, float(p * p % 17)) for p in sorted(rng.sample(range(500), 30))]
    points = [("a", p) for p in range(0, 520, 3)] + [("b", 4)]
    want = {}
    for k, p in points:
        own = [(q, v) for s, q, v in steps if s == k]
        before, behind = [x for x in own if x[0] <= p], [x for x in own if x[0] > p]
        if not before:
            want[k, p] = None
        else:
            (q, v), nxt = before[-1], behind[:1]
            want[k, p] = v + ((nxt[0][1] - v) * (p - q) / (nxt[0][0] - q) if nxt else 0.0)
    for width in (1, 40, 10_000):
        got = intervals.step_lookup(spark.createDataFrame(points, "k string, pos long"), spark.createDataFrame(steps, "k string, pos long, value double"), ["k"], "value", width).collect()
        assert len(got) == len(points)
        assert Counter((r.k, r.pos) for r in got) == Counter(points)
        assert all(r.value == want[r.k, r.pos] or abs(r.value - want[r.k, r.pos]) < 1e-9 for r in got)
