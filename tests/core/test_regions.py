"""Insertions from anchors alone, arcs to a complement, and streams that are written in order, against plain Python."""

import random

from pyspark.sql import functions as F

from weftgraph.operators import generation, graph, ranking, seeding
from weftgraph.sources import alignments
from weftgraph.streaming import sessions

rng = random.Random(47)
ANCHORS = "aln long, k long, step long, x long, y long, span long, mini long"


def test_gap_scores(spark):
    steps, anchors = [], []
    for aln in range(6):
        sizes = [rng.randrange(60, 90) for _ in range(6)]
        steps += [(aln, s, 2 * s, n) for s, n in enumerate(sizes)]
        k, y, mini = 0, 20, 0
        for s, n in enumerate(sizes):
            if s in (2, 4) and rng.random() < 0.5:
                continue  # a vertex without anchors
            x = 10
            while x < n:
                anchors.append((aln, k, s, x, y, 9, mini))
                move = rng.choice([4, 4, 4, 9])
                k, x, y, mini = k + 1, x + move, y + (move if rng.random() < 0.6 else rng.choice([-2, 3, 30])), mini + rng.choice([1, 1, 3])
    o = generation.GenerationOptions(end_anchors=2, end_share=0.0)
    scored = generation.gap_scores(spark.createDataFrame(anchors, ANCHORS), spark.createDataFrame(steps, "aln long, step long, v long, len long"), 0.2, o)
    got = {(r.aln, r.k): (r.pd, r.gap) for r in scored.collect()}
    regions = {(r.aln, r.region): (r.c0, r.c1, r.pd, r.step0, r.step1, r.off0, r.off1) for r in generation.anchor_candidates(scored, spark.createDataFrame(steps, "aln long, step long, v long, len long"), o).collect()}
    want = {}
    for aln in range(6):
        mine = sorted(a[1:] for a in anchors if a[0] == aln)
        before, at = {}, 0
        for _, s, _, n in (x for x in steps if x[0] == aln):
            before[s] = at
            at += n
        far, gaps = 0, []
        for (k, s, x, y, _, m), (_, s2, x2, y2, _, m2) in zip(mine, mine[1:]):
            far = max(far, y)
            pd, qd, c = before[s2] + x2 - before[s] - x, y2 - y, m2 - m - 1
            if y2 < far:
                gap = 1
            elif pd == qd and c == 0:
                gap = -10
            elif pd > qd:
                gap = int(max(qd * 0.2, c) + (pd - qd) * 0.2 + 0.499)
            else:
                gap = max(int(qd * 0.2 + 0.499), c)
            assert got[aln, k] == (pd, gap)
            gaps.append((pd, gap))
        assert got[aln, mine[-1][0]] == (None, None)
        for st, en, score in ranking.maximal([g for _, g in gaps], 10):
            (_, s, x, y, span, _), (_, s2, x2, y2, _, _) = mine[st], mine[en]
            if 2 < st and en < len(mine) - 3 and y + 1 - span <= y2 + 1:
                want[aln, st] = (y + 1 - span, y2 + 1, span + sum(p for p, _ in gaps[st:en]), s, s2, x + 1 - span, x2 + 1)
    assert regions == want and want


def test_an_insertion_without_base_alignment(spark):
    ref = "".join(rng.choice("ACGT") for _ in range(3000))
    new = "".join(rng.choice("ACGT") for _ in range(200))
    query = ref[:1500] + new + ref[1500:]
    t = {h: p for h, p, _ in zip(*(x.tolist() for x in seeding.minimizers(ref.encode(), 13, 5)))}
    q = list(zip(*(x.tolist() for x in seeding.minimizers(query.encode(), 13, 5))))
    rows = [(0, i, 0, t[h], p, 13, m) for i, (m, (h, p)) in enumerate((m, (h, p)) for m, (h, p, _) in enumerate(q) if h in t and t[h] in (p, p - 200))]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    segments = frame([(0, "s", ref, 3000)], "seg long, name string, seq string, len long")
    found = generation.find_insertions_by_anchors(
        frame([(0, 0, 3200, 0, 0)], "aln long, qid long, qlen long, ps long, qs long"), frame(rows, ANCHORS), frame([(0, 0, 0, 3000)], "aln long, step long, v long, len long"), graph.vertices(segments), frame([(0, query)], "qid long, seq string"),
        segments, frame([], "v long, w long, link long"), frame([(0, 0, 3000)], "seg long, st long, en long"), frame([(0, 0, 3200)], "qid long, st long, en long"), len(rows) / 3000,
    ).collect()
    assert len(found) == 1
    r = found[0]
    assert len(r.seq) == r.c1 - r.c0 and query[r.c0 : r.c1] == r.seq and len(r.seq) - (r.off1 - r.off0) == 200
    assert ref[: r.off0] + r.seq + ref[r.off1 :] == query


def test_repeat_tables(spark, tmp_path):
    (tmp_path / "r.out").write_text("   SW  perc perc\nscore  div. del.\n\n  463   1.3  0.6  1.7  chr1  10001 10468 (100) +  (TTAGGG)n  Simple_repeat  1 471 (0) 1\n 3612 11.4 27.0  1.3  chr1  10469 11447 (90) C  TAR1  Satellite/telo  (399) 1712 483 2 *\nnot a row\n")
    rows = [tuple(r) for r in alignments.read_repeats(spark, f"file://{tmp_path}/r.out").sort("st").collect()]
    assert rows == [("chr1", 10000, 10468, 1.3, "(TTAGGG)n", "Simple_repeat"), ("chr1", 10468, 11447, 11.4, "TAR1", "Satellite/telo")]


def test_arcs_to_a_complement_stay(spark):
    rows = [(0, 1, 0, 1), (0, 1, 1, 2), (0, 2, 1, 3), (0, 2, 0, 4), (3, 1, 1, 3), (3, 1, 0, 4)]
    found = graph.single_edges(spark.createDataFrame(rows, "v long, w long, rank int, link long"))
    assert sorted((r.v, r.w, r.link) for r in found.collect()) == [(0, 1, 1), (0, 1, 2), (0, 2, 4), (3, 1, 4)]


def test_stream_is_written_in_order(spark, tmp_path):
    """Records come late and twice, over several batches; each source is written in order, once."""
    numbers = [(s, n) for s in "ab" for n in range(12)]
    rng.shuffle(numbers)
    numbers += numbers[:6]
    schema = "source string, number long, text string"
    for part in range(3):
        spark.createDataFrame([(s, n, f"{s}{n}") for s, n in numbers[part * 10 : part * 10 + 10]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        sessions.write_in_order(stream, "source", "number", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").select("batch", "source", "number", "text", "written").collect()
    for s in "ab":
        mine = sorted((r.batch, r.written, r.number, r.text) for r in rows if r.source == s)
        assert [x[2] for x in mine] == list(range(12)) and all(x[1] == x[2] and x[3] == f"{s}{x[2]}" for x in mine)
    assert len({r.batch for r in rows}) > 1
