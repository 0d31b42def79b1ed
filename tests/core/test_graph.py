"""Graph operators, sources and bubbles on small graphs with known answers."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import augment, bubbles, coverage, graph
from weftgraph.operators.lineage import cut
from weftgraph.sources import gfa

A, B, C, D, X, Y = "ACGTACGTAC", "GGGCC", "TTTTACGTAA", "CATG", "GATTACA", "CC"
GFA = "\n".join([
    f"S\ta\t{A}\tSN:Z:r\tSO:i:0\tSR:i:0", f"S\tb\t{B}\tSN:Z:r\tSO:i:10\tSR:i:0", f"S\tc\t{C.lower()}\tSN:Z:r\tSO:i:15\tSR:i:0\tKC:i:7", f"S\td\t{D}\tSN:Z:r\tSO:i:25\tSR:i:0",
    f"S\tx\t{X}\tSN:Z:o\tSO:i:3\tSR:i:1", f"S\ty\t{Y}\tSN:Z:o\tSO:i:40\tSR:i:1", "H\tVN:Z:1.0", "#", "x", "L\ta\t+\tb\t+\t0M\tSR:i:0", "L\tb\t+\tc\t+\t0M", "L\tc\t+\td\t+\t0M", "L\ta\t+\tx\t-\t0M", "L\tx\t-\tc\t+\t0M", "L\tc\t+\ty\t+\t0M", "L\ty\t+\td\t+\t0M", "L\ta\t+\tgone\t+\t0M",
])


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("gfa") / "g.gfa"
    path.write_text(GFA + "\n")
    g = graph.normalize(gfa.read_gfa(spark, f"file://{path}"))
    return graph.SequenceGraph(cut(g.segments), cut(g.arcs))


@pytest.fixture(scope="module")
def found(small):
    return cut(bubbles.bubbles(small.segments.where("len > 0"), small.arcs))


def test_read_and_close(small):
    s = {r.name: r for r in small.segments.collect()}
    assert [s[k].seg for k in "abcdxy"] == list(range(6)) and s["gone"].len == 0
    assert s["c"].seq == C and s["c"].tags["KC"].value == "7" and s["x"].sr == 1
    arcs = small.arcs.collect()
    assert len(arcs) == 14 and sum(r.comp for r in arcs) == 7
    pairs = {(r.v, r.w) for r in arcs}
    assert all((w ^ 1, v ^ 1) in pairs for v, w in pairs) and (0, 9) in pairs
    assert all(n == 2 for n in Counter(r.link for r in arcs).values())


def test_round_trip(spark, small, tmp_path):
    gfa.write_gfa(graph.SequenceGraph(small.segments.where("len > 0"), small.arcs), f"file://{tmp_path}/out")
    again = graph.normalize(gfa.read_gfa(spark, f"file://{tmp_path}/out"))
    names = lambda g: {(r.name, r.seq, r.sn, r.so, r.sr) for r in g.segments.where("len > 0").collect()}
    assert names(again) == names(small)

    def ends(g):
        name = {r.seg: r.name for r in g.segments.collect()}
        return {(name[r.v >> 1], r.v & 1, name[r.w >> 1], r.w & 1) for r in g.arcs.collect()}

    assert ends(again) == ends(small)


def test_overlaps(spark):
    rows = spark.createDataFrame([("*",), ("3M",), ("2M1I1D",), ("4:5",), (None,)], "o string").select(gfa.overlap(F.col("o")).alias("x"))
    assert [tuple(r.x) for r in rows.collect()] == [(None, None), (3, 3), (3, 3), (4, 5), (0, 0)]
    arcs = spark.createDataFrame([(0, 2, None, None, 0, 1, False), (3, 1, 5, 4, 0, 2, False), (4, 6, None, None, 0, 3, False)], "v long, w long, ov long, ow long, rank long, link long, comp boolean")
    assert {(r.v, r.w, r.ov, r.ow) for r in graph.infer_overlaps(arcs).collect()} == {(0, 2, 4, 5), (3, 1, 5, 4)}


def test_bubbles(found):
    found = {(r.sn, r.ss, r.se): r for r in found.collect()}
    assert set(found) == {("r", 10, 15), ("r", 25, 25)}
    one, two = found["r", 10, 15], found["r", 25, 25]
    assert (one.source, one.sink, one.n_seg, one.n_paths, one.len_min, one.len_max) == (0, 4, 4, 2, 5, 7)
    assert (two.source, two.sink, two.n_seg, two.n_paths, two.len_min, two.len_max) == (4, 6, 3, 2, 0, 2)


def test_long_bubbles(spark):
    """A detour of twelve segments over ten of the line, and one with a cycle: its paths have no number."""
    line = [(k, 2, "r", 2 * k, 0) for k in range(15)]
    off = [(k, 1, None, None, 1) for k in range(20, 34)]
    ways = [*range(15)], [0, *range(20, 32), 11], [12, 32, 33, 14], [33, 32]
    segments = spark.createDataFrame(line + off, "seg long, len long, sn string, so long, sr long")
    arcs = spark.createDataFrame([(2 * a, 2 * b) for w in ways for a, b in zip(w, w[1:])], "v long, w long")
    got = {(r.source, r.sink, r.n_seg, r.n_paths, r.len_min, r.len_max) for r in bubbles.bubbles(segments, arcs).collect()}
    assert got == {(0, 22, 24, 2, 12, 20), (24, 28, 5, None, None, None)}


def test_walks_through_bubbles(spark, small, found):
    steps = spark.createDataFrame([("p", i, v) for i, v in enumerate([0, 9, 4, 10, 6])] + [("q", i, v) for i, v in enumerate([0, 2, 4, 6])], "walk string, ord int, v long")
    got = {(r.walk, r.source): r.path for r in bubbles.attach_walks(steps, found).collect()}
    assert got == {("p", 0): "<4", ("p", 4): ">5", ("q", 0): ">1", ("q", 4): ""}
    use = {(r.v, r.w): r.n for r in coverage.link_counts(steps, ["walk"], small.arcs).collect()}
    assert use[0, 9] == use[8, 1] == 1 and use[0, 2] == 1 and use[2, 4] == 1


def test_sequences(spark, small):
    v = {r.v: r.seq for r in graph.vertices(small.segments).collect()}
    assert v[0] == A and v[9] == X[::-1].translate(str.maketrans("ACGT", "TGCA"))
    steps = spark.createDataFrame([("p", 0, 0, 8, 10), ("p", 1, 9, 0, 7), ("p", 2, 4, 0, 3)], "path string, ord int, v long, st long, en long")
    assert graph.spell(steps, graph.vertices(small.segments)).first().seq == A[8:] + v[9] + C[:3]


def test_augment(spark, small):
    ins = spark.createDataFrame([(0, 0, 4, 0, 6, "TTT"), (1, 5, 2, 5, 5, "")], "ins int, v0 long, off0 long, v1 long, off1 long, seq string")
    base = graph.SequenceGraph(small.segments.where("len > 0"), small.arcs)
    grown = augment.augment(base, ins)
    s = {r.seg: r for r in grown.segments.collect()}
    arcs = {(r.v, r.w) for r in grown.arcs.collect()}
    assert all((w ^ 1, v ^ 1) in arcs for v, w in arcs)
    by_seq = {r.seq: r.seg for r in s.values()}
    assert {A[:4], A[4:6], A[6:], "TTT", C[:5], C[5:8], C[8:]} <= set(by_seq)
    assert (by_seq[A[:4]] * 2, by_seq["TTT"] * 2) in arcs and (by_seq["TTT"] * 2, by_seq[A[6:]] * 2) in arcs
    # the deletion runs backward through c: after two bases of its reverse strand, back in at the fifth
    assert (by_seq[C[8:]] * 2 + 1, by_seq[C[:5]] * 2 + 1) in arcs

    def spell(path):
        return "".join(s[v >> 1].seq for v in path)

    at, line = by_seq[A[:4]] * 2, [by_seq[A[:4]] * 2]
    for part in (A[4:6], A[6:], B, C[:5], C[5:8], C[8:], D):
        assert (at, by_seq[part] * 2) in arcs
        at = by_seq[part] * 2
        line.append(at)
    assert spell(line) == A + B + C + D and s[by_seq["TTT"]].sr == 2


def test_reference_arc_first(small):
    rows = {(r.v, r.ord): r.w for r in graph.successors(small.arcs, small.segments.where("len > 0")).collect()}
    assert rows[0, 0] == 2 and rows[0, 1] == 9 and rows[4, 0] == 6
