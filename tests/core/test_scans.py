"""Queries of large tables go over each of them once, not once for each use of a column."""

import re

from pyspark.sql import functions as F

from weftgraph.functions import tags
from weftgraph.operators import coverage
from weftgraph.sources import gfa, stable


def _count(df, pattern: str, physical: bool = False) -> int:
    plan = df._jdf.queryExecution()
    return len(re.findall(pattern, (plan.executedPlan() if physical else plan.optimizedPlan()).toString()))


def test_tags_are_matched_once(spark):
    rows = [(0, ["XX:i:1", "no", "YY:Z:a:b", "XX:i:2"]), (1, []), (2, None), (3, ["AB:f:0.5", "1A:i:3"])]
    df = spark.createDataFrame(rows, "k int, p array<string>").select("k", tags.parse(F.col("p")).alias("t"))
    found = {r.k: r.t and {k: (v.type, v.value) for k, v in r.t.items()} for r in df.collect()}
    assert found == {0: {"XX": ("i", "2"), "YY": ("Z", "a:b")}, 1: {}, 2: None, 3: {"AB": ("f", "0.5")}}
    assert len(re.findall(r"(?i)rlike", df._jdf.queryExecution().analyzed().toString())) == 1


def test_lengths_of_links_need_no_arcs(spark):
    lines = ["S\ta\tACGT", "S\tb\t*\tLN:i:3", "L\ta\t+\tb\t-\t2M\tL1:i:1\tL2:i:9", "L\tb\t+\tc\t+\t*\tL2:i:5", "L\tc\t+\ta\t+\t0M\tSR:i:1\tL1:i:6"]
    text = spark.createDataFrame(list(enumerate(lines)), "n long, value string")
    g = gfa.parse_gfa(text.select(F.struct("n").alias("line"), F.split("value", "\t").alias("f")))
    assert {r.name: r.len for r in g.segments.collect()} == {"a": 4, "b": 11, "c": 6}
    assert all(not ({"L1", "L2"} & set(r.tags)) for r in g.arcs.collect())
    assert _count(g.segments, r"Join \w+") <= 3  # numbers of ranges, first lines, lengths of links


def test_failing_alignments_are_told_by_a_column(spark):
    segs = spark.createDataFrame([("a", 10, "r", 0, 0), ("b", 10, "r", 10, 0), ("c", 10, "q", 0, 1)], "name string, len long, sn string, so long, sr long")
    rows = [(1, "+", ">a>b", 20, 2, 19), (2, "+", ">a>z", 20, 2, 19), (3, "+", ">a>b", 21, 2, 19), (4, "+", ">a>c", 20, 2, 19), (5, "+", "<b<a", 20, 2, 19), (6, "+", ">a", None, 2, 9)]
    alns = spark.createDataFrame(rows, "aln long, strand string, path string, plen long, ps long, pe long")
    good, failed = stable.to_stable(alns, segs, "aln")
    assert {r.aln: (r.strand, r.path, r.plen) for r in good.collect()} == {1: ("+", "r", 20), 4: ("+", ">r:0-10>q:0-10", 20), 5: ("-", "r", 20), 6: ("+", "r", 20)}
    assert sorted(r.aln for r in failed.collect()) == [2, 3]
    assert _count(good, "LogicalRDD") == 4  # alignments for their steps and for themselves, segments for these and for sizes


def test_steps_are_sorted_once(spark):
    rows = [(0, 1, 7, 2), (0, 1, 8, 4), (0, 2, 0, 7), (0, 3, 0, 6), (1, 0, 0, 5), (1, 1, 0, 3), (1, 2, 0, 2)]
    steps = spark.createDataFrame(rows, "walk long, x long, y long, v long")
    arcs = spark.createDataFrame([(2, 4), (5, 3), (4, 7), (7, 6), (8, 9)], "v long, w long")
    taken = coverage.traversals(steps, ["walk"], ["x", "y"])
    assert _count(taken, r"\bSort \[", physical=True) == 1
    assert sorted(map(tuple, taken.collect())) == [(0, 2, 4), (0, 4, 7), (0, 7, 6), (1, 3, 2), (1, 5, 3)]
    counts = coverage.link_counts(steps, ["walk"], arcs, ["x", "y"])
    # 5 to 3 is 2 to 4 on the other strand; 7 to 6 is its own dual
    assert {(r.v, r.w): r.n for r in counts.collect()} == {(2, 4): 2, (5, 3): 2, (4, 7): 1, (7, 6): 2, (8, 9): 0}
    assert _count(counts, r"\bWindow \[") == 1
