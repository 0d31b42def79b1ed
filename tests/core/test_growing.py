"""Growing a graph by samples and calling them in its bubbles, from sequences on."""

import random
import zlib

import pytest

from weftgraph import graph_queries
from weftgraph.operators import graph
from weftgraph.plans import growing
from weftgraph.streaming import growth

rng = random.Random(31)
COMP = str.maketrans("ACGT", "TGCA")
O = growing.GrowOptions(least_block=3000, least_depth=3000)


def dna(n):
    return "".join(rng.choice("ACGT") for _ in range(n))


LINE, ADDED, CHANGED = dna(12_000), dna(320), dna(200)
# 320 bases more at 3,000; 150 fewer at 6,000; 200 others at 9,000
SAMPLE = LINE[:3000] + ADDED + LINE[3000:6000] + LINE[6150:9000] + CHANGED + LINE[9200:]
TAGS = "map<string,struct<type:string,value:string>>"


@pytest.fixture(scope="module")
def line(spark):
    segs = spark.createDataFrame([(0, "a", LINE, 12_000, "r", 0, 0, None)], f"seg long, name string, seq string, len long, sn string, so long, sr long, tags {TAGS}")
    arcs = spark.createDataFrame([], f"v long, w long, ov long, ow long, rank long, link long, comp boolean, tags {TAGS}")
    return graph.SequenceGraph(segs, arcs)


def sample(spark, *seqs):
    return spark.createDataFrame([(k, f"q{k}", s) for k, s in enumerate(seqs)], "rid long, name string, seq string")


def written(g, path):
    """The graph over files, so that later plans are short."""
    growth.write_graph(g, path, 0)
    return growth.read_graph(g.segments.sparkSession, path, 0)


def test_growth_and_calls(spark, line, tmp_path):
    g = written(growing.grow(line, sample(spark, SAMPLE, dna(5000)), O), f"file://{tmp_path}/one")
    segs = {r.seg: r for r in g.segments.collect()}
    new = sorted((r.sn, r.len) for r in segs.values() if r.sr == 1)
    assert [n for n, _ in new] == ["q0", "q0"] and abs(new[0][1] - 200) <= 6 and new[1][1] == 320
    calls = sorted(growing.call_sample(sample(spark, SAMPLE), g, O).collect(), key=lambda r: r.bid)
    assert [(r.qname, r.strand) for r in calls] == [("q0", "+")] * 3
    assert [r.walk == "" for r in calls] == [False, True, False] and calls[0].wlen == 320
    # the line with each bubble's call in place of what stands there is the sample
    by_name, spelled, at = {r["name"]: r.seq for r in segs.values()}, "", 0
    for r in calls:
        assert all(s == ">" for s in r.walk if s in "<>")
        spelled += LINE[at : r.ss] + "".join(by_name[n] for n in r.walk.split(">")[1:])
        at = r.se
    assert spelled + LINE[at:] == SAMPLE
    # what is in the graph isn't added again, from the other strand either
    turned = sample(spark, SAMPLE[::-1].translate(COMP))
    assert growing.sample_insertions(turned, g, O).count() == 0
    back = growing.call_sample(turned, g, O).collect()
    assert {(r.bid, r.walk, r.strand) for r in back} == {(r.bid, r.walk, "-") for r in calls}


def test_samples_without_rows(spark, line):
    none = spark.createDataFrame([], "rid long, name string, seq string")
    assert growing.sample_insertions(none, line, O).count() == 0
    twice = sample(spark, SAMPLE, SAMPLE)  # covered by two, so neither is taken
    assert growing.sample_insertions(twice, line, O).count() == 0


def test_samples_as_a_stream(spark, line, tmp_path):
    """A sample a batch; each is mapped to the graph of those before."""
    path, schema = f"file://{tmp_path}/graph", "rid long, name string, seq string"
    growth.write_graph(line, path, 0)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for k in range(2):  # the same sample twice: the second adds nothing
        sample(spark, SAMPLE).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    growth.grow_from_sequences(source, path, f"file://{tmp_path}/ck", O).awaitTermination()
    sizes = [sorted(r.len for r in growth.read_graph(spark, path, k).segments.collect()) for k in (1, 2)]
    assert len(sizes[0]) > 3 and sizes[0] == sizes[1]


def test_grown_documents(spark, tmp_path):
    """The query on documents of its own: unlike long ones get their middle back; short ones, copies and nulls nothing."""
    texts = [dna(n) for n in (3400, 4001, 5200)] + [dna(2000), "", None]
    texts += [dna(3600)] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = graph_queries.grown_documents(spark, str(tmp_path)).collect()
    assert sorted(r.sn for r in rows) == ["d0", "d1", "d2"]
    bases = {c: "ACGT"[ord(c) % 4] for c in "ACGT"}
    for r in rows:
        whole = "".join(bases[c] for c in texts[int(r.sn[1:])])
        at = len(whole) // 2 - 150
        lacking, part = whole[:at] + whole[at + 300 :], whole[r.so : r.so + r.len]
        assert lacking[: r.so] + part + lacking[r.so :] == whole and zlib.crc32(part.encode()) == r.crc32
