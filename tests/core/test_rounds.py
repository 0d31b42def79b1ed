"""What rounds and scans hold: only what is still open, each table once."""

from pyspark.sql import functions as F

from weftgraph.operators import gene_copies, graph_chains


def _counted(monkeypatch, module):
    """The row counts of all tables that a module cuts."""
    seen, cut = [], module.cut

    def counting(df):
        found = cut(df)
        seen.append(found.count())
        return found

    monkeypatch.setattr(module, "cut", counting)
    return seen


def test_chains_without_links_stay_out_of_rounds(spark, monkeypatch):
    # 200 queries of one chain each, and one query whose three chains follow each other
    rows = [(q, 0, 0, 0, 10, 0, 10, 7, 10) for q in range(200)] + [(900, k, 2 * k, 12 * k, 12 * k + 10, 0, 10, 7, 10) for k in range(3)]
    chains = spark.createDataFrame(rows, "qid long, chain long, v long, qs long, qe long, rs long, re long, score long, len long")
    arcs = spark.createDataFrame([(0, 2), (2, 4)], "v long, w long")
    lengths = spark.createDataFrame([(0, 10), (1, 10), (2, 10)], "seg long, len long")
    found = graph_chains.links(chains, arcs, lengths, graph_chains.GraphChainOptions(max_gap=40, bandwidth=40, walks=3))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # rounds read links, they don't make them again
    seen = _counted(monkeypatch, graph_chains)
    best = {(r.qid, r.chain): (r.f, r.prev) for r in graph_chains.best_scores(chains, found).collect()}
    assert len(best) == 203 and max(seen) == 3
    assert best[5, 0] == (7, None) and best[900, 0] == (7, None) and best[900, 1][1] == 0 and best[900, 2][1] == 1


def test_decided_hits_stay_out_of_rounds(spark, monkeypatch):
    # 200 hits alone, and six that overlap their neighbours, of falling scores: each but the first waits for one
    rows = [(k, "g", 50, str(k), 0, 10) for k in range(200)] + [(900 + k, "h", 50 - k, "x", 6 * k, 6 * k + 10) for k in range(6)]
    frame = spark.createDataFrame(rows, "hit long, gene string, score long, ctg string, st long, en long")
    seen = _counted(monkeypatch, gene_copies)
    parts = frame.select("hit", F.lit(0).alias("part"), "ctg", F.lit(1).alias("strand"), "st", "en")
    found = {r.hit: (r.length, r.claimed, r.good) for r in gene_copies.claim(frame.select("hit", "gene", "score"), parts, width=16).collect()}
    assert len(found) == 206 and all(found[k] == (10, 0, True) for k in range(200))
    assert [found[900 + k] for k in range(6)] == [(10, 0, True)] + [(10, 4, True)] * 5
    assert max(seen) <= 6
