"""Segmentations leave a task in runs of text, not in whole batches."""

import pyarrow as pa

from weftgraph.llm import piece_lattice
from weftgraph.llm.queries import tokenizer_path


def test_batches_are_sent_in_runs(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(piece_lattice, "in_arrow", lambda df, run, schema: taken.append(run))
    monkeypatch.setattr(piece_lattice, "RUN", 200)
    docs = spark.createDataFrame([], "doc_id long, text string")
    piece_lattice.segmentations(docs, tokenizer_path("piece_bpe_32k.model"), 2, with_ids=True)
    texts = [None, "", *(f"one two three {k} four five Größe" for k in range(30)), "x" * 500]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["c0", "c1"])
    found = list(taken[0](iter([batch])))
    assert len(found) > 4 and max(b.num_rows for b in found) < 12
    whole = pa.Table.from_batches(found).to_pydict()
    assert whole["doc_id"] == list(range(len(texts))) and whole["text"] == [x or "" for x in texts] and all(whole["decoded_equal"])
