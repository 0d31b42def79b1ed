"""A batch's texts are taken in runs of bounded size."""

import random

import pyarrow as pa

from weftgraph.llm import common


def test_text_parts():
    rng = random.Random(5)
    texts = [rng.choice([None, b"", b"x" * rng.randrange(400)]) for _ in range(500)]
    for column in (pa.array(texts, pa.binary()).cast(pa.string()), pa.array(texts, pa.binary()).cast(pa.large_string()), pa.array([b"q", *texts], pa.binary()).cast(pa.string()).slice(1)):
        for most in (1, 300, 5000, 1 << 20):
            parts = list(common.text_parts(column, most))
            assert [p for p, _ in parts] == common.chunks(texts, most)
            assert [t for _, part in parts for t in part] == texts
    assert list(common.text_parts(pa.array([], pa.string()), 10)) == []
