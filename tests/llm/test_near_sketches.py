"""Nodes that share a bucket by chance make no group; large buckets go in blocks."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from weftgraph.llm import near_dedup
from weftgraph.llm.common import shared_dir


def strangers(many: int, common: int, own: int, seed: int = 3) -> list[tuple[int, str]]:
    """Documents of `common` words in one order, which all hold, and others of their own."""
    core = [f"c{k}" for k in range(common)]
    return [(i, " ".join([*core, *(f"d{seed}x{i}x{k}" for k in range(own))])) for i in range(many)]


def sets_of(rows) -> dict:
    return {i: {*zip(w, w[1:])} for i, t in rows if (w := t.split())}


def components(rows) -> dict:
    sets, label = sets_of(rows), {i: i for i, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def node_sets(spark) -> int:
    found = [p for p in Path(shared_dir(spark).removeprefix("file://")).iterdir() if p.name.startswith("node-sets-")]
    return spark.read.parquet(str(max(found, key=lambda p: p.stat().st_mtime))).count()


def test_strangers_make_no_group(spark):
    # a third of all shingles is common, so most share buckets
    rows = strangers(120, 60, 60)
    rows.append((500, rows[7][1] + " more"))
    found = near_dedup.label_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: r.component_id for r in found} == components(rows)
    assert node_sets(spark) == 2


@pytest.mark.parametrize("crowd, leaders", [(4096, 8), (8, 2), (5, 1)])
def test_buckets_in_blocks(spark, crowd, leaders):
    r = random.Random(5)
    rows = strangers(60, 60, 60)
    for i in range(100):  # chains of near copies of a few of them
        w = rows[r.choice([*range(6), *range(60, len(rows))])][1].split()
        for k in r.sample(range(len(w)), r.randrange(8)):
            w[k] = f"u{r.randrange(50)}"
        rows.append((1000 + i, " ".join(w)))
    found = near_dedup.label_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2, crowd=crowd, leaders=leaders).collect()
    assert Counter((x.doc_id, x.component_id) for x in found) == Counter(components(rows).items())


def test_spans_leave_no_near_pair_apart():
    r = np.random.default_rng(1)
    sketches = r.integers(0, 256, (6, 128), dtype=np.uint8)[r.integers(0, 6, 150)]
    sketches = np.where(r.random(sketches.shape) < r.random((150, 1)) * 0.4, r.integers(0, 256, sketches.shape, dtype=np.uint8), sketches)
    links, left, label = near_dedup._spans(sketches, 150, 40, 4)
    top = near_dedup._Union()
    for a, b in links:
        top.join(a, b)
    apart = np.count_nonzero(sketches[:, None] != sketches[None], axis=2)
    assert all(apart[a, b] <= 44 for a, b in links) and len(links) < 150
    assert all(top.find(a) == top.find(b) for a, b in np.argwhere(apart <= 40).tolist())
