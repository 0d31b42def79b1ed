"""Hard negatives, near-duplicate vectors and collocations against brute force, with nulls, ties, repeated rows,
vectors of several lengths, empty tables and extra columns of clashing names."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import queries
from weftgraph.llm.embedding_dedup import embedding_duplicates
from weftgraph.llm.hard_negatives import hard_negatives, products
from weftgraph.llm.phrases import MinimalHash, collocations

VECTORS = "vec_id long, embedding array<double>, label int, node int, rank int, `a.b` int"


def floats(values):
    return [float(np.float32(x)) for x in values]


def odd_vectors():
    """Rows that take no part, short ones, repeated ids and repeated rows."""
    nan, inf = float("nan"), float("inf")
    return [(3000, None, 1), (3010, [None, 1.0], 1), (3020, [inf] * 8, 1), (3021, [nan] * 8, 1), (3030, [], 2), (3040, [1.0, 2.0], 2), (None, [1.0] * 8, 1), (3060, [1.0] * 8, None), (10, [1.0] * 8, 1), (10, [1.0] * 8, 1), (3080, [0.0] * 8, 0)]


def finite(e):
    return e is not None and all(x is not None and np.isfinite(x) for x in e)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(2)
    bases = r.normal(size=(6, 8))
    rows = [(i, floats(bases[r.integers(6)] + r.normal(size=8) * 0.3), int(r.integers(3))) for i in range(400)]
    rows += [(2000 + i, [1.0] * 8, i % 4) for i in range(60)]  # equal vectors of several labels
    return rows + odd_vectors()


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS)


def brute_negatives(rows, every, scale=256):
    rows = [(v, np.floor(np.array(e, float) * scale), k) for v, e, k in rows if v is not None and k is not None and finite(e)]
    rows = [(v, x.astype(np.int64), k) for v, x, k in rows if float(x @ x) < 2.0**62]
    size = max(len(x) for _, x, _ in rows)
    ids, labels = np.array([v for v, _, _ in rows]), np.array([k for _, _, k in rows])
    x, out = np.stack([np.pad(x, (0, size - len(x))) for _, x, _ in rows]), []
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        order = np.lexsort((ids, -score))
        for p in [j for j in order if labels[j] == labels[i] and ids[j] != ids[i]][:5]:
            found = [j for j in order if labels[j] != labels[i] and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            out += [tuple(map(int, (ids[i], ids[p], r + 1, ids[j], score[p], score[j]))) for r, j in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"block_rows": 20, "group_rows": 7, "first_rows": 30, "growth": 3, "pivots": 9}])
def test_hard_negatives(spark, vectors, how):
    rows = vectors + [(3050, [1e300] * 8, 1), (3070, [2e6] * 8, 1)]  # too long; long, but its products are exact
    found = hard_negatives(frame(spark, rows).repartition(5), F.col("vec_id") % 10 == 0, **how)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, 10)


def test_hard_negatives_of_nothing(spark, vectors):
    some = frame(spark, vectors)
    assert hard_negatives(some.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives(some.where("vec_id % 10 = 3"), F.col("vec_id") % 10 == 0).collect() == []  # no anchor
    assert hard_negatives(some.where("size(embedding) = 0"), F.lit(True)).collect() == []  # no component


def test_products_beyond_doubles():
    a, b = np.array([[2**30, 1], [-(2**30), 7]], np.int32), np.array([[2**30, 3]], np.int32)
    assert products(a, b).tolist() == [[2**60 + 3], [-(2**60) + 21]]


def brute_links(rows, least):
    near = defaultdict(list)
    for i, (v, e, k) in enumerate(rows):
        if v is not None and k is not None and finite(e) and any(e):
            near[k, len(e)].append(i)
    n, top = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for mine in near.values():
        x = np.array([rows[i][1] for i in mine], float)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        hit = x @ x.T >= least
        for a, i in enumerate(mine):
            n[i] = int(hit[a].sum()) - 1
            for b in np.flatnonzero(hit[a]):
                p, q = find(i), find(mine[b])
                top[max(p, q)] = min(p, q)
    linked = {i for mine in near.values() for i in mine}
    least_id = {}
    for i in linked:
        least_id[find(i)] = min(least_id.get(find(i), rows[i][0]), rows[i][0])
    return [(v, n[i], least_id[find(i)] if i in linked else v) for i, (v, _, _) in enumerate(rows)]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0))


@pytest.mark.parametrize("how", [{}, {"block": 16}])
def test_embedding_duplicates(spark, how):
    r = np.random.default_rng(1)
    rows = []
    for i in range(90):
        base = r.normal(size=16)
        rows += [(len(rows) * 7 % 5003, floats(base + r.normal(size=16) * r.choice([0, 0.02, 0.1, 0.18])), i % 3) for _ in range(r.integers(1, 8))]
    base = r.normal(size=16)
    rows += [(6000 + i, floats(base + r.normal(size=16) * 0.11), 1) for i in range(250)]  # a group that no core holds whole
    rows += odd_vectors()
    found = by_id(tuple(x)[:3] for x in embedding_duplicates(frame(spark, rows), **how).collect())
    want = by_id(brute_links(rows, 0.93))
    assert [x[0] for x in found] == [x[0] for x in want] and all(a[1] <= b[1] for a, b in zip(found, want))
    assert sum(x[1] for x in found) >= 0.99 * sum(x[1] for x in want)
    assert sum(a == b for a, b in zip(found, want)) >= 0.9 * len(want)


def test_embedding_duplicates_of_nothing(spark):
    assert embedding_duplicates(frame(spark, [(1, [1.0], 1)]).limit(0)).collect() == []
    assert [tuple(x) for x in embedding_duplicates(frame(spark, [(4, None, 1), (5, [1.0], None)])).sort("vec_id").collect()] == [(4, 0, 4, True), (5, 0, 5, True)]


def brute_phrases(rows, least, longest, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n, by = Counter(), Counter(), defaultdict(list)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {(lang, w[i : i + k]) for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if a >= found[lang, w[i : i + k]]}
    for (lang, w), a in found.items():
        if (lang, w) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, all_ in by.items() for i, x in enumerate(sorted(all_)[:top]))


@pytest.mark.parametrize("how", [{}, {"block_bytes": 2000, "most_keys": 16, "bin_keys": 100}])
def test_collocations(spark, how):
    r = random.Random(5)
    rows = [(r.choice(["en", "fr", None, "und"]), " ".join(r.choice(["a", "B", "c", "dd.", "e,", "f\ng", "a a a", "ñandú", "x\x1cy"]) for _ in range(r.randrange(60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), ("fr", " \t . "), ("en", "la " * 5000), *rows[:20]]
    docs = spark.createDataFrame([(*x, 1, "p", "k") for x in rows], "lang string, text string, n long, phrase string, key string")
    found = collocations(docs.repartition(3), least=10, top=50, **how)
    assert sorted(tuple(x) for x in found.collect()) == brute_phrases(rows, 10, 5, 50)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", "one two")], "lang string, text string")
    assert collocations(docs.limit(0)).collect() == [] and collocations(docs).collect() == []


def test_minimal_hash():
    keys = np.random.default_rng(4).integers(0, 2**63, 70_000).astype(np.uint64)
    found = MinimalHash(np.unique(keys))
    slots = found.slots(np.unique(keys))
    assert sorted(slots.tolist()) == list(range(len(slots))) and (found.slots(keys + np.uint64(2**63)) == -1).all()
    assert len(MinimalHash(np.zeros(0, np.uint64)).slots(keys[:3])) == 3


def test_queries_are_listed():
    assert {"op11_hard_negatives", "op12_embedding_dedup", "op13_phrases"} <= set(queries.queries()) & set(queries.oracle_sql())
