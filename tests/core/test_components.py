"""Strong components, bubbles and alleles of random graphs with cycles and inversions, against plain search."""

import random
from collections import defaultdict

from weftgraph.operators import bubbles, components, lineage

rng = random.Random(23)


def reachable(steps, start, closed=()):
    """All that start leads to by one step or more, not through closed vertices; those reached are told."""
    seen, todo = set(), [start]
    while todo:
        for w in steps.get(todo.pop(), ()):
            if w not in seen:
                seen.add(w)
                if w not in closed:
                    todo.append(w)
    return seen


def brute_components(arcs):
    steps = defaultdict(set)
    for v, w in arcs:
        steps[v].add(w)
    vs = {x for a in arcs for x in a}
    to = {v: reachable(steps, v) for v in vs}
    return {v: min([w for w in vs if w in to[v] and v in to[w]] + [v]) for v in vs}


def test_strong_components(spark):
    rows, want = [], {}
    for k in range(40):
        arcs = [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(1, 16))]
        rows += [(k, v, w) for v, w in arcs]
        want |= {(k, v): c for v, c in brute_components(arcs).items()}
    found = components.strong_components(spark.createDataFrame(rows, "k int, v long, w long"), ["k"])
    assert {(r.k, r.v): r.component for r in found.collect()} == want
    arcs = [(100 * k + v, 100 * k + w) for k, v, w in rows]
    own = components.strong_components(spark.createDataFrame(arcs, "v long, w long"))
    assert {r.v: r.component for r in own.collect()} == {100 * k + v: 100 * k + c for (k, v), c in want.items()}
    order = {r.component: r.level for r in components.condensation_order(own, spark.createDataFrame(arcs, "v long, w long")).collect()}
    part = {r.v: r.component for r in own.collect()}
    assert all(order[part[v]] < order[part[w]] for v, w in arcs if part[v] != part[w])


def test_bidirected_components(spark):
    arcs = [(0, 2), (2, 1), (4, 6), (6, 4), (8, 4)]  # 0 > 2 > 1 = complement of 0, and back: both strands on one cycle
    arcs += [(w ^ 1, v ^ 1) for v, w in arcs] + [(1, 0)]
    found = {r.v: r.component for r in components.bidirected_components(spark.createDataFrame(arcs, "v long, w long")).collect()}
    assert all(found[v] != found.get(v ^ 1) for v in found)
    assert found[4] == found[6] == 4 and found[5] == found[7] == 5


def brute_bubbles(line, lengths, arcs):
    """(source, sink, n_seg, n_paths, len_min, len_max, is_inv) by the definition: a place is an end if no walk off the
    line leads over it; inside is what a place reaches and what reaches a later one."""
    steps = defaultdict(set)
    for v, w in arcs:
        steps[v].add(w)
    closed = {v for v in line} | {v ^ 1 for v in line}
    place = {v: p for p, v in enumerate(line)}
    spans, off = set(), {}
    for a, v in enumerate(line):
        for w in reachable(steps, v, closed):
            if w in place and place[w] > a:
                spans.add((a, place[w]))
    spans = {(a, b) for a, b in spans if b > a + 1 or any(x not in closed and line[b] in reachable(steps, x, closed) for x in reachable(steps, line[a], closed))}
    for x in {v for v in steps if v not in closed}:
        a = [p for p, v in enumerate(line) if x in reachable(steps, v, closed)]
        b = [place[w] for w in reachable(steps, x, closed) if w in place]
        if a and b and min(a) < max(b):
            off[x] = (min(a), max(b))
    cuts = [p for p in range(len(line)) if not any(a < p < b for a, b in spans)]
    out = set()
    for a, b in zip(cuts, cuts[1:]):
        inner = {x for x, (p, q) in off.items() if a <= p and q <= b}
        if b == a + 1 and not inner:
            continue
        inside = set(line[a : b + 1]) | inner
        local = {v: [w for w in steps[v] if w in inside and w != line[a]] if v != line[b] else [] for v in inside}
        cyclic = any(v in reachable(local, v) for v in inside)
        found = []

        def walk(v, size):
            if v == line[b]:
                found.append(size)
                return
            for w in local[v]:
                walk(w, size + (0 if w == line[b] else lengths[w // 2]))

        if not cyclic:
            walk(line[a], 0)
        both = len({x // 2 for x in inside}) < len(inside)
        out.add((line[a], line[b], len(inside), *((None,) * 3 if cyclic else (len(found), min(found), max(found))), both))
    return out


def graphs(n):
    """Random graphs in one: a line each, other segments, arcs over, between and back, on both strands."""
    segments, arcs, want, first = [], [], set(), 0
    for k in range(n):
        size, more = rng.randrange(3, 7), rng.randrange(0, 6)
        lengths = {first + i: rng.randrange(1, 6) for i in range(size + more)}
        line, at = [2 * (first + i) for i in range(size)], 0
        for i in range(size + more):
            segments.append((first + i, "s", "ACGTA"[: lengths[first + i]], lengths[first + i], f"c{k}" if i < size else "x", at if i < size else 0, 0 if i < size else 1))
            at += lengths[first + i]
        mine = set(zip(line, line[1:]))
        every = [2 * (first + i) + rng.choice([0, 0, 0, 1]) for i in range(size, size + more)]
        for _ in range(rng.randrange(0, 4 + 2 * more)):
            v, w = rng.choice(line + every), rng.choice(line + every)
            if v != w or rng.random() < 0.2:
                mine.add((v, w ^ (rng.random() < 0.1)))
        if every and rng.random() < 0.3:  # an inversion: a segment on either strand between two places
            a = rng.randrange(size - 1)
            mine |= {e for x in (every[0], every[0] ^ 1) for e in ((line[a], x), (x, line[a + 1]))}
        if k == 0:  # a cycle off the line, through which a walk leads on
            o = 2 * first
            segments[-(size + more) :], lengths = [(first + i, "s", "AC", 2, "c0" if i < 2 else "x", 2 * i if i < 2 else 0, 0 if i < 2 else 1) for i in range(5)], {first + i: 2 for i in range(5)}
            line, mine, size, more = [o, o + 2], {(o + a, o + b) for a, b in [(0, 4), (4, 6), (0, 8), (8, 6), (6, 4), (4, 2), (0, 2)]}, 2, 3
        mine |= {(w ^ 1, v ^ 1) for v, w in mine}
        arcs += mine
        want |= {(f"c{k}", *b) for b in brute_bubbles(line, lengths, mine)}
        first += size + more
    return segments, arcs, want


def test_bubbles_of_random_graphs(spark):
    segments, arcs, want = graphs(200)
    segs = spark.createDataFrame(segments, "seg long, name string, seq string, len long, sn string, so long, sr long")
    steps = spark.createDataFrame(arcs, "v long, w long")
    found = bubbles.bubbles(segs, steps).collect()
    assert {(r.sn, r.source, r.sink, r.n_seg, r.n_paths, r.len_min, r.len_max, r.is_inv) for r in found} == want and len(found) == len(want)
    assert next(r for r in found if r.sn == "c0").n_seg == 5 and sum(r.is_inv for r in found) > 3 and sum(r.n_paths is None for r in found) > 10
    size, links = {s[0]: s[3] for s in segments}, set(arcs)
    known = {(r.source, r.sink): r for r in found if r.n_paths is not None}
    ways = bubbles.shortest_and_longest(segs, steps).collect()
    assert len(ways) == 2 * len(known)
    for r in ways:
        b = known[r.source, r.sink]
        walk = [r.source, *(2 * int(s) + (o == "<") for o, s in _steps(r.path)), r.sink]
        assert all(a in links for a in zip(walk, walk[1:]))
        assert len(r.seq) == sum(size[v // 2] for v in walk[1:-1]) == (b.len_min if r.kind == "shortest" else b.len_max)


def _steps(path):
    import re

    return re.findall(r"([<>])(\d+)", path)


def test_line_without_bubbles(spark):
    segs = spark.createDataFrame([(i, "s", "A", 1, "c", i, 0) for i in range(4)], "seg long, name string, seq string, len long, sn string, so long, sr long")
    line = spark.createDataFrame([(0, 2), (2, 4), (4, 6), (3, 1), (5, 3), (7, 5)], "v long, w long")
    assert bubbles.bubbles(segs, line).collect() == [] and bubbles.shortest_and_longest(segs, line).collect() == []
    assert bubbles.bubbles(segs, line.limit(0)).collect() == []


def test_components_take_one_table_a_step(spark, monkeypatch):
    seen = []

    def counting(df, cut=lineage.cut):
        seen.append(1)
        return cut(df)

    for module in (lineage, components):
        monkeypatch.setattr(module, "cut", counting)
    ring = [(v, (v + 1) % 12) for v in range(12)] + [(20, 0), (3, 30)]
    found = {r.v: r.component for r in components.strong_components(spark.createDataFrame(ring, "v long, w long")).collect()}
    assert found == {v: 0 for v in range(12)} | {20: 20, 30: 30}
    assert len(seen) < 25  # both ways in the same steps, a table for each of the 12


def test_components_of_large_fronts(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 2)  # most fronts go by their vertices, the last ones to all tasks
    arcs = [(v, rng.randrange(60)) for v in range(60)] + [(100 + v, 101 + v) for v in range(6)] + [(5, 5), (5, 5), (5, 6), (5, 6), (6, 5)]
    found = components.strong_components(spark.createDataFrame(arcs, "v long, w long"))
    assert {r.v: r.component for r in found.collect()} == brute_components(arcs)
    own = brute_components(arcs)
    left = {(r.v, r.w) for r in components.trim(spark.createDataFrame(arcs, "v long, w long").where("v <> w"), []).collect()}
    assert {(v, w) for v, w in arcs if v != w and own[v] == own[w]} <= left and not any(v >= 100 for v, _ in left)
