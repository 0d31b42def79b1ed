"""Claims of gene copies against the same turns taken one by one."""

import random
import re

from weftgraph.operators import gene_copies

rng = random.Random(31)


def turns(hits, parts, sources, most=0.5):
    """Hits in order of score; each claims its intervals if enough of them is free on its strand."""
    claimed, own = {}, {}
    for h, p, c, s, a, b in parts:
        own.setdefault(h, []).append((c, s, a, b))
        g = next(x[1] for x in hits if x[0] == h)
        if g in sources:
            c2, a2, b2 = sources[g]
            if c2 == c and min(b, b2) - max(a, a2) > max(0, (b - a) * 0.99):
                claimed.setdefault((c, s), []).append((a, b))
    out = {}
    for h, g, score in sorted(hits, key=lambda x: (-x[2], x[0])):
        taken = sum(len({x for a2, b2 in claimed.get((c, s), []) for x in range(max(a, a2), min(b, b2))}) for c, s, a, b in own.get(h, []))
        length = sum(b - a for _, _, a, b in own.get(h, []))
        out[h] = (taken, length, taken < length * most)
        if out[h][2]:
            for c, s, a, b in own[h]:
                claimed.setdefault((c, s), []).append((a, b))
    return out


def test_claims(spark):
    hits = [(h, f"g{rng.randrange(9)}", rng.randrange(12)) for h in range(90)]
    parts = [(h, p, rng.choice("xy"), rng.choice([1, -1]), (a := rng.randrange(300)), a + rng.randrange(1, 40)) for h, _, _ in hits[:-1] for p in range(rng.randrange(1, 3))]
    sources = {g: (c, a, b) for h, p, c, _, a, b in parts[::17] for g in [hits[h][1]]}
    frame = spark.createDataFrame(hits, "hit long, gene string, score long")
    rows = spark.createDataFrame(parts, "hit long, part int, ctg string, strand int, st long, en long")
    for homes in ({}, sources):
        src = spark.createDataFrame([(g, *x) for g, x in homes.items()], "gene string, ctg string, st long, en long")
        found = gene_copies.claim(frame, rows, src if homes else None, width=64)
        assert {r.hit: (r.claimed, r.length, r.good) for r in found.collect()} == turns(hits, parts, homes)
    counts = {r.gene: (r.n_hits, r.n_good) for r in gene_copies.copy_counts(found).collect()}
    assert sum(n for n, _ in counts.values()) == 90
    assert gene_copies.claim(frame.limit(0), rows.limit(0)).collect() == []


def test_hits_and_intervals(spark):
    schema = "hit long, gene string, qlen long, qs long, qe long, strand string, path string, plen long, ps long, pe long, cigar string"
    rows = [
        (0, "A|x", 100, 0, 90, "+", ">c1:10-40<c2:5-65", 90, 4, 80, "50=2X10=1D"), (1, "A|x", 100, 0, 80, "-", "c1", 500, 100, 180, "80="), (2, "A|x", 100, 0, 70, "+", "c1", 500, 0, 70, "70="),
        (3, "A|x", 100, 5, 81, "+", "c1", 500, 0, 76, "76="), (4, "B|ENSG01", 10, 0, 10, "+", "c1", 9, 0, 9, "9="), (5, "A|x", 100, 0, 82, "+", "<c2:5-65>c1:0-30", 90, 4, 80, "9="),
    ]
    hits = gene_copies.gene_hits(spark.createDataFrame(rows, schema))
    assert {(r.hit, r.score, round(r.de, 4)) for r in hits.collect()} == {(0, 60 - 7 - 6, round(2 / 62, 4)), (1, 80, 0.0), (5, 9, 0.0)}

    def brute(path, plen, ps, pe):
        out, at = [], 0
        for o, c, a, b in re.findall(r"([><])([^\s><]+):(\d+)-(\d+)", path):
            a, b = int(a), int(b)
            st, en = a, b
            if at <= ps < at + b - a:
                st, en = (a + ps, en) if o == ">" else (st, b - ps)
            elif at <= pe < at + b - a:
                st, en = (st, a + pe - at) if o == ">" else (a + plen - pe, en)
            out.append((c, 1 if o == ">" else -1, st, en))
            at += b - a
        return out

    got = {}
    for r in sorted(gene_copies.hit_intervals(hits).collect()):
        got.setdefault(r.hit, []).append((r.ctg, r.strand, r.st, r.en))
    assert got == {0: brute(*rows[0][6:10]), 1: [("c1", -1, 100, 180)], 5: brute(*rows[5][6:10])}
