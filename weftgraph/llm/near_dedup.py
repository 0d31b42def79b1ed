"""Near-duplicate documents by min-max hashing.

A document is its set of distinct word shingles. Each of `perms` hash functions gives two signature values,
its minimum and its maximum over the set, so 2 * perms values cost perms evaluations. Bands of `rows`
values are the bucket keys. With 64 functions and bands of 4 there are 32 bands: a pair at similarity 0.8
shares no band with probability 5e-8.

1. Equal sets become one node, named by the smallest id, with a sketch: a byte of each signature value.
2. Within a bucket the sketches of its nodes are compared. Two sketches differ in as many bytes as a binomial law
   of 1 - similarity tells; nodes further apart than six standard deviations beyond the wanted similarity are
   strangers that met by chance (at 0.8 a link is lost so with probability 2e-8). Without that the strangers tie
   more and more of all documents to one group, the more there are. Connected components of the near ones are
   groups that hold every candidate pair. A group is dealt into blocks of bounded size.
3. A task gets one block and its group's leaders with their full sets and confirms links until they are
   spanned (pairs already connected are skipped). For a group of one block that is exact.
4. In groups of several blocks, nodes outside the largest confirmed part are compared, in blocks, with all
   others of their group. Then each pair is connected or compared: no link is lost. Buckets of very many nodes
   are dealt into blocks in the same way, at 2.

Defined cases: null or empty texts and texts without words have an empty set and link with nothing; rows
with a null id link with nothing and get a null component and kept = true; rows with equal ids count as one
document; ties go to the smallest id; an empty table gives no rows. Other columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_parts
from .components import components
from .substring_dedup import CHUNK, _mix, _word_hashes

BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles; A-Z count as a-z."""
    words, counts = _word_hashes([t.lower() if t else t for t in texts])
    whole, out, at = words * BASE, [], 0
    for _ in range(width - 1):
        whole = whole[:-1] * BASE + words[len(words) - len(whole) + 1 :] if len(whole) else whole
    whole = _mix(whole)
    for n in counts.tolist():
        if n >= width:
            found = np.unique(whole[at : at + n - width + 1])
        elif n:
            found = np.array([n], np.uint64)  # arrays wrap around without a warning
            for w in words[at : at + n]:
                found = _mix(found * BASE + w)
        else:
            found = np.zeros(0, np.uint64)
        out.append(found)
        at += n
    return out


def signature(found: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum under each hash function."""
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    low, high = np.full(len(factors), 2**32 - 1, np.uint32), np.zeros(len(factors), np.uint32)
    for part in range(0, len(x), 4096):
        h = x[part : part + 4096] * factors[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return low, high


def factors(perms: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**31, perms, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of a signature; a band holds only minima or only maxima."""
    values = values.astype(np.uint64).reshape(-1, rows)
    key = np.arange(len(values), dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        key = _mix(key * BASE + values[:, k])
    return key.view(np.int64)


def _similar(a: set, b: set, percent: int) -> bool:
    small, large = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if 100 * small < percent * large:
        return False
    common = len(a & b)
    return 100 * common >= percent * (small + large - common)


class _Union(dict):
    def find(self, x):
        top = x
        while self.setdefault(top, top) != top:
            top = self[top]
        while self[x] != top:
            self[x], x = top, self[x]
        return top

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _sets(column: pa.Array) -> list[set]:
    return [set(np.frombuffer(x.as_buffer(), np.uint64).tolist()) for x in column]


def _confirm(percent: int):
    """Spanning links among the rows of one group; `own` of role 0 are compared with all, role 1 only with role 0."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, label, role = (rows.column(k).to_pylist() for k in ("node", "label", "role"))
        sets, union, links = _sets(rows.column("shingles").combine_chunks()), _Union(), []
        by_label = defaultdict(list)
        for n, at in zip(node, label):
            by_label[at].append(n)
        for same in by_label.values():
            for n in same[1:]:
                union.join(same[0], n)
        order = sorted(range(len(node)), key=lambda i: (role[i], node[i]))
        own = [i for i in order if role[i] == 0]
        for place, i in enumerate(order):
            for j in own[: min(place, len(own))]:
                if union.find(node[i]) != union.find(node[j]) and _similar(sets[i], sets[j], percent):
                    union.join(node[i], node[j])
                    links.append((node[i], node[j]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def signatures(docs: DataFrame, width: int, perms: int, rows: int, seed: int) -> DataFrame:
    """doc, n, fp1, fp2 (a fingerprint of the set), bands and sketch of each row."""
    f = factors(perms, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(1), CHUNK):
                found = shingles(texts, width)
                prints = [[int(_mix(x ^ c).sum(dtype=np.uint64).astype(np.int64)) for x in found] for c in (np.uint64(1), BASE)]
                values = [np.concatenate(signature(x, f)) if len(x) else np.zeros(0, np.uint32) for x in found]
                bands = np.concatenate([np.zeros(0, np.int64), *(band_keys(x, rows) for x in values)])
                ends = np.concatenate([[0], np.cumsum([2 * perms // rows if len(x) else 0 for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop], pa.array([len(x) for x in found], pa.int64()), *(pa.array(x, pa.int64()) for x in prints),
                        pa.ListArray.from_arrays(ends, bands), pa.array([x.astype(np.uint8).tobytes() for x in values], pa.binary()),
                    ],
                    names=["doc", "n", "fp1", "fp2", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(run, "doc long, n long, fp1 long, fp2 long, bands array<long>, sketch binary")


def _spans(sketches: np.ndarray, tops: int, near: int, same: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Links that connect each of the first `tops` rows to every row whose sketch differs from its own in `near` bytes
    or fewer; the rows then left, and all rows' labels. A row that differs from an earlier one in `same` bytes at
    most is left out from then on: what is near to it is within near + same of the earlier one, and linked to that."""
    label, left, links = np.arange(len(sketches)), np.arange(len(sketches)), []
    while len(left) and left[0] < tops and (label[left] != label[left[0]]).any():
        top, left = left[0], left[1:]
        far = np.count_nonzero(sketches[left] != sketches[top], axis=1)
        close = left[far <= near + same]
        found, at = np.unique(label[close], return_index=True)
        links += [(int(top), int(i)) for x, i in zip(found, close[at]) if x != label[top]]
        label[np.isin(label, found)] = label[top]
        left = left[far > same]
    return links, left, label


def _bucket_links(rows: DataFrame, near: int, same: int, with_open: bool = False) -> DataFrame:
    """rows: (key, part, lead, node, sketch). (a, b) are links among the nodes of one key and part, of leads with all;
    with_open tells (key, a, top) of the nodes whose other pairs are open, top being the lead that they are linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            lead, node = (table.column(k).to_numpy() for k in ("lead", "node"))
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
            two = starts[sizes == 2]  # most buckets
            two = two[lead[two]]
            two = two[np.count_nonzero(sketches[two] != sketches[two + 1], axis=1) <= near + same] if not with_open else two[:0]
            out, rest = [(node[two], node[two + 1])], []
            for start, size in zip(starts.tolist(), sizes.tolist()):
                if size < 2 or (size == 2 and not with_open):
                    continue
                own, tops = node[start : start + size], int(lead[start : start + size].sum())
                found, left, label = _spans(sketches[start : start + size], tops, near, same)
                out.append(tuple(own[[x[k] for x in found]] if found else own[:0] for k in (0, 1)))
                if with_open:
                    first = {x: own[k] for k, x in reversed(list(enumerate(label[:tops].tolist())))}
                    key = table.column("key")[start].as_py()
                    rest += [(key, int(own[i]), first.get(int(label[i]))) for i in left if i >= tops]
            a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
            none = [None] * len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(none + [x[0] for x in rest], pa.int64()), pa.array([*a.tolist(), *(x[1] for x in rest)], pa.int64()), pa.array([*b.tolist(), *[None] * len(rest)], pa.int64()), pa.array(none + [x[2] for x in rest], pa.int64())],
                names=["key", "a", "b", "top"],
            )

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key, part = (table.column(k).to_numpy() for k in ("key", "part"))
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])) if len(key) else np.zeros(0, np.int64)
            if len(starts) > 1:  # the last one may go on in the next batch
                yield links(table.slice(0, starts[-1]).combine_chunks(), starts[:-1], np.diff(starts))
            held = table.slice(starts[-1]) if len(starts) else None
        if held is not None:
            yield links(held.combine_chunks(), np.zeros(1, np.int64), np.array([held.num_rows]))

    dealt = rows.select("key", "part", "lead", "node", "sketch").repartition("key", "part").sortWithinPartitions("key", "part", F.desc("lead"), "node")
    return dealt.mapInArrow(run, "key long, a long, b long, top long")


def _candidates(classes: DataFrame, near: int, same: int, crowd: int, leaders: int) -> DataFrame:
    """(a, b): links that connect all nodes that share a bucket and are near by their sketches."""
    members = classes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    buckets = stored(buckets.select("key", F.ceil(F.col("_n") / crowd).cast("int").alias("cells")), "buckets")
    shared = stored(members.join(buckets, "key"), "bucket-members")
    sketched = lambda rows: rows.join(classes.select("node", "sketch"), "node")
    found = _bucket_links(sketched(shared.where("cells = 1")).withColumns({"part": F.lit(0), "lead": F.lit(True)}), near, same).select("a", "b")
    wide = shared.where("cells > 1")
    if buckets.where("cells > 1").isEmpty():
        return found
    # every block of a large bucket also gets the bucket's leaders, a few nodes by the order of a hash
    first = wide.groupBy("key").agg(F.min("cells").alias("cells"), *[F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node")).alias(f"l{k}") for k in range(leaders)])
    first = first.select("key", "cells", F.explode(F.array_distinct(F.array(*[F.col(f"l{k}.node") for k in range(leaders)]))).alias("node"))
    lead = first.select("key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("part"), F.lit(True).alias("lead"), "node")
    rest = wide.join(first.select("key", "node"), ["key", "node"], "left_anti")
    rest = rest.select("key", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("part"), F.lit(False).alias("lead"), "node")
    led = stored(_bucket_links(sketched(lead.unionByName(rest)), near, same, with_open=True), "led-links")
    # nodes linked to the most frequent leader are connected; each of the others is compared with all that are open
    open_ = led.where("b IS NULL").select("key", F.col("a").alias("node"), "top")
    main = open_.where("top IS NOT NULL").groupBy("key", "top").agg(F.count(F.lit(1)).alias("_n")).groupBy("key").agg(F.max_by("top", F.struct("_n", "top")).alias("main"))
    open_ = open_.join(main, "key", "left").select("key", "node", (~F.col("top").eqNullSafe(F.col("main")) | F.col("top").isNull()).alias("out"))
    parts = open_.groupBy("key").agg(F.count_if("out").alias("_out"), F.count(F.lit(1)).alias("_all")).where("_out > 0")
    parts = stored(parts.select("key", *[F.ceil(F.col(c) / crowd).cast("long").alias(d) for c, d in (("_out", "cuts"), ("_all", "blocks"))]), "open-buckets")
    open_ = open_.join(parts, "key")
    cut, block = F.pmod(F.xxhash64("node"), F.col("cuts")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    outside = open_.where("out").select("key", "node", "blocks", cut.alias("cut"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("lead"))
    inside = open_.select("key", "node", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"), block.alias("block"), F.lit(False).alias("lead"))
    late = outside.unionByName(inside).select("key", (F.col("cut") * F.col("blocks") + F.col("block")).alias("part"), "lead", "node")
    return found.unionByName(led.where("b IS NOT NULL").select("a", "b")).unionByName(_bucket_links(sketched(late), near, same).select("a", "b"))


def _node_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The full sets of the nodes, from the texts of their documents; other columns of nodes come along."""
    more = [c for c in nodes.columns if c != "node"]
    kinds = dict(nodes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(1), CHUNK):
                found = shingles(texts, width)
                own = [batch.column(k)[part.start : part.stop] for k in (0, *range(2, 2 + len(more)))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in found], pa.binary())], names=["node", *more, "shingles"])

    joined = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node").select("node", "text", *more)
    return joined.mapInArrow(run, ", ".join(["node long", *(f"{c} {kinds[c]}" for c in more), "shingles binary"]))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, perms: int = 64, rows: int = 4, seed: int = 7, block: int = 256, leaders: int = 8, crowd: int = 4096) -> DataFrame:
    """(doc, n, component) for each row of docs. Blocks hold about `block` nodes of a group or `crowd` of a bucket."""
    docs = docs.select("doc_id", "text")
    marks = stored(signatures(docs, width, perms, rows, seed), "signatures")
    some = marks.where("n > 0 AND doc IS NOT NULL")
    classes = stored(some.groupBy("fp1", "fp2", "n").agg(F.min("doc").alias("node"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "set-classes")
    values, apart = 2 * perms, (1 - percent / 100) * 255 / 256
    near = int(values * apart + 6 * (values * apart * (1 - apart)) ** 0.5)
    groups = components(_candidates(classes, near, values // 32, crowd, leaders), "groups")

    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).select("component", F.ceil(F.col("_n") / block).cast("int").alias("blocks"))
    nodes = groups.join(stored(sizes, "group-sizes"), "component").select("node", F.col("component").alias("grp"), "blocks")
    sets = stored(_node_sets(docs, nodes, width), "node-sets")
    own = sets.select("grp", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("part"), "node", F.col("node").alias("label"), F.lit(0).alias("role"), "shingles")
    wide = sets.where("blocks > 1")
    # every block of a large group also gets the group's leaders, a few nodes by the order of a hash
    first = wide.groupBy("grp").agg(F.min("blocks").alias("blocks"), *[F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node")).alias(f"l{k}") for k in range(leaders)])
    first = first.select("grp", "blocks", F.explode(F.array_distinct(F.array(*[F.col(f"l{k}.node") for k in range(leaders)]))).alias("node"))
    lead = wide.drop("blocks").join(first, ["grp", "node"]).select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "node", F.col("node").alias("label"), F.lit(0).alias("role"), "shingles")
    links = stored(own.unionByName(lead).groupBy("grp", "part").applyInArrow(_confirm(percent), "a long, b long"), "links")

    found = components(links, "confirmed")
    labelled = wide.join(found, "node", "left").select("grp", "blocks", "node", F.coalesce("component", "node").alias("label"), "shingles")
    labelled = stored(labelled, "labelled")
    parts = labelled.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("_n"))
    main = parts.groupBy("grp").agg(F.max_by("label", F.struct("_n", "label")).alias("main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    main = stored(main.where("_all > _most").select("grp", "main", F.ceil((F.col("_all") - F.col("_most")) / block).cast("int").alias("cuts")), "largest-parts")
    open_ = labelled.join(main, "grp")
    cut = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    outside = open_.where("label <> main").select("grp", cut.alias("cut"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "node", "label", F.lit(0).alias("role"), "shingles")
    inside = open_.select("grp", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), part.alias("part"), "node", "label", F.lit(1).alias("role"), "shingles")
    late = outside.unionByName(inside).groupBy("grp", "cut", "part").applyInArrow(_confirm(percent), "a long, b long")
    both = components(links.unionByName(late), "linked")

    of_class = classes.join(both, "node", "left").select("fp1", "fp2", "n", F.coalesce("component", "node").alias("component"))
    of_class = stored(of_class, "class-components")
    return marks.join(of_class, ["fp1", "fp2", "n"], "left").select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def label_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest id of its component) for each row."""
    found = near_duplicates(docs, **how)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, with all its columns."""
    gone = label_near_duplicates(docs, **how).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
