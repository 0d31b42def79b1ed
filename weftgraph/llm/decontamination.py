"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage with
block-max WAND.

Each document's words (A-Z as a-z, outer punctuation off) are cut into overlapping passages. An item has
passages of its own length: long enough that every stretch of its words over `question_share` lies whole in one,
so room for some inserted words, and no longer, so its verdict doesn't hang on other items' lengths. Items of
similar length share an index and the passages of the longest of them; what these retrieve is scored and
verified again on the item's own. A term's weight in an item is its BM25 weight
over the item's own total, so a passage's score is the share of the item that it holds, from 0 to 1. A
passage retrieves all items of `threshold` or more. WAND runs in two steps: sums of the terms' largest
weights bound each passage's score, all passages at once, and those that can't reach the threshold are
passed over; the others walk the posting lists with the largest weights of blocks of items. A
retrieved item is verified: the longest common subsequence of passage and question, and of passage and
answer, must hold `question_share` and `answer_share` of their words. An item without an answer is all
question: its whole text is judged at `question_share`, and its answer overlap is 1.

Tasks build the index in parts of at most `index_bytes`, as measured, or one item; how many items there are,
their mean length and the terms' frequencies come from all items, so scores don't depend on the parts. The driver
fetches, broadcasts and frees one part at a time, each a pass over the documents, and their hits are united.

Defined cases: null or empty documents and items retrieve nothing; an item's words that no text holds simply
lower the reachable score; repeated items are found each under their ids; ties go to the smaller item id and
the first passage; an empty benchmark or document table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import sys
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, claim, col, in_arrow, shared_path, stored, text_parts

STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HITS = "item_id long, passage_start int, score double, question_overlap double, answer_overlap double"


@dataclass(frozen=True)
class Settings:
    """k1, b: of BM25. stride: words between passage starts. block: items in a block of a posting list."""

    threshold: float = 0.65
    question_share: float = 0.75
    answer_share: float = 0.6
    k1: float = 1.2
    b: float = 0.75
    stride: int = 32
    block: int = 8
    index_bytes: int = 64 << 20


class _Terms(dict):
    def __missing__(self, word: bytes) -> bytes:
        self[word] = found = word.lower().strip(STRIP)
        return found


_terms = _Terms()


def terms(text: bytes | None) -> list[bytes]:
    """The words of a text as terms; words of punctuation alone are none."""
    claim("terms", _terms.clear)
    if len(_terms) > 400_000:
        _terms.clear()
    return [t for t in map(_terms.__getitem__, text.split()) if t] if text else []


Item = tuple[int, list[bytes], list[bytes]]


@dataclass
class Stats:
    """What BM25 knows of all items: how many, their mean length, items with each term."""

    n: int
    mean: float
    df: dict[bytes, int]


def stats_of(items: list[Item]) -> Stats:
    return Stats(len(items), sum(len(q) + len(a) for _, q, a in items) / max(1, len(items)), Counter(t for _, q, a in items for t in {*q, *a}))


def passage_words(item_words: int, s: Settings) -> int:
    """Words in the passages on which an item of so many words is judged."""
    return math.ceil(item_words / s.question_share) + s.stride


def length_classes(items: Iterable[Item], s: Settings) -> list[list[Item]]:
    """Items by length, cut so that passages within a class differ by half at most."""
    out: list[list[Item]] = []
    least = 0
    for x in sorted(items, key=lambda x: len(x[1]) + len(x[2])):
        size = passage_words(len(x[1]) + len(x[2]), s)
        if not out or 2 * size > 3 * least:
            out.append([])
            least = size
        out[-1].append(x)
    return out


@dataclass
class Index:
    """Postings of normalized weights. items: item id, question and answer terms, by place."""

    items: list[Item]
    s: Settings
    stats: Stats | None = None
    postings: dict[bytes, tuple[array, array]] = field(default_factory=dict)
    most: dict[bytes, float] = field(default_factory=dict)

    def __post_init__(self):
        s, n = self.s, len(self.items)
        known = self.stats or stats_of(self.items)
        self.stats = None  # the weights hold what is needed of it
        df = known.df
        # items that share frequent terms stand together: blocks' largest weights are then closer to their items'
        self.items = sorted(self.items, key=lambda x: sorted(((-df[t], t) for t in {*x[1], *x[2]}))[:4])
        bags = [Counter(q + a) for _, q, a in self.items]
        sizes = [len(q) + len(a) for _, q, a in self.items]
        self.shortest, self.longest = min(sizes, default=0), max(sizes, default=0)
        for i, bag in enumerate(bags):
            weight = {t: math.log(1 + (known.n - df[t] + 0.5) / (df[t] + 0.5)) * f * (s.k1 + 1) / (f + s.k1 * (1 - s.b + s.b * sizes[i] / known.mean)) for t, f in bag.items()}
            total = math.fsum(weight.values())
            for t, w in weight.items():
                if t not in self.postings:
                    self.postings[t] = array("i"), array("d")
                self.postings[t][0].append(i)
                self.postings[t][1].append(w / total)
        # largest weights of a term's own blocks: those of term k are block_ptr[k] to block_ptr[k + 1]
        self.n_blocks = max(1, -(-n // s.block))
        self.block_ptr, self.block_at, self.block_max = array("q", [0]), array("i"), array("d")
        for t, (at, w) in self.postings.items():
            first = len(self.block_at)
            for i, x in zip(at, w):
                if len(self.block_at) == first or self.block_at[-1] != i // s.block:
                    self.block_at.append(i // s.block)
                    self.block_max.append(x)
                elif x > self.block_max[-1]:
                    self.block_max[-1] = x
            self.block_ptr.append(len(self.block_at))
            self.most[t] = max(w)
        self.place = {t: k for k, t in enumerate(self.postings)}
        self.bound = np.array([*self.most.values(), 0.0], np.float32)

    def nbytes(self) -> int:
        """What the index holds in memory."""
        size = sys.getsizeof
        found = sum(map(size, (self.items, self.postings, self.most, self.place, self.block_ptr, self.block_at, self.block_max))) + self.bound.nbytes
        found += sum(size(x) + size(x[1]) + size(x[2]) + 32 for x in self.items)
        # a float and an int object for each term
        return found + sum(size(t) + size(p) + size(p[0]) + size(p[1]) + 56 for t, p in self.postings.items())

    def block_most(self, term: bytes, block: int) -> float:
        k = self.place[term]
        end = self.block_ptr[k + 1]
        i = bisect_left(self.block_at, block, self.block_ptr[k], end)
        return self.block_max[i] if i < end and self.block_at[i] == block else 0.0

    def score(self, place: int, query: set[bytes]) -> float:
        """The share of one item that the query holds, as search() gives it."""
        _, question, answer = self.items[place]
        held = [self.postings[t] for t in {*question, *answer} & query]
        return math.fsum(w[bisect_left(at, place)] for at, w in held)

    def search(self, query: set[bytes]) -> list[tuple[int, float]]:
        """All items of the threshold or more, by block-max WAND: (place, score)."""
        limit, block = self.s.threshold - 1e-12, self.s.block
        cursors = [[self.postings[t][0][0], 0, t] for t in query if t in self.postings]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= limit:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            head = cursors[: pivot + 1]
            if sum(self.block_most(c[2], item // block) for c in head) < limit:
                # no item of this block before the next list's own can reach it
                target = (item // block + 1) * block
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                self._advance(cursors, head, max(target, item + 1))
            elif cursors[0][0] == item:
                score = math.fsum(self.postings[c[2]][1][c[1]] for c in head)
                if score >= limit:
                    out.append((item, score))
                self._advance(cursors, head, item + 1)
            else:
                self._advance(cursors, [c for c in head if c[0] < item], item)
        return out

    def _advance(self, cursors: list, some: list, target: int) -> None:
        for c in some:
            at = self.postings[c[2]][0]
            c[1] = bisect_left(at, target, c[1])
            if c[1] == len(at):
                cursors.remove(c)
            else:
                c[0] = at[c[1]]


def common_share(part: list[bytes], passage: list[bytes]) -> float:
    """Length of the longest common subsequence over that of part; 1 for an empty part."""
    if not part:
        return 1.0
    row = np.zeros(len(passage) + 1, np.int32)
    words = np.array(passage, object)
    for w in part:
        step = np.where(words == w, row[:-1] + 1, row[1:]) if len(passage) else row[1:]
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1]) / len(part)


def _open_passages(ids: np.ndarray, starts: np.ndarray, size: int, index: Index) -> list[int]:
    """The passages whose different terms' largest weights, over all items and then over some block of
    items, reach the threshold."""
    none, limit = len(index.bound) - 1, index.s.threshold - 1e-5
    weight = index.bound[ids].astype(np.float64)
    sums = np.concatenate([[0.0], np.cumsum(weight)])
    some = np.flatnonzero(sums[np.minimum(starts + size, len(ids))] - sums[starts] >= limit)
    if not len(some):
        return []
    padded = np.concatenate([ids, np.full(size, none, ids.dtype)])
    rows = np.sort(padded[starts[some][:, None] + np.arange(size)], axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
    near = index.bound[rows].sum(axis=1) >= limit
    some, rows = some[near], rows[near]
    out = []
    ptr, at, most = np.frombuffer(index.block_ptr, np.int64), np.frombuffer(index.block_at, np.int32), np.frombuffer(index.block_max)
    step = max(1, min(64, (4 << 20) // (size * index.n_blocks)))  # bounds what is unrolled at once
    for a in range(0, len(some), step):
        part = rows[a : a + step]
        known = part != none
        t, counts = part[known], ptr[part[known] + 1] - ptr[part[known]]
        flat = np.repeat(ptr[t] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        keys = np.repeat(np.nonzero(known)[0], counts) * index.n_blocks + at[flat]
        reach = np.bincount(keys, most[flat], len(part) * index.n_blocks).reshape(len(part), -1).max(axis=1) >= limit
        out += some[a : a + step][reach].tolist()
    return out


def document_hits(text: bytes | None, part: list[Index]) -> list[tuple[int, int, float, float, float]]:
    """For each verified item of a document its best passage: item id, start word, score, overlaps."""
    words = terms(text)
    return sorted(x for index in part for x in _class_hits(words, index)) if words else []


def _class_hits(words: list[bytes], index: Index) -> list[tuple[int, int, float, float, float]]:
    s = index.s
    size = passage_words(index.longest, s)
    place, none = index.place, len(index.bound) - 1
    ids = np.array([place.get(w, none) for w in words], np.int32)
    # a passage that ends where the one before did holds nothing new
    starts = np.arange(0, max(1, len(words) - passage_words(index.shortest, s) + s.stride), s.stride)
    best: dict[int, tuple] = {}
    for k in _open_passages(ids, starts, size, index):
        start = int(starts[k])
        for item, score in index.search(set(words[start : start + size])):
            item_id, question, answer = index.items[item]
            own = words[start : start + passage_words(len(question) + len(answer), s)]
            score = index.score(item, set(own))
            if score < s.threshold - 1e-12 or (item in best and score <= best[item][2]):
                continue
            found = (item_id, start, score, common_share(question, own), common_share(answer, own))
            if found[3] >= s.question_share and found[4] >= s.answer_share:
                best[item] = found
    return list(best.values())


def _split(row) -> tuple[int, list[bytes], list[bytes]]:
    """Item id, question and answer terms; without an answer the whole text is the question."""
    return row["item_id"], *(terms(row[c].encode()) if row[c] else [] for c in ("question", "answer"))


def built(items: list[Item], stats: Stats, s: Settings) -> list[bytes]:
    """Pickled parts of some items, each an index for every class of lengths; one over index_bytes is halved."""
    part = [Index(x, s, stats) for x in length_classes(items, s)]
    if len(items) == 1 or sum(x.nbytes() for x in part) <= s.index_bytes:
        return [pickle.dumps(part)]
    del part
    items = sorted(items, key=lambda x: len(x[1]) + len(x[2]))
    return [p for half in (items[: len(items) // 2], items[len(items) // 2 :]) for p in built(half, stats, s)]


class Parts:
    """The parts of an index in the shared folder; each is fetched when its turn comes."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = spark.read.schema("k int, part binary, cut int").parquet(path)
        self.keys = sorted(tuple(r) for r in self.table.select("cut", "k").collect())

    def __len__(self) -> int:
        return len(self.keys)

    def __iter__(self) -> Iterator[list[Index]]:
        for cut, k in self.keys:
            yield pickle.loads(self.table.where((F.col("cut") == cut) & (F.col("k") == k)).select("part").first()[0])


def indexes(benchmark: DataFrame, s: Settings = Settings()) -> Parts | list:
    """The benchmark's items as parts of bounded size; a column `answer` is used if there is one."""
    spark = benchmark.sparkSession
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").alias("question"), answer.alias("answer")).where("item_id IS NOT NULL AND question IS NOT NULL")
    size = F.octet_length("question") + F.coalesce(F.octet_length("answer"), F.lit(0))
    total = rows.agg(F.sum(size)).first()[0] or 0
    if not total:
        return []
    # a first guess of the parts, each built in one task: an index takes some times the bytes of its texts
    cuts = -(-total * 8 // s.index_bytes)
    rows = stored(rows.withColumn("cut", F.pmod(F.monotonically_increasing_id(), F.lit(cuts)).cast("int")), "benchmark-items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for r in batch.to_pylist():
                _, q, a = _split(r)
                if q or a:
                    found.update({(r["cut"], t, 0) for t in {*q, *a}})
                    found[r["cut"], None, 0] += 1
                    found[r["cut"], None, 1] += len(q) + len(a)
            # the rows without a term: 0 counts items, 1 their words
            columns = list(zip(*((c, t, k, n) for (c, t, k), n in found.items()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.int32(), pa.binary(), pa.int32(), pa.int64()))], names=["cut", "term", "kind", "n"])

    counts = stored(rows.mapInArrow(count, "cut int, term binary, kind int, n long").groupBy("cut", "term", "kind").agg(F.sum("n").alias("n")), "benchmark-terms")
    whole = {r["kind"]: r["n"] for r in counts.where("term IS NULL").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    if not whole:
        return []
    known = counts.where("term IS NOT NULL")
    df = known.select("cut", "term").join(known.groupBy("term").agg(F.sum("n").alias("df")), "term")
    n, mean = whole[0], whole[1] / whole[0]

    def build(key, items: pa.Table, terms_: pa.Table) -> pa.Table:
        stats = Stats(n, mean, dict(zip(terms_["term"].to_pylist(), terms_["df"].to_pylist())))
        found = [x for x in map(_split, items.to_pylist()) if x[1] or x[2]]
        parts = built(sorted(found), stats, s) if found else []
        kinds = (pa.int32(), pa.binary(), pa.int32())
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip((range(len(parts)), parts, [key[0].as_py()] * len(parts)), kinds)], names=["k", "part", "cut"])

    path = shared_path(spark, "benchmark-index")
    rows.groupBy("cut").cogroup(df.groupBy("cut")).applyInArrow(build, "k int, part binary, cut int").write.partitionBy("cut").parquet(path)
    return Parts(spark, path)


def hits(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, passage_start, score, question_overlap, answer_overlap) of all verified hits."""
    spark, paths, parts = docs.sparkSession, [], indexes(benchmark, s)
    for part in parts:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))) for x in document_hits(t, shared.value)]
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", *(x.split()[0] for x in HITS.split(", "))])

        one = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {HITS}")
        if len(parts) == 1:
            return one
        paths.append(shared_path(spark, "contaminated"))
        one.write.parquet(paths[-1])
        shared.destroy()
    return spark.read.schema(f"doc_id long, {HITS}").parquet(*paths) if paths else spark.createDataFrame([], f"doc_id long, {HITS}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents without a verified hit, with all their columns. With one part of the index rows are judged one
    by one, without a join; with more, the texts with hits are known by their SHA-256 and joined away."""
    names, at, parts = docs.columns, docs.columns.index("text"), indexes(benchmark, s)
    spark, paths = docs.sparkSession, []
    for part in parts:
        shared = spark.sparkContext.broadcast(part)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in text_parts(batch.column(at), 1 << 20):
                    yield batch.slice(part.start, len(texts)).filter(pa.array([not document_hits(t, shared.value) for t in texts], pa.bool_())).rename_columns(names)

        def digests(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t).digest() for t in as_bytes(batch.column(0)) if document_hits(t, shared.value)], pa.binary())], names=["digest"])

        if len(parts) == 1:
            return in_arrow(docs, keep, docs.schema)
        paths.append(shared_path(spark, "contaminated"))
        docs.select("text").mapInArrow(digests, "digest binary").write.parquet(paths[-1])
        shared.destroy()
    if not paths:
        return docs
    found = spark.read.schema("digest binary").parquet(*paths).distinct()
    return docs.join(found, F.unhex(F.sha2(col("text").cast("binary"), 256)) == found["digest"], "left_anti")
