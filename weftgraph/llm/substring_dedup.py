"""Substring deduplication by compaction of a de Bruijn graph of word k-mers.

The windows of `window` consecutive words are the graph's edges. Every window belongs to the smallest hash
among the `anchor`-word k-mers in it, so equal windows belong to equal anchors wherever they stand. The
consecutive windows of a document with one anchor form an unbranched path and are compacted to one piece
with one hash. Spark joins then work on pieces, about a twentieth of the words:

1. pieces whose anchor occurs in one document only can't repeat; a join drops them;
2. equal pieces (same anchor, same words) are one class; its first document is the source;
3. an anchor with several classes is a branch: there, and only there, the pieces of each class in its first
   document are expanded to their windows, read again from their source coordinates, and the windows are matched;
4. repeated pieces and windows that follow each other in a document and in their source alike are compacted to
   one path; the words of each path are read again at its own and at its source's coordinates and compared.

A window is a repeat if a document with a smaller id has it too; words that repeats cover are removed. Pieces
meet by 64-bit hashes that are built on 64-bit hashes of words; what the comparison by 128-bit digests of the
words themselves doesn't confirm is no repeat.

Defined cases: a null text has no words and stays null; texts of fewer than `window` words lose nothing;
rows with a null id count as after all others; rows with equal ids count as one document (they don't remove
from each other); an empty table gives no rows. Other columns pass through, but for those named like a
result column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, col, fields, in_arrow, others, stored, text_parts
from .suffix_repeats import covered

#: Odd bases of the two polynomial hashes, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LAST = 2**63 - 1  # stands for a null id
SPANS = 65_536  # of one text that are read in one go
CHUNK = 1 << 20  # bytes of text that a task holds as words
MEMORY = 100_000  # words whose hashes a worker keeps


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHashes()


def _word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    claim("words", _hashes.clear)
    if len(_hashes) > MEMORY:
        _hashes.clear()
    parts = []
    for t in texts:
        words = t.split() if t else []
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """Hashes of any stretch of words: sum of h[i] * base**i, shifted back to the stretch's start."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        up, down = self._powers.get(base, (np.ones(0, np.uint64),) * 2)
        if len(up) <= n:
            size = 1 << max(16, n.bit_length())
            up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
            self._powers[base] = up, down
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n])])
        self.down = down

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _slide_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def pieces_of(texts: list[bytes | None], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Row, start, count of windows, anchor and hash of each piece; signed 64 bits."""
    words, counts = _word_hashes(texts)
    empty = np.zeros(0, np.int64)
    if len(words) < window:
        return (empty,) * 5
    first = np.cumsum(counts) - counts
    kmers = _Rolling(words, BASES[0]).of(np.arange(len(words) - anchor + 1), np.arange(anchor, len(words) + 1))
    least = _slide_min(kmers, window - anchor + 1)
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    if not len(row):
        return (empty,) * 5
    n = np.bincount(row, minlength=len(counts))
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]  # places of the windows
    value = least[at]
    head = np.ones(len(at), bool)
    head[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(at)))
    start = at[begin]
    code = _mix(_Rolling(words, BASES[1]).of(start, start + size + window - 1) ^ size.astype(np.uint64))
    return row[begin], start - first[row[begin]], size, value[begin].view(np.int64), code.view(np.int64)


def _pieces(docs: DataFrame, window: int, anchor: int, chunk_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row_hash = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for part, texts in text_parts(batch.column(2), chunk_bytes):
                row, start, size, value, code = pieces_of(texts, window, anchor)
                row = row + part.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (value, code, doc[row], row_hash[row], start.astype(np.int32), size.astype(np.int32))],
                    names=["anchor", "code", "doc", "row", "start", "size"],
                )

    return docs.mapInArrow(run, "anchor long, code long, doc long, row long, start int, size int")


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, pa.Scalar]]:
    """Place, text (column 2) and list (column 3) of each row."""
    for part, texts in text_parts(batch.column(2), CHUNK):
        for i, text in enumerate(texts, part.start):
            yield i, text, batch.column(3)[i]


def _windows(pieces: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The windows of pieces, hashed from their source texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, wanted in _asked(batch):
                words, _ = _word_hashes([text])
                start, size, value = (wanted.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                at = np.repeat(start.astype(np.int64), size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                code = _Rolling(words, BASES[1]).of(at, at + window)
                same = np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.repeat(value, size), code.view(np.int64), same + batch.column(0)[i].as_py(), same + batch.column(1)[i].as_py(), at.astype(np.int32))],
                    names=["anchor", "code", "doc", "row", "start"],
                )

    by_doc = pieces.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "size", "anchor")).alias("wanted"))
    return docs.join(by_doc, ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(run, "anchor long, code long, doc long, row long, start int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row"), "text")


def _digests(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, row, start, n, digest): 128-bit digests of the words of spans, read from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, wanted in _asked(batch):
                words = text.split()
                start, n = (wanted.values.field(k) for k in range(2))
                found = [xxhash.xxh3_128_digest(b" ".join(words[a : a + k])) for a, k in zip(start.to_pylist(), n.to_pylist())]
                same = np.zeros(len(found), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same + batch.column(0)[i].as_py()), pa.array(same + batch.column(1)[i].as_py()), start, n, pa.array(found, pa.binary())], names=["doc", "row", "start", "n", "digest"]
                )

    # different spans of one text, at most SPANS in a list: a text that many documents repeat has very many
    number = F.row_number().over(Window.partitionBy("doc", "row").orderBy("start", "n"))
    by_doc = spans.withColumn("_part", F.floor(number / SPANS)).groupBy("doc", "row", "_part").agg(F.collect_list(F.struct("start", "n")).alias("wanted")).drop("_part")
    return docs.join(by_doc, ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(run, "doc long, row long, start int, n int, digest binary")


def _paths(marks: DataFrame, window: int) -> DataFrame:
    """Marks (doc, row, start, size, source) that follow each other in their document and in one source alike, as one."""
    shift = F.col("start") - F.col("source.start")
    keys = ["doc", "row", "s_doc", "s_row", "shift"]
    rows = marks.select("doc", "row", "start", "size", F.col("source.doc").alias("s_doc"), F.col("source.row").alias("s_row"), shift.alias("shift"))
    by = Window.partitionBy(*keys).orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("_end"))
    return found.select("doc", "row", "start", (F.col("_end") - F.col("start")).alias("size"), "s_doc", "s_row", (F.col("start") - F.col("shift")).alias("s_start"), (F.col("_end") - F.col("start") + (window - 1)).alias("n"))


def repeats(docs: DataFrame, window: int = 50, anchor: int = 12, chunk_bytes: int = CHUNK) -> DataFrame:
    """Paths of repeated windows: (doc, row, start, size), row being the hash of the text."""
    keyed = _keyed(docs)
    pieces = stored(_pieces(keyed, window, anchor, chunk_bytes), "pieces")
    shared = pieces.groupBy("anchor").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).where("_a < _b").select("anchor")
    shared = stored(pieces.join(shared, "anchor", "left_semi"), "shared-pieces")
    classes = stored(shared.groupBy("anchor", "code").agg(F.min(F.struct("doc", "row", "start", "size")).alias("source")), "classes")
    # stored, so that the joins below are of plain tables, whose hot keys can be split
    branches = stored(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor"), "branches")
    first = stored(classes.join(branches, "anchor", "left_semi").select("anchor", "code", F.col("source.doc").alias("doc")), "branch-classes")
    heads = shared.join(first, ["anchor", "code", "doc"]).select("anchor", "doc", "row", "start", "size")  # a document may hold its class more than once
    windows = stored(_windows(heads, keyed, window), "windows")
    earliest = stored(windows.groupBy("anchor", "code").agg(F.min(F.struct("doc", "row", "start")).alias("source")), "earliest")
    source = F.struct("source.doc", "source.row", "source.start").alias("source")
    whole = shared.join(classes.select("anchor", "code", source), ["anchor", "code"]).where("source.doc < doc")
    single = windows.join(earliest, ["anchor", "code"]).where("source.doc < doc").withColumn("size", F.lit(1))
    marks = whole.select("doc", "row", "start", "size", "source").unionByName(single.select("doc", "row", "start", "size", "source"))
    paths = stored(_paths(marks, window), "paths")
    own, there = paths.select("doc", "row", "start", "n"), paths.select(F.col("s_doc").alias("doc"), F.col("s_row").alias("row"), F.col("s_start").alias("start"), "n")
    digests = stored(_digests(own.unionByName(there).distinct(), keyed).distinct(), "digests")
    checked = paths.join(digests, ["doc", "row", "start", "n"]).join(digests.toDF("s_doc", "s_row", "s_start", "n", "_digest"), ["s_doc", "s_row", "s_start", "n"])
    return checked.where("digest = _digest").select("doc", "row", "start", "size")


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = 12, chunk_bytes: int = CHUNK) -> DataFrame:
    """docs with the repeated words out of `text`, and the columns n_words, n_removed and kept_sha256.

    A text that loses words becomes its other words joined by one space; the others stay as they are.
    kept_sha256 is that of the kept words joined by one space.
    """
    added = ("n_words", "n_removed", "kept_sha256")
    names = others(docs, *added)
    at = names.index("text")
    marks = repeats(docs, window, anchor, chunk_bytes).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "size")).alias("_marks"))
    keyed = docs.select(F.struct(*map(col, names)).alias("_rec"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row"))
    joined = keyed.join(marks, ["doc", "row"], "left").select("_rec.*", "_marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((batch.slice(part.start, len(texts)), texts) for batch in batches for part, texts in text_parts(batch.column(at), CHUNK))
        for batch, texts in parts:
            n_words, n_removed, digest = [], [], []
            for i, (text, marks) in enumerate(zip(texts, batch.column(len(names)))):
                words = text.split() if text else []
                n_words.append(len(words))
                if marks.is_valid:
                    start, size = (marks.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    gone = covered(len(words), start, size + window - 1)
                    words = [w for w, out in zip(words, gone.tolist()) if not out]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                if n_removed[-1]:
                    texts[i] = kept
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)], names=[*names, *added])

    return in_arrow(joined, run, f"{fields(docs, names)}, n_words long, n_removed long, kept_sha256 string")
