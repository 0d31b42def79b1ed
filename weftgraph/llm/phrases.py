"""Phrase collocations by levels: a minimal perfect hash over Apriori-safe candidates, counts in numpy arrays.

1. Texts become blocks of word numbers, with the block's own words and their counts. Word counts give the words
   of `least` occurrences or more, the phrases of level 1.
2. A phrase of k words is exactly the pair of its first and its last k - 1 words, so its key is the pair of their
   slots in one 64-bit number. Mappers take the keys whose two parts are candidates of level k - 1, count them by
   key and send them, dealt by a hash, to bins; a bin adds the counts up in an array of cells, and the keys of
   cells with `least` or more are the candidates: no phrase of `least` occurrences can be missing.
3. The candidates get slots by a minimal perfect hash, which stores its keys to tell strangers. Mappers look up
   their places, bincount the slots, and the arrays are summed as a tree. Places and slots are the next level's input.
4. Each phrase carries the counts of all its beginnings and endings, read by slot; so every cut is at hand.

Memory: a perfect hash holds `most_keys` keys at most, 2^20; more candidates are several hashes and as many passes
over the (by then much smaller) places of the level before. Blocks, bins and row groups are bounded as well. Word hashes are
compared with their words: a frequent word that shares its hash with another one sends the run to another seed.

Defined cases: null texts are empty and have no words; a null lang is `und`, together with documents so marked;
repeated rows count each time; other columns are not looked at; an empty table gives no rows; equal scores go by
count, then by the bytes of the phrase; a phrase that is repeated within itself counts at every place.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, shared_path, stored
from .substring_dedup import _mix

#: A-Z become a-z, and every mark that ends a piece becomes a full stop.
MARKS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
CELLS = 1 << 20
#: Blocks in a row group of the files.
GROUP_ROWS = 4


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words, with a full stop between pieces (a word can't hold one)."""
    return text.translate(MARKS).replace(b".", b" . ").split()


class MinimalHash:
    """Distinct 64-bit keys to the slots 0 to n - 1. Keys that fall on a bit alone take it, the others go to the
    next array of bits; a slot is the number of bits set before. Stored keys tell which keys aren't there."""

    def __init__(self, keys: np.ndarray):
        self.levels, left, before = [], np.asarray(keys, np.uint64), 0
        self.keys = np.zeros(len(left), np.uint64)
        while len(left):
            size = 1 << max(6, (3 * len(left) // 2).bit_length())
            seed = np.uint64(len(self.levels) + 1)
            at = _mix(left * np.uint64(2) + seed) & np.uint64(size - 1)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(bits))[:-1]]).astype(np.int64)
            self.levels.append((seed, np.uint64(size - 1), bits, ranks))
            own = alone[at.astype(np.int64)]
            self.keys[self._rank(bits, ranks, at[own])] = left[own]
            before += int(own.sum())
            left = left[~own]

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> np.uint64(6)
        below = (np.uint64(1) << (at & np.uint64(63))) - np.uint64(1)
        return ranks[word] + np.bitwise_count(bits[word] & below)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for others."""
        keys = np.asarray(keys, np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, mask, bits, ranks in self.levels:
            at = _mix(keys[left] * np.uint64(2) + seed) & mask
            set_ = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            out[left[set_]] = self._rank(bits, ranks, at[set_])
            left = left[~set_]
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1
        return out


def _token_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of about block_bytes of text of one language: the block's words and counts, and its text as numbers of
    these words from 1 on, 0 where a piece or document ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        held: dict = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (known, parts) in held.items():
                tokens = np.concatenate(parts)
                counts = np.bincount(tokens, minlength=len(known))[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(number)], pa.int64()), pa.array([lang], pa.string()), pa.array([list(known)[1:]], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([tokens.tobytes()], pa.binary())],
                    names=["block", "lang", "words", "counts", "tokens"],
                )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if not text:
                    continue
                if lang not in held:
                    known = defaultdict(itertools.count().__next__)
                    known[b"."]  # the number 0
                    held[lang] = known, []
                known, parts = held[lang]
                found = words_of(text)
                found.append(b".")
                parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                size += len(text)
                if size >= block_bytes:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, tokens binary")


def _packed(df: DataFrame, name: str) -> DataFrame:
    """stored(), in a compression that is good at numbers. A row is a block's, of some MB, and Spark reads the rows of a
    row group at once, up to 4,096: so a row group holds few, and memory is the same for files of any length."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ints(cell: pa.BinaryScalar, kind=np.int32) -> np.ndarray:
    return np.frombuffer(cell.as_buffer() or b"", kind)


def _place_row(block: int, places: np.ndarray, slots: np.ndarray) -> pa.RecordBatch:
    """block, n, places (each as its distance from the one before, which compresses to little) and their slots."""
    cells = (np.diff(places, prepend=0), slots)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(places)], pa.int64()), *(pa.array([c.astype(np.int32).tobytes()], pa.binary()) for c in cells)], names=["block", "n", "places", "slots"])


PLACES = "block long, n long, places binary, slots binary"


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places and slots of each block; rows of a block, from several hashes, follow each other."""
    block, places, slots = None, [], []
    for batch in batches:
        for k in range(batch.num_rows):
            b = batch.column(0)[k].as_py()
            if b != block and places:
                yield block, np.concatenate(places), np.concatenate(slots)
                places, slots = [], []
            block = b
            places.append(np.cumsum(_ints(batch.column(2)[k]), dtype=np.int32))
            slots.append(_ints(batch.column(3)[k]))
    if places:
        yield block, np.concatenate(places), np.concatenate(slots)


def _pairs(places: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a phrase of the next level stands, and its key: the slots of its beginning and its ending."""
    if (places[1:] < places[:-1]).any():  # several hashes, one after the other
        order = np.argsort(places, kind="stable")
        places, slots = places[order], slots[order]
    at = np.flatnonzero(places[1:] == places[:-1] + 1)
    return places[at], (slots[at].astype(np.uint64) << np.uint64(32)) | slots[at + 1].astype(np.uint64)


def _candidates(level: DataFrame, least: int, bin_keys: int) -> DataFrame:
    """The keys of the next level that stand in cells of `least` occurrences or more."""
    bins = max(1, -(-(level.agg(F.sum("n")).first()[0] or 0) // bin_keys))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            to = (_mix(keys) % np.uint64(bins)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            keys, counts, ends = keys[order], counts[order].astype(np.int32), np.searchsorted(to[order], np.arange(bins + 1))
            some = [b for b in range(bins) if ends[b] < ends[b + 1]]
            # a bin's keys rise, so their upper halves are sent as distances
            upper, lower = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
            parts = [(np.diff(upper[a:b], prepend=np.uint32(0)), lower[a:b], counts[a:b]) for a, b in zip(ends[some], ends[np.array(some) + 1])]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array([x[k].tobytes() for x in parts], pa.binary()) for k in range(3))], names=["bin", "upper", "lower", "counts"])

        for _, places, slots in _whole_blocks(batches):
            held.append(_pairs(places, slots)[1])
            size += len(held[-1])
            if size >= bin_keys:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def hot() -> pa.RecordBatch:
            keys, counts = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            cell = (_mix(keys ^ np.uint64(bins)) & np.uint64(CELLS - 1)).astype(np.int64)
            cells = np.bincount(cell, weights=counts, minlength=CELLS)
            return pa.RecordBatch.from_arrays([pa.array(np.unique(keys[cells[cell] >= least]).view(np.int64))], names=["key"])

        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.column(0)[k].as_py()
                if b != now and held:
                    yield hot()
                    held = []
                now = b
                upper = np.cumsum(_ints(batch.column(1)[k], np.uint32), dtype=np.uint32)
                held.append((upper.astype(np.uint64) << np.uint64(32) | _ints(batch.column(2)[k], np.uint32), _ints(batch.column(3)[k])))
        if held:
            yield hot()

    sent = level.mapInArrow(send, "bin long, upper binary, lower binary, counts binary")
    return sent.repartition(bins, "bin").sortWithinPartitions("bin").mapInArrow(add, "key long")


def _hash_parts(keys: DataFrame, most_keys: int) -> Iterator[tuple[int, MinimalHash]]:
    """(first slot, hash) for each part of the keys; a part has most_keys keys at most."""
    parts = max(1, -(-2 * keys.count() // most_keys)) if most_keys < 1 << 16 else max(1, -(-keys.count() * 17 // (16 * most_keys)))
    first = 0
    for p in range(parts):
        mine = keys if parts == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == p)
        found = MinimalHash(mine.toArrow().column("key").to_numpy().view(np.uint64))
        yield first, found
        first += len(found.keys)


def _summed(hits: DataFrame, first: int, size: int) -> np.ndarray:
    """The number of places of each slot: every mapper counts into an array, the arrays are summed as a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.bincount(_ints(cell) - first, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    rows = hits.select("slots").mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return rows.treeReduce(np.add) if rows.getNumPartitions() else np.zeros(size, np.int64)


def _level_one(words: DataFrame, blocks: DataFrame, seed: int, most_keys: int) -> tuple[DataFrame, DataFrame]:
    """Words of level 1 with their slots, and their places."""
    spark = blocks.sparkSession
    marked = blocks.select("block", F.expr(f"transform(words, w -> xxhash64({seed}, lang, w))").alias("keys"), "tokens")
    placed, numbered = [], []
    for first, found in _hash_parts(words.select("key"), most_keys):
        shared = spark.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch], first: int = first, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    keys = batch.column(1)[k].values.to_numpy().view(np.uint64)
                    slots = np.concatenate([[-1], shared.value.slots(keys)])
                    slots = slots[_ints(batch.column(2)[k])]
                    places = np.flatnonzero(slots >= 0)
                    yield _place_row(batch.column(0)[k].as_py(), places, slots[places] + first)

        placed.append(_packed(marked.mapInArrow(run, PLACES), "places-1"))
        numbered.append(_table(spark, found.keys.view(np.int64), first))
        shared.unpersist()
    return words.join(stored(_all(numbered), "slots-1"), "key").select("slot", "lang", "word", "f"), _together(placed)


def _table(spark, keys: np.ndarray, first: int, f: np.ndarray | None = None) -> DataFrame:
    """(key, slot, f) of one hash: most_keys rows at most."""
    columns = {"key": pa.array(keys), "slot": pa.array(np.arange(first, first + len(keys)))} | ({} if f is None else {"f": pa.array(f)})
    return spark.createDataFrame(pa.table(columns), ", ".join(f"{c} long" for c in columns))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _together(placed: list[DataFrame]) -> DataFrame:
    """One row after the other for each block; a single hash has made whole blocks already."""
    return placed[0] if len(placed) == 1 else _packed(_all(placed).repartition("block").sortWithinPartitions("block"), "places")


def _next_level(level: DataFrame, least: int, most_keys: int, bin_keys: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(slot, prefix, suffix, f) of the phrases one word longer, and the places of the candidates."""
    spark = level.sparkSession
    keys = stored(_candidates(level, least, bin_keys), f"candidates-{name}")
    placed, numbered = [], []
    for first, found in _hash_parts(keys, most_keys):
        shared = spark.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch], first: int = first, shared=shared) -> Iterator[pa.RecordBatch]:
            for block, places, slots in _whole_blocks(batches):
                at, pairs = _pairs(places, slots)
                new = shared.value.slots(pairs)
                yield _place_row(block, at[new >= 0], new[new >= 0] + first)

        placed.append(_packed(level.mapInArrow(run, PLACES), f"places-{name}"))
        sums = _summed(placed[-1], first, len(found.keys))
        numbered.append(_table(spark, found.keys.view(np.int64), first, sums))
        shared.unpersist()
    parts = _all(numbered).where(F.col("f") >= least)
    table = parts.select("slot", F.shiftrightunsigned("key", 32).alias("prefix"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("suffix"), "f")
    return stored(table, f"phrases-{name}"), _together(placed)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, block_bytes: int = 3 << 20, most_keys: int = 1 << 20, bin_keys: int = 1 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` phrases of 2 to `longest` words."""
    blocks = _packed(_token_blocks(docs, block_bytes), "token-blocks")
    for seed in range(1, 9):
        exploded = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
        counts = stored(exploded.groupBy("lang", "word").agg(F.sum("f").alias("f")).withColumn("key", F.xxhash64(F.lit(seed), "lang", "word")), "words")
        clash = counts.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("f").alias("_f")).where((F.col("_n") > 1) & (F.col("_f") >= least))
        if clash.isEmpty():
            break
    else:
        raise RuntimeError("frequent words share their hashes under every seed")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words, level = _level_one(counts.where(F.col("f") >= least), blocks, seed, most_keys)
    rows = stored(words.select("slot", "lang", F.col("word").alias("phrase"), F.col("word").alias("_last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails")), "level-1")
    levels = []
    for k in range(2, longest + 1):
        table, level = _next_level(level, least, most_keys, bin_keys, str(k))
        begin = rows.select(F.col("slot").alias("prefix"), "lang", "phrase", "heads")
        end = rows.select(F.col("slot").alias("suffix"), "_last", "tails")
        rows = table.join(begin, "prefix").join(end, "suffix").select(
            "slot", "lang", F.concat_ws(" ", "phrase", "_last").alias("phrase"), "_last", "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"), "prefix", "suffix",
        )
        rows = stored(rows, f"level-{k}")
        levels.append(rows)
    # a phrase inside a longer one of the same count also lies inside one that is a word longer
    own = [low.join(high.select(F.explode(F.array("prefix", "suffix")).alias("slot"), "f"), ["slot", "f"], "left_anti") for low, high in zip(levels, levels[1:])]
    kept = _all([x.select("lang", "phrase", "f", "heads", "tails") for x in [*own, levels[-1]]]).join(totals, "lang")
    score = "CAST(f AS DECIMAL(18,0)) * CAST(1000 * n AS DECIMAL(20,0)) div (CAST(heads[k - 1] AS DECIMAL(18,0)) * CAST(tails[size(tails) - k - 1] AS DECIMAL(18,0)))"
    cut = F.expr(f"array_min(transform(sequence(1, size(heads) - 1), k -> named_struct('score', {score}, 'k', k, 'l', heads[k - 1], 'r', tails[size(tails) - k - 1])))")
    scored = kept.withColumn("_cut", cut).select("lang", "phrase", F.col("f").alias("a"), F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
