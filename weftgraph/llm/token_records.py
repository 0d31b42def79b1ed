"""Token ids as length-delimited binary records with a separate offset index.

A file is a run of frames, ascending in (doc_id, text); from file to file, texts of one id that begin alike may go
by a hash:

    u64 payload length | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of it | 0x0A
    payload: u8 flags (1: the id is null) | i64 doc_id | u8 bytes an id (2 or 4) | ids, little-endian

The checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum stored beside data that
holds checksums stays sound. Spark's own text sink writes the frames (its line end is the closing byte), so
files reach any store that Spark can write, through its commit protocol. The index holds the file, offset
and length of every frame as Parquet; `read_shuffled` follows it in any order.

Defined cases: a null text counts as empty and gives the end id alone; null ids come first; repeated rows
give repeated records; an empty table gives no files and an empty index; only the id and the text column are
read. A wrong checksum raises an error.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, chunks, claim, shared_path

MASK_DELTA = 0xA282EAD8
#: The pre-tokens of lower-case printable ASCII words: fixed by the tokenizer's file.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Letters with ASCII marks around them; an apostrophe before them could begin a contraction, and letters that
#: become a letter and a mark when they are normalized could draw marks behind them to their own.
MARKED = re.compile(r"([!-&(-/:-@\[-`{-~]*)([^\W\d_]+)([!-/:-@\[-`{-~]*)")
#: What the tokenizer's added tokens begin with; they are matched before all else.
ADDED = "<|"
#: What a tokenizer's file must say for the two patterns above to hold: its normalizers, pre-tokenizers, and the end of a word.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<BqB")
INDEX = "file string, offset long, length long, doc_id long, before long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without the closing byte, which the sink writes."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    payload = BODY.pack(doc_id is None, doc_id or 0, 4 if wide else 2) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def frames(content: bytes, offset: int = 0, most: int | None = None) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Offset, length, id and token ids of the frames from an offset on."""
    while offset < len(content) and most != 0:
        size, check = HEAD.unpack_from(content, offset)
        if masked(content[offset : offset + 8]) != check:
            raise ValueError(f"wrong checksum of a length at {offset}")
        at = offset + HEAD.size
        payload = content[at : at + size]
        if struct.unpack_from("<I", content, at + size)[0] != masked(payload):
            raise ValueError(f"wrong checksum of a payload at {at}")
        null, doc_id, width = BODY.unpack_from(payload)
        length = HEAD.size + size + 5
        yield offset, length, None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=BODY.size).astype("<u4")
        offset, most = offset + length, most and most - 1


class _Numbers(dict):
    """Numbers in order of first appearance; `new` lists the keys that came since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class _Ragged:
    """Rows of ids that only grow."""

    def __init__(self):
        self.flat, self.ends = array("I"), array("q", [0])

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        last = self.ends[-1]
        self.flat.frombytes(ids.astype(np.uint32, copy=False).tobytes())
        self.ends.frombytes((last + np.cumsum(sizes, dtype=np.int64)).tobytes())

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some rows one after the other, and where each row ends in them."""
        ends = np.frombuffer(self.ends, np.int64)
        size = np.diff(ends)[rows]
        after = np.cumsum(size)
        if not len(after) or not after[-1]:
            return np.zeros(0, np.uint32), after
        place = np.repeat(ends[:-1][rows] - after + size, size)
        place += np.arange(len(place))
        return np.frombuffer(self.flat, np.uint32)[place], after


def check_tokenizer(path: str) -> None:
    """Raises an error if a tokenizer's file isn't of the kind that WordEncoder cuts words for."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
    cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = cuts[0] if cuts else {}
    sound = {
        "normalizer": steps == NORMALIZERS,
        "pre-tokenizer": [x["type"] for x in cuts] == ["Split", "ByteLevel"] and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": SPLIT}, "Removed", True) and not cuts[1]["add_prefix_space"],
        "model": (told["model"]["type"], told["model"].get("end_of_word_suffix"), told["model"].get("dropout")) == ("BPE", WORD_END, None),
        "added tokens": all(x["content"].startswith(ADDED) for x in told["added_tokens"]),
    }
    if not all(sound.values()):
        raise ValueError(f"{path}: not a tokenizer that this encoder is made for: {', '.join(k for k, ok in sound.items() if not ok)}")


class WordEncoder:
    """Token ids of whole texts with each different pre-token encoded once.

    A word here ends at ASCII white space. Pre-tokens of this tokenizer never hold white space, and its
    normalizer doesn't look across it, so a text's ids are those of its words in a row. Printable ASCII words
    are cut into lower-case pre-tokens here (so is a letter word with ASCII marks around it); many of them go
    through the model in one string, in which the ends of pre-tokens show as tokens with the word end. Where
    that isn't sure, the library gets the word alone. Words are dropped at `most` of them; pre-tokens, which are
    fewer and cost more, at twice as many.
    """

    def __init__(self, path: str, most: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        check_tokenizer(path)
        self.tokenizer, self.plain, self.most = Tokenizer.from_file(path), Tokenizer.from_file(path), most
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(self.tokenizer.get_vocab_size(True), bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.word_ids = _Numbers(), _Ragged()
        self.units, self.unit_ids = _Numbers(), _Ragged()

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _joined(self, tokenizer, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of one pre-token each, from one string; if the ends don't tally, from the units alone."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(units) or ends[-1] != len(ids):
            return self._alone(units)
        return ids, np.diff(ends, prepend=0)

    def _learn_units(self) -> None:
        new, self.units.new = self.units.new, []
        for i in range(0, len(new), 2048):
            part = new[i : i + 2048]
            kind = np.array([0 if x.isascii() and x.isprintable() and ADDED not in x else 1 if x.isalpha() else 2 for x in part])
            ids, sizes = [np.zeros(0, np.uint32)], np.zeros(len(part), np.int64)
            for k, encode in enumerate((lambda x: self._joined(self.plain, x), lambda x: self._joined(self.tokenizer, x), self._alone)):
                at = np.flatnonzero(kind == k)
                if len(at):
                    found, sizes[at] = encode([part[j] for j in at])
                    ids.append(found)
            order = np.argsort(kind, kind="stable")  # the ids stand in this order
            held = _Ragged()
            held.extend(np.concatenate(ids), sizes[order])
            back = np.empty(len(part), np.int64)
            back[order] = np.arange(len(part))
            self.unit_ids.extend(held.gather(back)[0], sizes)

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        units, counts = [], []
        for w in b"\n".join(new).decode("utf-8", "replace").split("\n"):
            if w.isalpha():
                w = w.lower() if w.isascii() else w
            elif w.isascii() and w.isprintable() and ADDED not in w:
                parts = PRE_TOKENS.findall(w.lower())
                units += parts
                counts.append(len(parts))
                continue
            else:
                m = MARKED.fullmatch(w)
                if m and ADDED not in w and unicodedata.normalize("NFC", m[2]).lower().isalpha():
                    parts = [x for x in m.groups() if x]
                    units += parts
                    counts.append(len(parts))
                    continue
            units.append(w)
            counts.append(1)
        place = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        self._learn_units()
        ids, after = self.unit_ids.gather(place)
        self.word_ids.extend(ids, np.diff(after[np.cumsum(counts) - 1], prepend=0))

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the count of each text."""
        if len(self.words) > self.most:
            self.words, self.word_ids = _Numbers(), _Ragged()
        if len(self.units) > 2 * self.most:
            self.units, self.unit_ids = _Numbers(), _Ragged()
        number, parts = self.words.__getitem__, []
        for t in texts:
            words = t.split() if t else []
            parts.append(np.fromiter(map(number, words), np.int64, len(words)))
        if self.words.new:
            self._learn()
        ids, after = self.word_ids.gather(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        upto = np.concatenate([[0], after])[np.cumsum([len(p) for p in parts], dtype=np.int64)]
        return ids, np.diff(upto, prepend=0)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    claim(f"encoder {path}", _encoders[path].clear)
    return _encoders[path]


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, chunk_bytes: int = 4 << 20, file_bytes: int = 128 << 20) -> str:
    """Encodes every text and writes the frames in ascending doc_id order; returns the folder.

    There are as many ranges of rows as make about `file_bytes` of text each, so that a file is read in one piece. Rows of
    one id (or without one) are dealt to ranges too, by how their texts begin, a hash, and where they were read."""
    path = path or shared_path(docs.sparkSession, "records")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(-(-total // file_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for part in chunks(texts, chunk_bytes):
                ids, counts = encode(texts[part])
                ends, out = np.cumsum(counts), []
                for doc_id, n, end in zip(batch.column(0)[part.start : part.stop].to_pylist(), counts, ends):
                    out.append(frame(doc_id, np.append(ids[end - n : end], np.uint32(end_id))))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    placed = docs.select(F.col("doc_id").cast("long"), "text").withColumns({"_p": F.substring("text", 1, 16), "_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(ranges, "doc_id", "_p", "_h", "_n").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", 65_536).text(path)
    return path


def write_index(spark: SparkSession, path: str, index_path: str | None = None) -> str:
    """Scans the files once, checks all checksums and writes the offset index."""
    index_path = index_path or f"{path}-index"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, before = [], 0
                for offset, length, doc_id, ids in frames(content.as_py()):
                    rows.append((file, offset, length, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    content.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content").mapInArrow(run, INDEX).write.parquet(index_path)
    return index_path


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    """The index with `start`, the count of ids of all records before in the whole data set."""
    index = spark.read.schema(INDEX).parquet(index_path)
    # part-<partition>-<job>-c<file of the partition>: numbers of more digits are no longer in order as text
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    by_name = Window.orderBy(number(r"^part-([0-9]+)"), number(r"-c([0-9]+)"), "file")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("_n")).select("file", (F.sum("_n").over(by_name) - F.col("_n")).alias("_start"))
    return index.join(files, "file").withColumn("start", F.col("_start") + F.col("before")).drop("_start")


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """The records that the index rows name: doc_id and ids, once each.

    Files are read where they lie. Up to most_bytes of wanted offsets (24 bytes each) go to the scan, which decodes the
    frames at these offsets and no other; of more, all frames are decoded and meet the offsets in a semi-join."""
    wanted = index.select("file", "offset").distinct()
    few = wanted.count() * 24 <= most_bytes

    def rows(file: str, found: list) -> pa.RecordBatch:
        ids = pa.array([x[3] for x in found], pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), ids], names=["file", "offset", "doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, file in enumerate(batch.column(0).to_pylist()):
                content = batch.column(1)[k].as_py()
                records = itertools.chain.from_iterable(frames(content, at, 1) for at in batch.column(2)[k].as_py()) if few else frames(content)
                while found := list(itertools.islice(records, 4096)):
                    yield rows(file, found)

    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    content = content.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    schema = "file string, offset long, doc_id long, ids array<long>"
    if few:
        offsets = wanted.groupBy("file").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))
        return content.join(F.broadcast(offsets), "file").select("file", "content", "offsets").mapInArrow(run, schema).select("doc_id", "ids")
    return content.mapInArrow(run, schema).join(wanted, ["file", "offset"], "left_semi").select("doc_id", "ids")
