"""Edit-aware token counts: a segment tree over each document's pre-tokens.

The leaves are slots of pre-tokens with their characters and tokens; inner nodes hold sums. An edit re-splits
the new text from the last pre-token boundary before it that it can't move, up to the first boundary
after it that stands where an old slot ends: from there on both splits agree, as a pre-token depends on
the text from its start on only. The new pre-tokens go into the first slot touched, the others become empty,
and the sums on their paths to the root are updated.

An edit is (at, drop, put): at a character offset of the current text, that many characters go and a
text comes in their place. Edits apply in the order of the array.

Defined cases: a null text counts as empty; null or empty edits change nothing; offsets beyond the text count
as its end, negative ones as 0; null fields count as 0 or as the empty text; repeated rows give equal results;
an empty table gives no rows; other columns pass
through, but for those named like a result column.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, col, fields, in_arrow, others

EDITS = "array<struct<at:long,drop:long,put:string>>"
SCHEMA = "tokens_before long, tokens_after long, reencoded long, edits_applied int"


class Counter:
    """Token counts of pre-tokens; what is remembered is dropped at `most` entries."""

    def __init__(self, ranks_path: str, pattern: str, most: int = 600_000):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("edits", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split, self.known, self.most = regex.compile(pattern), {}, most

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for x in set(parts).difference(known):
            known[x] = len(self.encoding.encode_ordinary(x))
        return list(map(known.__getitem__, parts))


class CountTree:
    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        parts = counter.split.findall(text)
        self.slots: list[int] = [1] * len(parts)  # pre-tokens in each slot
        self.width = 1 << max(0, len(parts) - 1).bit_length()
        self.chars = self._sums(list(map(len, parts)))
        self.tokens = self._sums(counter.counts(parts))
        self.reencoded = 0

    def _sums(self, leaves: list[int]) -> list[int]:
        level = np.zeros(self.width, np.int64)
        level[: len(leaves)] = leaves
        levels = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            levels.append(level)
        return [0, *np.concatenate(levels[::-1]).tolist()]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _slot_at(self, offset: int) -> tuple[int, int]:
        """The slot that holds the character at an offset, and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if offset >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _put(self, slot: int, chars: int, tokens: int) -> None:
        node = slot + self.width
        dc, dt = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def edit(self, at: int, drop: int, put: str) -> None:
        old = self.text
        at = min(max(at, 0), len(old))
        end = min(len(old), at + max(drop, 0))
        if at == end and not put:
            return
        new = self.text = old[:at] + put + old[end:]
        if not old:
            self.__init__(new, self.counter)
            self.reencoded += self.total
            return
        # a pre-token can look two characters past its end: those that end this near the edit are split anew
        first, start = self._slot_at(max(0, at - 4))
        last, last_end = first, start + self.chars[first + self.width]
        shift, place, parts = len(new) - len(old), start, []
        while True:
            # old slot ends at or behind the edit, in the new text's offsets
            while last_end < end or last_end + shift < place:
                last += 1
                last_end += self.chars[last + self.width]
            if last_end + shift == place:
                break
            found = self.counter.split.match(new, place)
            parts.append(found.group())
            place = found.end()
        counts = self.counter.counts(parts)
        self.reencoded += sum(counts)
        for slot in range(first + 1, last + 1):
            if self.chars[slot + self.width]:
                self._put(slot, 0, 0)
        self._put(first, place - start, sum(counts))


_counters: dict[str, Counter] = {}


def counter(ranks_path: str, pattern: str) -> Counter:
    """One counter for each worker process."""
    if ranks_path not in _counters:
        _counters[ranks_path] = Counter(ranks_path, pattern)
    claim(f"edits {ranks_path}", _counters[ranks_path].known.clear)
    return _counters[ranks_path]


def count_edits(docs: DataFrame, edits: Column, ranks_path: str, pattern: str) -> DataFrame:
    """docs without their text, with the token counts before and after the edits, the tokens that the edits
    re-encoded and the number of edits. edits: a column of EDITS."""
    names = others(docs, "text", *(x.split()[0] for x in SCHEMA.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text, todo in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                tree = CountTree(text or "", count)
                before, done = tree.total, 0
                for e in todo or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["drop"] or 0, e["put"] or "")
                        done += 1
                rows.append((before, tree.total, tree.reencoded, done))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*names, *(x.split()[0] for x in SCHEMA.split(", "))])

    schema = ", ".join([*filter(None, [fields(docs, names)]), SCHEMA])
    return in_arrow(docs.select(*map(col, names), "text", edits.cast(EDITS).alias("_edits")), run, schema)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the column `edits`, the rows (doc_id, ord, at, drop, put) of an edit table in order of ord.

    An edit log of one document is one row: it must be as small as a document."""
    log = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "at", "drop", "put"))).alias("_log"))
    log = log.select("doc_id", F.transform("_log", lambda e: F.struct(e["at"].alias("at"), e["drop"].alias("drop"), e["put"].alias("put"))).alias("edits"))
    return docs.join(log, "doc_id", "left")
