"""Quality rules with suffix-array repetition.

For each document the suffix array of its words gives all maximal repeated substrings; the union of
their spans must not cover too much of the text and none may be too long. Plain counts (words,
symbols, repeated lines, repeated 8-word windows) come along and don't count in the method's verdict.

Defined cases: a null or empty text has no words, all counts 0, base_failed and not kept. Rows are
judged one by one, so repeated rows and ties get equal verdicts. An empty table gives no rows. Of the
input only the id and the text column are read; other columns, whatever their names, stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, SPACE, in_arrow, text_parts, word_ids
from .suffix_repeats import covered, longest_repeats

SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    """min_span: words of the shortest repeat whose span counts, 8 at least. max_covered: largest share of
    words in such spans. max_longest: largest share of words in the longest repeat, which min_span words never exceed."""

    min_span: int = 12
    max_covered: float = 0.25
    max_longest: float = 0.20


def _line_repeats(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes | None], limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """The measures of each text, as columns."""
    ids, n_words, _ = word_ids(texts)
    starts = np.concatenate([[0], np.cumsum(n_words)])
    at, length = longest_repeats(ids, n_words, 3)
    total = np.concatenate([[0], np.cumsum(covered(len(ids), at, 8))])
    long = length >= limits.min_span
    spans = np.concatenate([[0], np.cumsum(covered(len(ids), at[long], length[long]))])
    longest = np.zeros(len(ids) + 1, np.int64)
    longest[at] = length
    some = np.flatnonzero(n_words)
    top = np.zeros(len(texts), np.int64)
    if len(some):
        top[some] = np.maximum.reduceat(longest[:-1], starts[some])
    chars = np.array([len(t.translate(None, SPACE + CONTINUATION)) if t else 0 for t in texts], np.int64)
    symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) if t else 0 for t in texts], np.int64)
    lines = np.array([_line_repeats(t) if t else 0 for t in texts], np.int64)
    repeat, cover = total[starts[1:]] - total[starts[:-1]], spans[starts[1:]] - spans[starts[:-1]]
    failed = (n_words < 20) | (100 * repeat > 30 * n_words)
    bad = (cover > limits.max_covered * n_words) | (top > np.maximum(limits.min_span, limits.max_longest * n_words))
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeat,
        "covered_words": cover, "longest_repeat": top, "base_failed": failed, "kept": ~failed & ~bad,
    }


def quality_measures(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1 << 20) -> DataFrame:
    """One row for each document: its id, the measures and the verdict `kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(1), chunk_bytes):
                found = measure(texts, limits)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], *map(pa.array, found.values())], names=["doc_id", *found])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def filter_quality(docs: DataFrame, limits: Limits = Limits(), chunk_bytes: int = 1 << 20) -> DataFrame:
    """The documents that pass, with all their columns; rows go through one by one, without a join."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(at), chunk_bytes):  # small batches, which the other side holds whole
                yield batch.slice(part.start, len(texts)).filter(pa.array(measure(texts, limits)["kept"])).rename_columns(names)

    return in_arrow(docs, run, docs.schema)
