"""Repeated substrings of words within single documents, from suffix ranks.

Many documents are handled at once: their words stand in one array and the first sort key is the
document, so no repeat crosses documents. Ranks are refined by prefix doubling; suffixes that are
already alone in their group are left out of later sorts, so the work follows the repeated part.
"""

from __future__ import annotations

import numpy as np


def longest_repeats(words: np.ndarray, counts: np.ndarray, base: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose 2**base words occur elsewhere in their document, and the longest repeat that starts there.

    words: ids of all documents' words; counts: words per document. The longest repeat at a suffix is
    the larger of the common prefixes with its neighbours in the suffix array: the top of the
    longest-common-prefix interval that holds it.
    """
    n = len(words)
    empty = np.zeros(0, np.int64)
    if n == 0:
        return empty, empty
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    end = np.repeat(np.cumsum(counts), counts)
    key = doc * (int(words.max()) + 1) + words
    active, start = np.arange(n, dtype=np.int64), np.zeros(n, np.int64)
    rank = np.zeros(n, np.int64)
    levels: list[np.ndarray] = []
    width, level, found = 1, 0, empty
    while True:
        order = np.argsort(key, kind="stable")
        active, key, start = active[order], key[order], start[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        if level == 0:
            group = np.arange(len(key))  # the rank of a group is the place of its first suffix
            rank_here = np.maximum.accumulate(np.where(head, group, 0))
        else:
            first = np.ones(len(start), bool)
            first[1:] = start[1:] != start[:-1]
            place = np.arange(len(key))
            of_group = np.maximum.accumulate(np.where(first, place, 0))
            of_part = np.maximum.accumulate(np.where(head, place, 0))
            rank_here = start + (of_part - of_group)
        rank[active] = rank_here
        tail = np.ones(len(head), bool)
        tail[:-1] = head[1:]
        shared = ~(head & tail)
        active, start = active[shared], rank_here[shared]
        if level == base:
            found = active
        if not len(active):
            break
        levels.append(rank.astype(np.int32 if n < 2**31 else np.int64))
        ahead = active + width
        inside = ahead < end[active]
        after = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = start * (n + 1) + after
        width, level = width * 2, level + 1
    if not len(found):
        return empty, empty
    found = found[np.argsort(rank[found], kind="stable")]
    a, b = found[:-1], found[1:]
    near = levels[base][a] == levels[base][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        ok = (i + (1 << k) <= end[a]) & (j + (1 << k) <= end[b])
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        common += np.where(ok & (levels[k][i] == levels[k][j]), 1 << k, 0)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    found = np.sort(found)
    return found, longest[found]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """For each of n places, whether one of the spans covers it."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0
