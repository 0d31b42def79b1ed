"""SentencePiece encoding and decoding with the N best segmentations of each text.

Every path through a text's piece lattice is a segmentation; its score is the sum of its pieces' scores.
Forward Viterbi scores give, for every place, the exact best score of the text before it; a backward A-star
search from the end with them as heuristic pops complete segmentations in order of score.

No piece of the model holds a letter beside another character, a line end, or a space mark behind another
character (this is checked when it is loaded), so the lattice falls into segments there. Segmentations are in
order of score, equal scores in order of their ids (compared one by one, from the last). Of all changes of one
segment, those of the first N-1 in that order are the only ones that the N best of the whole text can hold:
whatever holds another comes after these N-1 and the best. So each segment keeps its best and the score that
its second best loses, the A-star search runs on segments that lose no more than the (N-1)th least, and the
segments of the first N-1 changes are combined. A character without a piece is spelled with byte pieces.

Defined cases: null counts as empty and has one segmentation without pieces; repeated rows get equal results; an empty table gives no rows; other columns pass
through, but for those named like a result column.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, claim, col, fields, in_arrow, others, text_parts

MARK = "▁"
#: Where a text falls into segments: a line end alone, letters with the spaces before them, other characters
#: with the spaces before them, spaces before a line end or the end.
LETTERS = r"[^\W\d_¹²³]+"
OTHERS = rf"(?:(?![^\W\d_¹²³])[^{MARK}\n])+"
SEGMENT = re.compile(rf"\n|{MARK}*{LETTERS}|{MARK}*{OTHERS}|{MARK}+")


class _Known(dict):
    """Numbers of segments in order of first appearance; `names` lists them, and what Lattice.best() gives for them
    stands in lists of the same order, once they are learned."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []
        self.ids: list[bytes] = []
        self.scores, self.behind = array("d"), array("d")

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.names.append(segment)
        return n


class _Tree:
    """The tree of a model's pieces in arrays, for the best ways through many short segments at once."""

    def __init__(self, root: dict):
        chars, keys, self.longest = {}, [], 0
        pieces, todo, n = [(0.0, -1)], [(root, 0, 1)], 1
        while todo:
            after, node, depth = todo.pop()
            self.longest = max(self.longest, depth if after else 0)
            for c, (next_, found) in after.items():
                keys.append((node, chars.setdefault(c, len(chars)), n))
                pieces.append((0.0, -1) if found is None else (found[0], found[1][0]))
                todo.append((next_, n, depth + 1))
                n += 1
        self.code = np.full(0x110001, -1, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        self.width = len(chars)
        known = np.array([node * self.width + c for node, c, _ in keys], np.int64)
        order = np.argsort(known)
        self.keys, self.to = known[order], np.array([x[2] for x in keys], np.int64)[order]
        self.score, self.piece = np.array([x[0] for x in pieces]), np.array([x[1] for x in pieces], np.int64)
        #: Characters that are pieces of their own.
        self.single = {c for c, (_, found) in root.items() if found is not None}

    def best(self, segments: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """What Lattice.best() gives for each segment, in the same order of additions and choices: edges of all
        segments that start at one place have different ends, so they are taken at once, place by place."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        code = self.code[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        after = np.cumsum(size)
        local = np.arange(len(code)) - np.repeat(after - size, size)  # the place in its segment
        room = np.repeat(size, size) - local
        place = np.arange(len(code)) + np.repeat(np.arange(len(size)), size)  # a segment has a place more than characters
        at, node, edges = np.arange(len(code)), np.zeros(len(code), np.int64), []
        for d in range(1, self.longest + 1):
            inside = room[at] >= d
            at, node = at[inside], node[inside]
            key = node * self.width + code[at + d - 1]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[k] == key
            at, node = at[there], self.to[k[there]]
            if not len(at):
                break
            ends = self.piece[node] >= 0
            edges.append((local[at[ends]], place[at[ends]], place[at[ends]] + d, node[ends]))
        start, i, j, node = map(np.concatenate, zip(*edges))
        order = np.argsort(start, kind="stable")
        i, j, s, piece = i[order], j[order], self.score[node[order]], self.piece[node[order]]
        cuts = np.searchsorted(start[order], np.arange(int(size.max()) + 1))
        n = len(code) + len(size)
        first, second, back, by = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, np.int64), np.full(n, -1)
        ends = after + np.arange(len(size))
        first[ends - size] = 0.0
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            i_, j_, s_, p_ = i[lo:hi], j[lo:hi], s[lo:hi], piece[lo:hi]
            x, f, g = first[i_] + s_, first[j_], second[j_]
            more, same = x > f, x == f
            second[j_] = np.where(more, np.maximum(f, second[i_] + s_), np.maximum(g, x))
            first[j_] = np.maximum(f, x)
            way = more | (same & (p_ < by[j_]))
            back[j_[way]], by[j_[way]] = i_[way], p_[way]
        steps, row, at = [], np.arange(len(size)), ends
        while len(row):
            steps.append((row, by[at]))
            at = back[at]
            open_ = at > ends[row] - size[row]
            row, at = row[open_], at[open_]
        count = np.zeros(len(size), np.int64)
        for row, _ in steps:
            count[row] += 1
        upto = np.cumsum(count)
        flat = np.empty(int(upto[-1]), "<u4")
        for k, (row, ids) in enumerate(steps):
            flat[upto[row] - 1 - k] = ids
        raw, upto = flat.tobytes(), (4 * upto).tolist()
        return [raw[a:b] for a, b in zip([0, *upto], upto)], first[ends], first[ends] - second[ends]


class Lattice:
    def __init__(self, path: str, most: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces: dict[str, int] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        self.scores = [model.get_score(i) for i in range(n)]
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece] = i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.pieces))
        self.scored = {p: (self.scores[i], (i,)) for p, i in self.pieces.items()}
        self.root: dict = {}  # a tree of characters: what may follow, score and ids of the piece that ends there
        for p, found in sorted(self.scored.items()):  # a piece comes after its prefixes
            after = self.root
            for c in p[:-1]:
                after = after.setdefault(c, ({}, None))[0]
            after[p[-1]] = ({}, found)
        self.unknown = min(s for s, _ in self.scored.values() if s > -1e8) - 10.0  # for each byte of a character without a piece
        if not all(SEGMENT.fullmatch(p) and p != "\n" for p in self.pieces):
            raise ValueError("a piece of this model spans segments")
        self.tree = _Tree(self.root)
        self.most, self.known, self.held, self.choices = most, _Known(), 0, {}

    def edges(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place, the edges that end there: start, score, piece ids."""
        pieces, scores, longest, n = self.pieces, self.scores, self.longest, len(text)
        out: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            one = False
            for j in range(i + 1, min(n, i + longest) + 1):
                found = pieces.get(text[i:j])
                if found is not None:
                    out[j].append((i, scores[found], (found,)))
                    one |= j == i + 1
            if not one:
                s, ids = self._spelled(text[i])
                out[i + 1].append((i, s, ids))
        return out

    @staticmethod
    def forward(edges: list) -> list[float]:
        """The best score of the text before each place."""
        best = [0.0] * len(edges)
        for j in range(1, len(edges)):
            best[j] = max(best[i] + s for i, s, _ in edges[j])
        return best

    def best(self, text: str) -> tuple[bytes, float, float]:
        """Piece ids (as little-endian 32 bits) and score of the best segmentation of a segment, and how far
        the second best is behind (inf: none, 0: equal). One forward pass keeps the two best scores for each place."""
        root, n, none = self.root, len(text), float("-inf")
        first, second, back = [none] * (n + 1), [none] * (n + 1), [(0, ())] * (n + 1)
        first[0] = 0.0
        for i in range(n):
            f, g, after, j = first[i], second[i], root, i
            if text[i] not in root or root[text[i]][1] is None:
                after = {text[i]: (root.get(text[i], ({},))[0], self._spelled(text[i]))}
            while after and j < n:
                node = after.get(text[j])
                if node is None:
                    break
                after, found = node
                j += 1
                if found is not None:
                    s, ids = found
                    x = f + s
                    if x > first[j]:
                        y = g + s
                        second[j] = first[j] if first[j] > y else y
                        first[j], back[j] = x, (i, ids)
                    elif x == first[j]:
                        second[j] = x
                        if ids[-1] < back[j][1][-1]:
                            back[j] = (i, ids)
                    elif x > second[j]:
                        second[j] = x
        path, j = [], n
        while j:
            j, ids = back[j]
            path.append(ids)
        ids = [x for part in reversed(path) for x in part]
        return array("I", ids).tobytes(), first[n], first[n] - second[n]

    def learn(self) -> None:
        """What is best for the segments that got numbers since it was last called."""
        known = self.known
        new = known.names[len(known.ids) :]
        single = self.tree.single
        many = [k for k, x in enumerate(new) if len(x) <= 32 and single.issuperset(x)]
        many = many if len(many) >= 256 else []  # fewer are sooner done one by one
        ids, scores, behind = [b""] * len(new), np.zeros(len(new)), np.zeros(len(new))
        for lo in range(0, len(many), 1 << 14):
            part = many[lo : lo + (1 << 14)]
            found, scores[part], behind[part] = self.tree.best([new[k] for k in part])
            for k, x in zip(part, found):
                ids[k] = x
        for k in set(range(len(new))).difference(many):
            ids[k], scores[k], behind[k] = self.best(new[k])
        known.ids += ids
        known.scores.frombytes(scores.tobytes())
        known.behind.frombytes(behind.tobytes())

    def forget(self) -> None:
        self.known, self.held = _Known(), 0
        self.choices.clear()

    def _spelled(self, char: str) -> tuple[float, tuple[int, ...]]:
        raw = (" " if char == MARK else char).encode("utf-8", "surrogatepass")
        return self.unknown * len(raw), tuple(self.byte_ids[b] for b in raw)

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a segment in order of score, then of ids from the last on: score and these
        ids, last first. Backward A-star search; of equal partial paths the one with the smallest ids goes on, so
        that ties, however many, are not all followed."""
        edges = self.edges(text)
        before = self.forward(edges)
        heap = [(-before[-1], (), len(text), 0.0)]
        out: list[tuple[float, tuple[int, ...]]] = []
        while heap and len(out) < n:
            _, ids, at, score = heapq.heappop(heap)
            if at == 0:
                out.append((score, ids))
                continue
            for i, s, found in edges[at]:
                heapq.heappush(heap, (-(before[i] + s + score), ids + found[::-1], i, s + score))
        return out

    @staticmethod
    def segments(text: str) -> list[str]:
        return SEGMENT.findall((" " + text).replace(" ", MARK)) if text else []

    def _choices(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best of a segment, with what each loses to the best in place of its score."""
        found = self.choices.get((segment, n))
        if found is None:
            found = self.n_best(segment, n)
            found = [(found[0][0] - score, ids) for score, ids in found]
            if len(segment) <= 64:
                if len(self.choices) >= self.most // 8:
                    self.choices.clear()
                self.choices[segment, n] = found
        return found

    def encode(self, text: str, n: int = 1) -> list[tuple[float, bytes]]:
        """The n best segmentations of a whole text, best first: score and piece ids as little-endian 32 bits."""
        return next(self.encode_all([text], n))

    def encode_all(self, texts: list[str], n: int = 1) -> Iterator[list[tuple[float, bytes]]]:
        """encode() of each text; segments are learned for runs of texts of about 4 million characters."""
        for part in chunks(texts, RUN):
            if len(self.known) >= self.most or self.held > 1 << 24:
                self.known, self.held = _Known(), 0
            number, rows = self.known.__getitem__, []
            for text in texts[part]:
                segments = self.segments(text)
                rows.append(np.fromiter(map(number, segments), np.int64, len(segments)))
            self.held += sum(map(len, self.known.names[len(self.known.ids) :]))
            self.learn()
            for row in rows:
                yield self._encode(row, n)

    def _encode(self, row: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        """The n best of a text whose segments have these numbers."""
        known = self.known
        plain = list(map(known.ids.__getitem__, row.tolist()))
        top = sum(np.frombuffer(known.scores)[row].tolist()) if len(row) else 0
        if n == 1 or not plain:
            return [(top, b"".join(plain))]
        behind = np.frombuffer(known.behind)[row]
        least = np.partition(behind, n - 2)[n - 2] if len(behind) >= n else np.inf
        changes = []  # of one segment: smaller ids come first where they stand late, larger ids where they stand early
        names = known.names
        for k in np.flatnonzero((behind <= least) & (behind < np.inf)).tolist():
            best, *others = self._choices(names[row[k]], n)
            changes += ((loss, ids > best[1], k if ids > best[1] else -k, ids, k) for loss, ids in others)
        open_ = sorted({x[-1] for x in heapq.nsmallest(n - 1, changes)}, reverse=True)
        mixes = [(0.0, ())]
        for k in open_:
            mixes = heapq.nsmallest(n, ((loss + more, (*held, ids)) for loss, held in mixes for more, ids in self._choices(names[row[k]], n)))
        out = []
        for loss, held in mixes:
            for k, ids in zip(open_, held):
                plain[k] = array("I", ids[::-1]).tobytes()
            out.append((top - loss, b"".join(plain)))
        return out

    def decode(self, ids) -> str:
        """The text of piece ids (a list, or little-endian 32 bits); the first space is the encoder's own."""
        ids = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """One lattice for each worker process."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    claim(f"pieces {path}", _lattices[path].forget)
    return _lattices[path]


#: Bytes of text that are taken at once.
RUN = 1 << 22
SCHEMA = "n_pieces long, best_score double, n_found int, scores array<double>, nbest_crc32 array<long>, decoded_equal boolean"


def segmentations(docs: DataFrame, model_path: str, n: int = 4, with_ids: bool = False) -> DataFrame:
    """docs without their text, with what the n best segmentations are; with_ids adds `ids`, those of the best,
    and as `text` what they decode to.

    scores and nbest_crc32 (of the ids as little-endian unsigned 32-bit integers) go from the best on;
    decoded_equal tells that the best decodes to the text.
    """
    names = others(docs, "text", *(x.split()[0] for x in SCHEMA.split(", ")), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_path)
        for batch in batches:
            for part, texts in text_parts(batch.column(len(names)), RUN):  # so that what is found is sent on, and never that of a whole batch held
                rows, best_ids, decoded = [], [], []
                texts = [x.decode() if x else "" for x in texts]
                for text, found in zip(texts, model.encode_all(texts, n)):
                    again = model.decode(found[0][1])
                    rows.append((len(found[0][1]) // 4, found[0][0], len(found), [s for s, _ in found], [zlib.crc32(x) for _, x in found], again == text))
                    if with_ids:
                        best_ids.append(np.frombuffer(found[0][1], "<i4"))
                        decoded.append(again)
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_())
                out = [*(batch.column(k)[part.start : part.stop] for k in range(len(names))), *(pa.array(c, k) for c, k in zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(best_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else []), names=[*names, *(x.split()[0] for x in SCHEMA.split(", ")), *(["ids", "text"] if with_ids else [])])

    schema = ", ".join([*filter(None, [fields(docs, names)]), SCHEMA, *(["ids array<int>, text string"] if with_ids else [])])
    return in_arrow(docs.select(*map(col, names), "text"), run, schema)


def decode_ids(rows: DataFrame, model_path: str) -> DataFrame:
    """rows with a column ids: the same rows with `text`, the decoded ids, in its place."""
    names = others(rows, "ids", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_path)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join([*filter(None, [fields(rows, names)]), "text string"])
    return in_arrow(rows.select(*map(col, names), "ids"), run, schema)
