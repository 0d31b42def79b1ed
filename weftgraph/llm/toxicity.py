"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, each a row of a hashed embedding table; a word's vector is the
mean of its n-grams', a passage's the mean of its different words' (of `Settings.least_words` at least, so that a
word repeated on its own weighs little), and a linear softmax on it gives the passage's
probability. A misspelling shares most n-grams with the word it spells. A text's score is that of its most
toxic passage, over all passages of the whole text.

Training takes a bounded sample of rows, whole texts: about `Settings.docs_per_class` labelled documents of each
class, chosen by hash. Scoring only needs, for each n-gram
bucket, the dot product of its embedding with the softmax weights: a broadcast of `buckets` floats.

Defined cases: null and empty texts get the probability that the bias alone gives; null labels don't train;
several labels of one document count as their maximum; with labels of one class only, or none, all scores
are that class's rate; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, claim


@dataclass(frozen=True)
class Settings:
    docs_per_class: int = 1500
    passage_words: int = 48
    least_words: int = 24
    grams: tuple[int, int] = (3, 6)
    buckets: int = 1 << 17
    dim: int = 8
    batches: int = 24
    epochs: int = 9
    rate: float = 0.5
    seed: int = 11


def gram_buckets(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each character n-gram of the words, in order of the words: the word's place and the n-gram's bucket."""
    texts = [f"<{w.decode('utf-8', 'replace').lower()}>" for w in words]
    sizes = np.array(list(map(len, texts)), np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word, end = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes)
    at, h, owners, buckets = np.arange(len(flat)), np.zeros(len(flat) + 1, np.uint64), [], []
    for n in range(1, s.grams[1] + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + flat[n - 1 :]
        if n >= s.grams[0]:
            inside = at[: len(h)] + n <= end[: len(h)]
            mixed = (h[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            owners.append(word[: len(h)][inside])
            buckets.append(((mixed >> np.uint64(32)) % np.uint64(s.buckets)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def passage_starts(n: int, size: int) -> np.ndarray:
    """Starts of a text's passages: equal cuts of `size` words at most."""
    return np.arange(max(1, -(-n // size)), dtype=np.int64) * n // max(1, -(-n // size))


@dataclass
class Model:
    """Weight of each bucket and the bias: the log odds of a passage are the mean over its words plus the bias."""

    weights: np.ndarray
    bias: float


def _batch(passages: list[list[bytes]], s: Settings):
    place: dict[bytes, int] = {}
    bags = [sorted(set(p)) for p in passages]
    tokens = np.array([place.setdefault(w, len(place)) for p in bags for w in p], np.int64)
    sizes = np.array([len(p) for p in bags])
    owner, bucket = gram_buckets(list(place), s)
    counts = np.bincount(owner, minlength=len(place))
    rows, local = np.unique(bucket, return_inverse=True)
    return tokens, sizes, local, counts, rows


def train(passages: list[list[bytes]], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Adagrad on fixed random batches of passages."""
    used = [i for i, p in enumerate(passages) if p]
    rate = float(np.clip(np.mean(labels), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    prior = float(np.log(rate / (1 - rate)))
    if not used or len(set(labels[used].tolist())) < 2:
        return Model(np.zeros(s.buckets, np.float32), prior)
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(used)
    batches = [(_batch([passages[i] for i in part], s), labels[part].astype(np.int64)) for part in np.array_split(order, min(s.batches, len(order)))]
    table, table_g = rng.normal(0, 1 / s.dim, (s.buckets, s.dim)), np.full((s.buckets, 1), 1e-8)
    soft, soft_g = rng.normal(0, 1 / s.dim, (s.dim, 2)), np.full((s.dim, 2), 1e-8)
    bias, bias_g = np.array([0.0, prior]), np.full(2, 1e-8)
    for _ in range(s.epochs):
        for b in rng.permutation(len(batches)):
            (tokens, sizes, local, counts, rows), y = batches[b]
            e = table[rows]
            words = np.add.reduceat(e[local], np.cumsum(counts) - counts) / counts[:, None]
            over = np.maximum(sizes, s.least_words)[:, None]
            mean = np.add.reduceat(words[tokens], np.cumsum(sizes) - sizes) / over
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            g_soft, g_bias = mean.T @ p, p.sum(axis=0)
            g_mean = (p @ soft.T) / over
            at = np.repeat(np.arange(len(sizes)), sizes)
            of_word = np.repeat(np.arange(len(counts)), counts)
            for k in range(s.dim):
                g_word = np.bincount(tokens, g_mean[at, k], len(counts)) / counts
                g = np.bincount(local, g_word[of_word], len(rows))
                e[:, k] = g
            table_g[rows, 0] += (e**2).mean(axis=1)
            table[rows] -= s.rate * e / np.sqrt(table_g[rows])
            soft_g += g_soft**2
            soft -= s.rate * 0.2 * g_soft / np.sqrt(soft_g)
            bias_g += g_bias**2
            bias -= s.rate * 0.2 * g_bias / np.sqrt(bias_g)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores of texts; the weight of each different word is worked out once."""

    def __init__(self, model: Model, s: Settings, most: int = 600_000):
        self.model, self.s, self.most, self.known = model, s, most, {}

    def learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.known))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            owner, bucket = gram_buckets(part, self.s)
            mean = np.bincount(owner, self.model.weights[bucket], len(part)) / np.bincount(owner, minlength=len(part))
            self.known.update(zip(part, mean.tolist()))

    def __call__(self, texts: list[bytes | None]) -> list[float]:
        out = []
        for k in range(0, len(texts), 256):
            split = [t.split() if t else [] for t in texts[k : k + 256]]
            if len(self.known) > self.most:
                self.known.clear()
            self.learn(set().union(*split))
            weight = self.known.__getitem__
            for words in split:
                starts = passage_starts(len(words), self.s.passage_words).tolist()
                bags = (set(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)]))
                top = max(math.fsum(map(weight, bag)) / max(len(bag), self.s.least_words) for bag in bags)
                out.append(1 / (1 + math.exp(-min(50.0, max(-50.0, top + self.model.bias)))))
        return out


_scorers: dict[str, Scorer] = {}


def scorer(name: str, model: Model, s: Settings) -> Scorer:
    """One scorer for each worker process and model."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model, s)
    claim(f"toxicity {name}", _scorers[name].known.clear)
    return _scorers[name]


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Trains on a bounded sample of the labelled documents (columns doc_id and toxic of labels)."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    counts = dict(marked.groupBy("toxic").count().collect())
    # a hash below the class's share keeps about docs_per_class of each class
    rates = {k: min(1.0, s.docs_per_class / n) for k, n in counts.items()}
    share = F.lit(0.0)
    for k, rate in rates.items():
        share = F.when(F.col("toxic") == k, F.lit(rate)).otherwise(share)
    chosen = marked.where(F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    chosen = F.broadcast(chosen)  # about twice docs_per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, marks = [], []
            for text, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                words = text.split() if text else []
                starts = passage_starts(len(words), s.passage_words).tolist()
                for a, b in zip(starts, [*starts[1:], len(words)]):
                    out.append(b" ".join(words[a:b]))
                    marks.append(toxic)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(marks, pa.int32())], names=["passage", "toxic"])

    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic").mapInArrow(run, "passage binary, toxic int").toPandas()
    order = sorted(range(len(sample)), key=lambda i: (bytes(sample.passage[i]), sample.toxic[i]))  # the order of arrival must not matter
    model = train([bytes(sample.passage[i]).split() for i in order], sample.toxic.to_numpy()[order], s)
    if len(counts) == 2:  # classes were sampled at different rates
        model.bias -= float(np.log(rates[1] / rates[0]))
    return model


def score(docs: DataFrame, model: Model, s: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """docs' doc_id with score and predicted."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = scorer(name, shared.value, s)
        for batch in batches:
            found = np.array(rate(as_bytes(batch.column(1))), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(column: str = "doc_id"):
    """Whether a document stays out of training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
