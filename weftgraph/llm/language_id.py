"""Language identification by Bayesian fusion of what a web page shows.

log posterior = text log likelihood + log P(declared language | language) + log prior, where

- the text likelihood is naive Bayes on character trigrams of the visible text, tempered, as trigrams of
  one text depend on each other;
- the declaration is the markup's lang attribute (its part before a hyphen), right with `declared_right`;
- the prior is that of the page's host, smoothed towards its address suffix's, that towards all pages'. Counts
  are sums of the first two factors' posteriors, added up by grouped aggregation; a page's own part is taken
  out before its prior is looked up, so no page votes for itself.

Trigram counts come from a bounded sample: about `docs_per_lang` documents of each language, by hash.

Defined cases: pages without visible text have a flat text likelihood; without or with an unknown declared
language, a flat declaration; a null or broken address has the host and suffix '' ; ties go to the first
language in alphabetical order; repeated rows get equal results; empty pages give no rows; without labelled
documents every page gets a null language. Other columns are not read.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Settings:
    docs_per_lang: int = 300
    temper: float = 0.25
    text_cap: float = 30.0  # largest lead in log likelihood that text alone can give
    declared_right: float = 0.9
    host_weight: float = 10.0  # pages that the suffix's share counts as in a host's prior
    suffix_weight: float = 50.0
    seed: int = 5


OPENING = re.compile(r"(?i)<(script|style|nav)\b")
CLOSING = re.compile(r"(?i)</(script|style|nav)\s*>")
LANG = re.compile(r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]+)")


def visible(page: str) -> str:
    """A page's text: comments, tags, and scripts, styles and navigation with all in them become a space each. What
    isn't closed counts as the tag alone, and behind the last '>' all is text. One pass over the page."""
    ends: dict[str, list[tuple[int, int]]] = {"script": [], "style": [], "nav": []}
    for m in CLOSING.finditer(page):
        ends[m[1].lower().replace("\u017f", "s")].append(m.span())
    out, at, comments = [], 0, True
    while True:
        i = page.find("<", at)
        close = page.find(">", i + 1) if i >= 0 else -1
        if close < 0:
            out.append(page[at:])
            return html.unescape("".join(out))
        out += (page[at:i], " ")
        at = close + 1
        m = OPENING.match(page, i)
        if m:
            found = ends[m[1].lower().replace("\u017f", "s")]
            k = bisect.bisect_left(found, (m.end(), 0))
            if k < len(found):
                at = found[k][1]
        elif comments and page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            comments = end >= 0
            at = end + 3 if comments else at


def trigrams(word: str) -> list[str]:
    w = f" {word.lower()} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class Model:
    languages: list[str]
    weight: dict[str, tuple[float, ...]]  # log probability of each trigram in each language
    rest: tuple[float, ...]


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    rates = {k: min(1.0, s.docs_per_lang / n) for k, n in counts.items()}
    if not languages:
        return Model([], {}, ())
    rate = reduce(lambda c, k: F.when(F.col("lang") == k, F.lit(rates[k])).otherwise(c), languages, F.lit(0.0))
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(1_000_000)) < rate * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(text.split())
                for w, n in words.items():
                    for g in trigrams(w):
                        found[lang, g] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])

    rows = chosen.select("text", "lang").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    place = {k: i for i, k in enumerate(languages)}
    table: dict[str, np.ndarray] = {}
    for r in rows:
        table.setdefault(r["gram"], np.zeros(len(languages)))[place[r["lang"]]] = r["n"]
    totals = sum(table.values(), np.zeros(len(languages)))
    floor = 0.5
    over = totals + floor * (len(table) + 1)
    return Model(languages, {g: tuple(np.log((c + floor) / over)) for g, c in table.items()}, tuple(np.log(floor / over)))


class TextScorer:
    def __init__(self, model: Model, s: Settings, most: int = 300_000):
        self.model, self.s, self.most, self.known = model, s, most, {}

    def __call__(self, page: str | None) -> np.ndarray:
        """Log likelihoods of a page's visible text, the best at 0."""
        total = np.zeros(len(self.model.languages))
        if page:
            if len(self.known) > self.most:
                self.known.clear()
            for w, n in Counter(visible(page).split()).items():
                row = self.known.get(w)
                if row is None:
                    row = self.known[w] = np.sum([self.model.weight.get(g, self.model.rest) for g in trigrams(w)], axis=0)
                total += n * row
        return np.maximum((total - total.max()) * self.s.temper, -self.s.text_cap) if len(total) else total


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def identify(pages: DataFrame, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """page_id, lang, probability, declared, host, host_lang (the best of its prior) for each page."""
    model = fit(docs, s)
    languages, n = model.languages, len(model.languages)
    if not n:
        return pages.select(F.col("page_id").cast("long"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("declared"), host_of("url").alias("host"), F.lit(None).cast("string").alias("host_lang"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    right, wrong = np.log(s.declared_right), np.log((1 - s.declared_right) / max(1, n - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = TextScorer(shared.value, s)
        for batch in batches:
            scores, declared = [], []
            for page in batch.column(2).to_pylist():
                found = LANG.search(page) if page else None
                lang = found.group(1).lower() if found else None
                ll = score(page)
                if lang in languages:
                    ll = ll + np.where(np.array(languages) == lang, right, wrong)
                scores.append(ll.tolist())
                declared.append(lang)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array(scores, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "ll"])

    seen = stored(pages.select(F.col("page_id").cast("long"), host_of("url").alias("host"), "html").mapInArrow(run, "page_id long, host string, declared string, ll array<double>"), "page-scores")
    top = F.array_max("ll")
    own = seen.withColumn("_e", F.transform("ll", lambda x: F.exp(x - top))).withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    own = own.select("page_id", "host", F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"), "declared", "ll", *[(F.col("_e")[k] / F.col("_z")).alias(f"p{k}") for k in range(n)])
    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in range(n)]
    # whole thousandths add up the same in any order
    own = own.withColumns({f"p{k}": F.round(F.col(f"p{k}") * 1_000_000).cast("long") for k in range(n)})
    hosts = own.groupBy("host", "suffix").agg(*sums)
    hosts = stored(hosts, "host-sums")
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"p{k}").alias(f"s{k}") for k in range(n)])
    whole = suffixes.agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0)).alias(f"g{k}") for k in range(n)]).first()
    levels = stored(hosts.select("host", "suffix", *[F.col(f"p{k}").alias(f"h{k}") for k in range(n)]).join(suffixes, "suffix").drop("suffix"), "host-levels")
    joined = own.join(levels, "host")
    total = lambda c, less: sum((F.col(f"{c}{k}") - (F.col(f"p{k}") if less else 0) for k in range(n)), F.lit(0)) / 1_000_000
    prior = []
    for k in range(n):
        share = lambda c: (F.col(f"{c}{k}") - F.col(f"p{k}")) / 1_000_000
        flat = (F.lit(whole[k]) - F.col(f"p{k}")) / 1_000_000
        everywhere = (flat + 1.0) / (sum(((F.lit(whole[j]) - F.col(f"p{j}")) / 1_000_000 for j in range(n)), F.lit(0.0)) + float(n))
        of_suffix = (share("s") + s.suffix_weight * everywhere) / (total("s", True) + s.suffix_weight)
        prior.append((share("h") + s.host_weight * of_suffix) / (total("h", True) + s.host_weight))
    names = F.array(*[F.lit(x) for x in languages])
    joined = joined.withColumn("_prior", F.array(*prior)).withColumn("_post", F.zip_with("ll", "_prior", lambda a, b: a + F.ln(b)))
    best = F.array_max("_post")
    return joined.select(
        "page_id",
        names[F.array_position("_post", best).cast("int") - 1].alias("lang"),
        (F.lit(1.0) / F.aggregate("_post", F.lit(0.0), lambda a, x: a + F.exp(x - best))).alias("probability"),
        "declared",
        "host",
        names[F.array_position("_prior", F.array_max("_prior")).cast("int") - 1].alias("host_lang"),
    )
