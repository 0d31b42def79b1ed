"""The queries of the ten operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, edit_counts, embedding_dedup, hard_negatives, language_id, near_dedup, phrases, piece_lattice, quality_rules, sharding, substring_dedup, token_records, toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token records, from the index of the files that were read back."""
    path = token_records.write_records(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    index = token_records.read_index(spark, token_records.write_index(spark, path))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50-word windows of earlier documents leave of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; text likelihoods are learnt from the documents."""
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on 2-word shingles at 0.8."""
    return near_dedup.label_near_duplicates(table(spark, sf_dir, "documents"), width=2)


def scripted_edits(text: str = "text", doc_id: str = "doc_id"):
    """Three edits of a document, fixed by its id: words put in, characters replaced, characters taken out."""
    size = F.coalesce(F.length(text), F.lit(0))
    at = lambda k: F.pmod(F.xxhash64(F.lit(k), doc_id), size + 1)
    drop = lambda k: F.pmod(F.xxhash64(F.lit(k + 10), doc_id), F.lit(40))
    edit = lambda at, drop, put: F.struct(at.cast("long").alias("at"), drop.cast("long").alias("drop"), put.alias("put"))
    return F.array(
        edit(at(1), F.lit(0), F.lit(" an inserted phrase, 42 ")),
        edit(at(2), drop(2), F.concat(F.lit("re"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("-written"))),
        edit(at(3), drop(3), F.lit("")),
    )


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edit_counts.count_edits(docs, scripted_edits(), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`, read back from the written shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = sharding.write_shards(docs, 40)
    return sharding.read_shards(spark, path, "doc_id long, text string, slot long").select(
        "doc_id",
        sharding.record_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All verified benchmark items of every document."""
    return decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.quality_measures(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_lattice.segmentations(docs, tokenizer_path("piece_bpe_32k.model"), 4)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector has another label first."""
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component and number of links of every vector, at a cosine of 0.93 within its label."""
    return embedding_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_records, op2_substring_dedup, op3_toxicity, op4_language_id, op5_near_dedup,
        op6_edit_counts, op7_sharding, op8_decontamination, op9_quality_rules, op10_piece_lattice,
        op11_hard_negatives, op12_embedding_dedup, op13_phrases,
    )
    return {f.__name__: f for f in found}


#: Words of every document, and its windows of n words as text; i counts from 0.
WORDS = r"(SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"
WINDOWS = "(SELECT doc_id, i, array_to_string(w[i + 1:i + {n}], ' ') AS gram FROM {words}, range(len(w) - {n} + 1) t(i) WHERE len(w) >= {n})"


def _covered(words: str, n: int, marked: str) -> str:
    """SQL for the places (doc_id, p) of words that marked windows (doc_id, i) of n words cover."""
    return f"""SELECT doc_id, p FROM (SELECT q.doc_id, q.p, max((m.i IS NOT NULL)::INT) OVER (PARTITION BY q.doc_id ORDER BY q.p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit
        FROM (SELECT doc_id, p FROM {words}, range(len(w)) t(p)) q LEFT JOIN (SELECT DISTINCT doc_id, i FROM {marked}) m ON q.doc_id = m.doc_id AND q.p = m.i) WHERE hit = 1"""


SUBSTRING_DEDUP = f"""WITH d AS MATERIALIZED {WORDS}, g AS MATERIALIZED {WINDOWS.format(n=50, words="d")}, f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
    gone AS MATERIALIZED ({_covered("d", 50, "(SELECT doc_id, i FROM g JOIN f USING (gram) WHERE first < doc_id)")}),
    k AS (SELECT doc_id, count(*) AS n, string_agg(w[p + 1], ' ' ORDER BY p) AS kept FROM (SELECT doc_id, w, p FROM d, range(len(w)) t(p)) q WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = q.doc_id AND gone.p = q.p) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

NEAR_DEDUP = f"""WITH RECURSIVE d AS (SELECT doc_id, w FROM {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM {WINDOWS.format(n=2, words="d")} UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
    c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

QUALITY_RULES = f"""WITH d AS MATERIALIZED {WORDS}, g AS MATERIALIZED {WINDOWS.format(n=8, words="d")}, h AS MATERIALIZED {WINDOWS.format(n=12, words="d")},
    r AS ({_covered("d", 8, "(SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1)")}),
    c AS ({_covered("d", 12, "(SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1)")}),
    l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
    x AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    b AS MATERIALIZED (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(c.n, 0)::BIGINT AS covered_words, len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed
        FROM d LEFT JOIN x USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id) r USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) c USING (doc_id)),
    p AS (SELECT a.doc_id, a.i, z.i - a.i AS diagonal FROM h a JOIN h z ON a.doc_id = z.doc_id AND a.gram = z.gram AND a.i < z.i JOIN b ON a.doc_id = b.doc_id WHERE NOT base_failed),
    t AS (SELECT doc_id, max(n) + 11 AS longest FROM (SELECT doc_id, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, diagonal ORDER BY i) AS run FROM p) GROUP BY doc_id, diagonal, run) GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
        NOT base_failed AND NOT covered_words > 0.25::DOUBLE * n_words AND NOT coalesce(longest, 0) > greatest(12, 0.2::DOUBLE * n_words) AS kept FROM b LEFT JOIN t USING (doc_id)"""


HARD_NEGATIVES = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS x FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
    n AS (SELECT p.a, p.b AS pos, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
    SELECT a AS anchor_id, pos AS positive_id, rank::INT AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5"""

EMBEDDING_DEDUP = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93::DOUBLE),
    r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id) LEFT JOIN n ON a = vec_id"""

PHRASES = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
    f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, range(1, 6) a(k), range(1, len(w) - k + 2) b(i) GROUP BY ALL),
    c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
    s AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * c.f * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM c JOIN n USING (lang), range(1, c.k) t(j) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')
        WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.lang = c.lang AND z.k > c.k AND z.f >= c.f AND contains(' ' || z.phrase || ' ', ' ' || c.phrase || ' '))
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1)
    SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n::BIGINT AS n, score FROM s WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SUBSTRING_DEDUP, "op5_near_dedup": NEAR_DEDUP, "op9_quality_rules": QUALITY_RULES, "op11_hard_negatives": HARD_NEGATIVES, "op12_embedding_dedup": EMBEDDING_DEDUP, "op13_phrases": PHRASES}
