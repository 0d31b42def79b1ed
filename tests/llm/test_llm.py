"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables
and extra columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from weftgraph.llm import (
    components,
    decontamination,
    edit_counts,
    language_id,
    near_dedup,
    piece_lattice,
    quality_rules,
    sharding,
    substring_dedup,
    suffix_repeats,
    token_records,
    toxicity,
)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(3)
WORD = public_tokenizers.path("word_bpe_49k.json")
PASSAGE = " ".join(f"p{i}" for i in range(70))


def prose(n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


BASE = prose(200)
#: doc_id, text; clashing names come in `docs`
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w1 ", "x1 ")), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"),
    (9, f"{prose(30)} {PASSAGE} {prose(40)}"), (10, f"{prose(60)}\n{PASSAGE}"), (11, "la " * 3000), (12, "la " * 200),
    (13, prose(12000, 50_000)), (14, "ÑANDÚ straße é漢字 " * 9 + " x\x1cy z"), (15, "a\na\nb b\n\na\n"), (None, BASE), (16, BASE.upper()),
    (17, " ".join(BASE.split()[:195])), (18, prose(49)), (19, prose(50)), (7, "one"),
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, doc string, row int, node int, anchor string, shard int, n_words int, bands string, ids int, component string, `a.b` int, part int, value string, _at int"
    return spark.createDataFrame([(i, t, "d", 1, 2, "c", 3, 4, "b", 5, "k", 6, 7, "v", 8) for i, t in ROWS], schema)


@pytest.fixture(scope="module")
def plain(docs):
    return docs.select("doc_id", "text")


def words(t):
    return WORDS.findall(t or "")


def test_token_records_round_trip(spark, docs, plain):
    from tokenizers import Tokenizer

    path = token_records.write_records(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    index = token_records.read_index(spark, token_records.write_index(spark, path))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in index.select("doc_id", "start", "n_tokens", "ids_crc32").sort("start").collect()] == want
    back = token_records.read_shuffled(spark, path, index.where("doc_id % 3 = 0")).collect()
    assert Counter((r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in back) == Counter((i, c) for i, _, _, c in want if i is not None and i % 3 == 0)


def test_reads_by_offset_decode_nothing_else(spark, tmp_path):
    """A damaged frame that isn't wanted is never looked at; both ways of reading give the same records."""
    frames = [token_records.frame(i, np.array([i, 70_000 + i], np.uint32)) + b"\n" for i in range(100)]
    starts = np.cumsum([0, *map(len, frames)]).tolist()
    data = bytearray(b"".join(frames))
    data[starts[50] + 20] ^= 1
    (tmp_path / "part-00000-x-c000.txt").write_bytes(bytes(data))
    at = lambda ids: spark.createDataFrame([("part-00000-x-c000.txt", starts[i]) for i in ids], "file string, offset long")
    path = f"file://{tmp_path}"
    assert sorted((r.doc_id, r.ids) for r in token_records.read_shuffled(spark, path, at([7, 93, 7])).collect()) == [(7, [7, 70_007]), (93, [93, 70_093])]
    for ids, most in (([50], 64 << 20), ([7], 0)):
        with pytest.raises(Exception, match="checksum"):
            token_records.read_shuffled(spark, path, at(ids), most).collect()
    data[starts[50] + 20] ^= 1
    (tmp_path / "part-00000-x-c000.txt").write_bytes(bytes(data))
    assert sorted(r.doc_id for r in token_records.read_shuffled(spark, path, at(range(0, 100, 3)), 0).collect()) == list(range(0, 100, 3))


def test_frames_tell_damage():
    data = bytearray(token_records.frame(5, np.array([1, 70_000], np.uint32)) + b"\n")
    assert [(d, list(ids)) for _, _, d, ids in token_records.frames(bytes(data))] == [(5, [1, 70_000])]
    for k in range(len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises((ValueError, Exception)):
            list(token_records.frames(bytes(bad)))


def removed(rows, window):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        w = words(rows[k][1])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (rows[k][0] is None, rows[k][0] or 0))
    for i, t in rows:
        w, gone, own = words(t), set(), (i is None, i or 0)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < own:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup(docs):
    found = substring_dedup.remove_repeats(docs)
    assert found.columns[:-3] == [c for c in docs.columns if c != "n_words"]
    assert Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == removed(ROWS, 50)


def test_substring_dedup_small_windows(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(40)))) for i in range(60)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=6, anchor=2)
    assert Counter(tuple(x) for x in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == removed(rows, 6)


def test_substring_dedup_repeats_within_documents(spark):
    """A later document that holds a shared passage twice loses it at both places."""
    r = random.Random(6)
    word = lambda n: [f"{r.choice('xyz')}{r.randrange(30)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        base = word(16)
        rows.append((len(rows), " ".join(word(5) + base[: r.randrange(8, 16)] + word(5))))
        rows.append((len(rows), " ".join(sum((word(r.randrange(3)) + base for _ in range(4)), []))))
        rows.append((len(rows), " ".join(base * 5)))
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=6, anchor=2)
    assert Counter(tuple(x) for x in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == removed(rows, 6)


def components_of(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in sets if i is not None}
    for _ in label:
        for a in label:
            for b in label:
                x = len(sets[a] & sets[b])
                if x and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                    label[a] = label[b] = min(label[a], label[b])
    return Counter((i, len(sets[i]), label.get(i), i is None or label[i] == i) for i, _ in rows)


def test_near_dedup(docs):
    found = near_dedup.label_near_duplicates(docs, width=2)
    assert Counter(tuple(r) for r in found.collect()) == components_of(ROWS, 2)
    kept = near_dedup.drop_near_duplicates(docs, width=2)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for (i, _, _, k), n in components_of(ROWS, 2).items() for _ in range(n) if k)


def test_near_dedup_large_group_in_blocks(spark):
    r = random.Random(9)
    base, rows = [f"v{k}" for k in range(120)], []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(120), r.randrange(14)):
            w[k] = f"u{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    found = near_dedup.label_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2, block=16, leaders=2)
    assert Counter(tuple(x) for x in found.collect()) == components_of(rows, 2)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
    label = {x: x for e in links for x in e}
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert len(found) == len({x.node for x in found})
    assert {x.node: x.component for x in found} == {k: v for k, v in label.items() if k not in alone}


def test_sharding(spark, docs, plain):
    path = sharding.write_shards(plain, 4, buckets_per_shard=2)
    found = sharding.read_shards(spark, path, "doc_id long, text string, slot long").collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(ROWS)
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(4))
    for k in sizes:
        assert sorted(r.slot for r in found if r.shard == k) == list(range(sizes[k]))
    again = sharding.external_shuffle(plain, 4, buckets_per_shard=2).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.shard, r.slot) for r in found)
    assert sharding.external_shuffle(docs, 3).count() == len(ROWS)
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # the order is the seed's alone
    other = sharding.external_shuffle(plain, 4, buckets_per_shard=2).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter((r.doc_id, r.shard, r.slot) for r in other) == Counter((r.doc_id, r.shard, r.slot) for r in found)


def test_sharding_of_many_equal_rows_and_maps(spark):
    rows = [(None, "same", {"b": 1, "a": 2})] * 3000 + [(5, "same", None)] * 1500 + [(i, "x", {}) for i in range(500)]
    found = sharding.external_shuffle(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>"), 5).collect()
    assert Counter((r.doc_id, r.text, repr(r.m and sorted(r.m.items()))) for r in found) == Counter((i, t, repr(m and sorted(m.items()))) for i, t, m in rows)
    assert Counter(r.shard for r in found) == {k: 1000 for k in range(5)}
    # copies scatter: each shard has its part of them
    assert all(450 < sum(r.shard == k for r in found if r.doc_id is None) < 750 for k in range(5))


def test_sharding_of_one_key_with_other_columns(spark):
    """Rows of one id and text that differ elsewhere scatter over the buckets, and equal ones among them too."""
    from pyspark.sql import functions as F

    one = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "id AS other")
    rows = one.unionByName(one.limit(1).crossJoin(spark.range(10_000)).drop("id"))
    found = sharding.external_shuffle(rows, 4, buckets_per_shard=4).withColumn("_p", F.spark_partition_id()).collect()
    assert len(found) == 30_000 and sorted(Counter(r.shard for r in found).values()) == [7500] * 4
    assert max(Counter(r._p for r in found).values()) < 4000
    assert Counter(r.other for r in found) == Counter(r.other for r in rows.collect())


def test_sharding_query(spark, tmp_path):
    """The digest columns of the query against plain Python."""
    from weftgraph.llm import queries

    rows = [(i, t) for i, t in ROWS if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op7_sharding(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in found) == want
    assert all(0 <= r.shard < 40 for r in found)


def test_sharding_is_uniform(spark):
    n = 4000
    rows = sharding.external_shuffle(spark.range(n).selectExpr("id AS doc_id", "'x' AS text"), 8).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.doc_id)
    assert all(len(v) == n // 8 and abs(np.mean(v) - n / 2) < n * 0.06 for v in by.values())


def test_longest_repeats():
    for _ in range(60):
        counts = np.array([rng.randrange(25) for _ in range(3)])
        w = np.array([rng.randrange(2) for _ in range(counts.sum())], np.int64)
        at, length = suffix_repeats.longest_repeats(w, counts, 1)
        found, start = dict(zip(at.tolist(), length.tolist())), 0
        for n in counts:
            t = w[start : start + n].tolist()
            for i in range(n):
                best = max((next(k for k in range(n + 1) if max(i, j) + k >= n or t[i + k] != t[j + k]) for j in range(n) if j != i), default=0)
                assert found.get(start + i, 0) == (best if best >= 2 else 0)
            start += n


def test_quality_rules(docs):
    found = {(r.doc_id, r.n_words): r for r in quality_rules.quality_measures(docs).collect()}
    for i, t in ROWS:
        w, r = words(t), found[i, len(words(t))]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        spans = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(spans))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(spans) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert found[13, 12000].kept and found[1, 200].kept
    kept = quality_rules.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(quality_rules.measure([(t or "").encode()])["kept"][0] for _, t in ROWS)


def test_toxicity_learns_and_sees_misspellings(spark):
    r = random.Random(2)
    clean = [f"c{k}lm" for k in range(300)]
    bad = ["grumblefoot", "snortwangle", "blatherskite"]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(clean) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    extra = [(900, " ".join(clean[:59]) + " blatherskyte"), (901, None), (902, ""), (903, " ".join(clean[5:64]))]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    s = toxicity.Settings(epochs=30)
    model = toxicity.fit(docs, marks.where("doc_id < 300 OR doc_id IS NULL"), s)
    found = {x.doc_id: x for x in toxicity.score(docs, model, s).collect()}
    late = [(found[i].score, y) for i, y in labels if i >= 300]
    assert min(x for x, y in late if y) > max(x for x, y in late if not y)
    assert found[900].score > found[903].score + 0.4
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in found.values())
    assert toxicity.score(docs, toxicity.fit(docs, marks.limit(0), s), s).count() == len(rows) + 4


def test_language_id(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog with that thing", "en") for i in range(20)] + [(50 + i, "der hund und die katze mit dem ding", "de") for i in range(20)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    page = lambda lang, body: f"<html{lang}><head><script>der die das</script></head><body><p>{body}</p></body></html>"
    pages = [(k, "http://a.example.de/x", page("", "der hund mit der katze")) for k in range(6)]
    pages += [(10, "http://a.example.de/y", page("", "")), (11, "http://b.example.com", page(' lang="en-US"', "")), (12, None, None), (13, "http://c.example.com/z", page(' lang="de"', "the thing with the cat and the dog and that thing with the other cat")), (14, "nonsense", "")]
    found = {r.page_id: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert len(found) == len(pages)
    assert found[0].lang == "de" and found[10].lang == "de" and found[11].lang == "en" and found[13].lang == "en"
    assert all(0.5 <= r.probability <= 1 for r in found.values())


def test_edit_counts(spark, docs):
    count = edit_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    full = lambda t: len(count.encoding.encode_ordinary(t))
    r = random.Random(4)
    for k in range(400):
        text = "".join(r.choice("ab  \n'sé1.") for _ in range(r.randrange(60)))
        tree = edit_counts.CountTree(text, count)
        for _ in range(6):
            at, drop, put = r.randrange(70), r.randrange(6), "".join(r.choice("ab  \n't9") for _ in range(r.randrange(5)))
            tree.edit(at, drop, put)
            a = min(at, len(text))
            text = text[:a] + put + text[a + drop :]
            assert tree.text == text and tree.total == full(text) and tree.chars[1] == len(text)
    big = edit_counts.CountTree(prose(5000), count)
    big.edit(9000, 5, "zzz")
    assert big.total == full(big.text) and big.reencoded < 40
    from pyspark.sql import functions as F

    rows = edit_counts.count_edits(docs, F.array(F.struct(F.lit(3).alias("at"), F.lit(2).alias("drop"), F.lit("qq").alias("put")), F.lit(None)), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert Counter((x.doc_id, x.tokens_before, x.tokens_after) for x in rows) == Counter((i, full(t or ""), full((t or "")[:3] + "qq" + (t or "")[5:])) for i, t in ROWS)
    log = spark.createDataFrame([(1, 2, 0, 1, "b"), (1, 1, 0, 1, "aa")], "doc_id long, ord int, at long, drop long, put string")
    one = edit_counts.with_edits(docs.select("doc_id", "text"), log)
    got = {x.doc_id: x.tokens_after for x in edit_counts.count_edits(one.drop("edits").join(one.select("doc_id", "edits"), "doc_id").where("doc_id = 1"), F.col("edits"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert got == {1: full("b" + ("aa" + BASE[1:])[1:])}


def test_block_max_wand_is_exact():
    r = random.Random(6)
    vocab = [f"t{k}".encode() for k in range(60)]
    s = decontamination.Settings(threshold=0.4, block=3)
    items = [(k, r.choices(vocab, k=12), r.choices(vocab, k=3)) for k in range(40)]
    index = decontamination.Index(items, s)
    some = 0
    for _ in range(200):
        query = set(r.sample(vocab, 25))
        want = {}
        for t in query:
            for i, w in zip(*index.postings.get(t, ((), ()))):
                want[i] = want.get(i, 0) + w
        want = {i: w for i, w in want.items() if w >= s.threshold - 1e-12}
        got = dict(index.search(query))
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
        some += len(got)
    assert some > 50


def test_decontamination(spark, docs):
    items = [(1, prose(40)), (2, prose(25)), (3, None), (4, ""), (1, "never seen words in any text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = items[0][1].split()
    edited[7] = "changed"
    more = [(100, f"{prose(200)}\n{items[0][1]} {prose(100)}"), (101, f"{prose(90)} {items[1][1].upper()}!"), (102, " ".join(edited)), (103, " ".join(items[0][1].split()[:15])), (104, prose(300))]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found = decontamination.hits(both, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(100, 1), (101, 2), (102, 1)}
    small = decontamination.Settings(index_bytes=400)  # several indexes
    assert len(decontamination.indexes(bench, small)) > 1
    kept = decontamination.drop_contaminated(both, bench, small)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in ROWS) + Counter([103, 104])
    assert decontamination.hits(both, bench.limit(0)).count() == 0 and decontamination.drop_contaminated(both, bench.limit(0)).count() == len(ROWS) + 5


def test_decontamination_without_answers(spark):
    """An item without an answer is judged on its whole text, wherever the words that lack stand; an answer that is given is a gate."""
    item = prose(38)
    words = item.split()
    texts = [(1, f"{prose(60)} {' '.join(words[:34])} {prose(60)}"), (2, " ".join(words[:33] + ["other"] * 5)), (3, " ".join(words[:15])), (4, item)]
    both = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.hits(both, bench).collect()} == {1, 2, 4}
    assert [r.doc_id for r in decontamination.drop_contaminated(both, bench).collect()] == [3]
    answered = spark.createDataFrame([(1, " ".join(words[:33]), " ".join(words[33:])), (2, item, None)], "item_id long, text string, answer string")
    assert {(r.doc_id, r.item_id) for r in decontamination.hits(both, answered).collect()} == {(4, 1), (1, 2), (2, 2), (4, 2)}


def test_decontamination_by_own_length(spark):
    """A short item's words far apart are no hit because some other item is long; both lengths are found where they stand."""
    few, many = [f"w{k}" for k in range(15)], [f"long{k}" for k in range(2000)]
    fill = [f"x{k}" for k in range(900)]
    apart = " ".join(w for k, x in enumerate(few) for w in [x, *fill[k * 60 : k * 60 + 60]])
    room = " ".join([*fill[:31], *few[:6], *fill[100:104], *few[6:], *fill[200:300]])  # inserted words, cut by a passage's start
    texts = [(1, apart), (2, " ".join(fill[:70] + few + fill[70:])), (3, " ".join(fill[:45] + many + fill[45:])), (4, room)]
    both = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(few)), (2, " ".join(many))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.passage_start) for r in decontamination.hits(both, bench).collect()}
    assert got == {(2, 1, 64), (3, 2, 0), (4, 1, 0)}
    alone = {tuple(r)[:2] for r in decontamination.hits(both, bench.where("item_id = 1")).collect()}
    assert alone == {(2, 1), (4, 1)}


def test_decontamination_in_parts(spark):
    """Scores and hits don't depend on the number of parts; each is within its measured bytes; blocks are a term's own."""
    r = random.Random(8)
    items = [(k, " ".join([*r.choices([f"t{j}" for j in range(40)], k=12), f"own{k}", *r.choices([f"u{j}" for j in range(90)], k=r.randrange(3, 30))])) for k in range(60)]
    texts = [(k, f"{prose(40)} {' '.join(w for w in t.split() if r.random() < 0.85)} {prose(30)}") for k, t in items]
    both, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    s = decontamination.Settings(index_bytes=48_000)
    parts = list(decontamination.indexes(bench, s))
    assert len(parts) > 1 and all(sum(x.nbytes() for x in p) <= s.index_bytes for p in parts)
    assert sum(len(x.items) for p in parts for x in p) == 60
    assert all(len(x.block_at) <= sum(len(at) for at, _ in x.postings.values()) for p in parts for x in p)
    whole = sorted(map(tuple, decontamination.hits(both, bench).collect()))
    assert len(whole) > 20 and sorted(map(tuple, decontamination.hits(both, bench, s).collect())) == whole
    kept = sorted(x.doc_id for x in decontamination.drop_contaminated(both, bench, s).collect())
    assert kept == sorted({k for k, _ in texts} - {x[0] for x in whole}) and kept


def test_piece_lattice(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = piece_lattice.lattice(path)

    def every(text):
        edges = model.edges(text)

        def paths(j):
            if j == 0:
                yield 0.0, ()
            for i, s, ids in edges[j]:
                for a, b in paths(i):
                    yield a + s, b + ids

        return sorted(((s, ids[::-1]) for s, ids in paths(len(text))), key=lambda x: (-x[0], x[1]))

    def ids_of(last_first):
        return np.array(last_first[::-1], "<u4").tobytes()

    for w in ["▁the", "▁erblein", "▁é漢x", "\n", "▁", "▁▁▁▁a", "▁disgust", "=========="]:
        want, (ids, score, behind) = every(w), model.best(w)
        assert model.n_best(w, 5) == want[:5]
        assert (ids, score) == (ids_of(want[0][1]), want[0][0])
        assert behind == (want[0][0] - want[1][0] if len(want) > 1 else np.inf)
    for t in ["the of", "a b\n c", "Ñ x  y", " ", "\n\n", "in on a", " a  ", "of of", "on on on", "to to of of", "ab ab", "ab ab ab ab", "on to on to", "====== ===", "a.a.a"]:
        for n in (2, 4, 7):
            want, got = every((" " + t).replace(" ", "▁"))[:n], model.encode(t, n)
            assert got == [(s, ids_of(ids)) for s, ids in want], (t, n)
            assert all(model.decode(ids) == t for _, ids in got)
    assert len(model.encode("=" * 5003 + " " + "ab " * 3000, 4)) == 4  # ties without number
    rows = piece_lattice.segmentations(docs, path, 4, with_ids=True)
    assert all(r.decoded_equal for r in rows.collect())
    back = piece_lattice.decode_ids(rows.select("doc_id", "ids"), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in ROWS)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert token_records.read_index(spark, token_records.write_index(spark, token_records.write_records(none, public_tokenizers.path("word_bpe_49k.json"), 1))).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert near_dedup.label_near_duplicates(none).count() == 0
    assert sharding.external_shuffle(none, 5).count() == 0
    assert quality_rules.quality_measures(none).count() == 0 and quality_rules.filter_quality(none).count() == 0
    assert piece_lattice.segmentations(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    item = prose(30)
    rows = [(1, BASE, "en", "s", 5), (2, BASE, "en", "s", 5), (3, "x " * 90, "en", "s", 5), (4, f"{prose(80)} {PASSAGE}", "en", "s", 5), (5, f"{PASSAGE} {prose(80)}", "en", "s", 5), (6, f"{prose(100)} {item}", "en", "s", 5), (7, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {1, 4, 5} and all(r.decoded_equal for r in found.values())
    model = piece_lattice.lattice(public_tokenizers.path("piece_bpe_32k.model"))
    assert model.decode(found[5].ids) == found[5].text == " ".join(rows[4][1].split()[70:])


def test_words_are_encoded_as_in_whole_texts():
    """The remembered pre-tokens against the library on whole texts, with words that are easily cut wrongly."""
    import random

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD)
    encode, draw = token_records.WordEncoder(WORD, most=200), random.Random(5)
    odd = ["İstanbul", "ΣΟΦΟΣ", "don't", "'sun", "'s", "été's", "'été", "(é)", "éa", "a̸b", "≠", "ﬁn", "²x", "½", "x\x01y", "a b", " ", "<|endoftext|>", "a<|startoftext|>b", "é<|endoftext|>", "<|", "日本語", "ア゙", "1234", "A1b2", "---", "...", "it'll", "we'VE", "\x7f", "ñ1", "K", "\U0001f600ok"]
    letters = "aAbézЖ'ß.,-<|>1²́İΣ"
    texts = [" ".join(draw.choice([draw.choice(odd), "".join(draw.choices(letters, k=draw.randint(1, 9)))]) for _ in range(draw.randint(0, 60))) for _ in range(300)]
    for k in range(0, 300, 30):
        part = texts[k : k + 30]
        ids, counts = encode([t.encode() for t in part])
        want = [x.ids for x in plain.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_file_order_of_records(spark, tmp_path):
    """More than a thousand files of one part have names whose order as text isn't their order."""
    index = spark.createDataFrame([(f"part-{p:05d}-x-c{c:03d}.txt", 0, 10, 1, 0, 5, 0) for p in (0, 1, 100000) for c in (0, 2, 999, 1000)], token_records.INDEX)
    index.write.parquet(str(tmp_path / "index"))
    rows = {(int(r.file[5:].split("-")[0]), int(r.file[:-4].split("-c")[1])): r.start for r in token_records.read_index(spark, str(tmp_path / "index")).collect()}
    assert [rows[k] for k in sorted(rows)] == list(range(0, 60, 5))


def test_visible_text_of_pages():
    """The single pass against the pattern that says what is hidden, and its time on tags that never close."""
    import html
    import time

    hidden = re.compile(r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    draw, parts = random.Random(4), ["<nav ", "</nav >", "<nav>", "<SCRIPT x>", "</script>", "<style", "</style\n>", "<!--", "-->", "<", ">", "a", " b ", "&amp;", "<p>", "</p>", "-", "<navy>", "<nav-x>"]
    for _ in range(5000):
        page = "".join(draw.choices(parts, k=draw.randint(0, 14)))
        assert language_id.visible(page) == html.unescape(hidden.sub(" ", page)), page
    for junk in ("<nav ", "<nav>", "<!--", "<", "<script>x", "<html "):
        began = time.time()
        language_id.visible(junk * 200_000)
        language_id.LANG.search(junk * 200_000)
        assert time.time() - began < 5


def test_toxicity_scores_by_plain_python():
    """A scorer of given weights against sums over words and n-grams."""
    import math

    s = toxicity.Settings()
    weights = np.random.default_rng(3).normal(0, 3, s.buckets).astype(np.float32)
    score = toxicity.Scorer(toxicity.Model(weights, -1.5), s)
    texts = [None, "", "one", "a b a b", prose(47), prose(48), prose(49), prose(1000, 40), "é漢 " * 70, PASSAGE]

    def plain(text):
        w = (text or "").encode().split()
        n = max(1, -(-len(w) // s.passage_words))
        best = -math.inf
        for k in range(n):
            bag = set(w[k * len(w) // n : (k + 1) * len(w) // n])
            total = 0.0
            for x in sorted(bag):
                grams = weights[toxicity.gram_buckets([x], s)[1]].astype(float)
                total += grams.sum() / len(grams)
            best = max(best, total / max(len(bag), s.least_words))
        return 1 / (1 + math.exp(-(best - 1.5)))

    got = score([t.encode() if t is not None else None for t in texts])
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-9)


def test_toxicity_of_odd_tables(spark, docs):
    """No documents, no labels, one class, repeated rows and clashing columns."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert len({r.score for r in toxicity.score(docs, none).collect()}) == 1


def test_language_posteriors_by_plain_python(spark):
    """Likelihoods, declared languages and host priors fused by hand; odd tables."""
    s = language_id.Settings()
    docs = spark.createDataFrame([(i, "the cat and the dog with that thing", "en") for i in range(5)] + [(50 + i, "der hund und die katze", "de") for i in range(5)], "doc_id long, text string, lang string")
    body = lambda lang, text: f"<html{lang}><p>{text}</p></html>"
    pages = [(1, "http://a.de/x", body("", "der hund")), (2, "http://a.de/y", body(' lang="en"', "der hund und der the")), (3, "http://b.de/", body("", "")), (4, "http://c.com/", body(' lang="fr"', "the dog")), (5, None, None), (5, None, None)]
    model = language_id.fit(docs, s)
    score, langs, seen = language_id.TextScorer(model, s), model.languages, []
    for i, url, page in pages:
        found = language_id.LANG.search(page or "")
        ll = np.array(score(page), float)
        if found and found[1] in langs:
            ll = ll + np.array([np.log(s.declared_right) if x == found[1] else np.log(1 - s.declared_right) for x in langs])
        e = np.exp(ll - ll.max())
        seen.append((i, url.split("/")[2] if url else None, ll, np.round(e / e.sum() * 1e6) / 1e6))
    hosts, suffixes = defaultdict(lambda: np.zeros(2)), defaultdict(lambda: np.zeros(2))
    for _, h, _, p in seen:
        hosts[h] += p
        suffixes[(h or "").rsplit(".", 1)[-1]] += p
    got = defaultdict(list)
    for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect():
        got[r.page_id].append(r)
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}
    whole = sum(hosts.values())
    for i, h, ll, p in seen[:4]:
        flat = (whole - p + 1) / ((whole - p).sum() + 2)
        of_suffix = (suffixes[h.rsplit(".", 1)[-1]] - p + s.suffix_weight * flat) / ((suffixes[h.rsplit(".", 1)[-1]] - p).sum() + s.suffix_weight)
        prior = (hosts[h] - p + s.host_weight * of_suffix) / ((hosts[h] - p).sum() + s.host_weight)
        post = np.exp(ll - ll.max()) * prior
        assert got[i][0].lang == langs[int(post.argmax())] and abs(got[i][0].probability - post.max() / post.sum()) < 1e-6
    empty = spark.createDataFrame([], "page_id long, url string, html string, lang string, host string, ll int")
    assert language_id.identify(empty, docs).count() == 0
    unlabelled = language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.limit(0)).collect()
    assert len(unlabelled) == 6 and all(r.lang is None for r in unlabelled)


def test_more_empty_tables(spark, docs, tmp_path):
    from weftgraph.llm import queries

    import corpus_pipeline

    none = docs.limit(0)
    items = spark.createDataFrame([(1, prose(30))], "item_id long, text string")
    assert decontamination.hits(none, items).count() == 0 and decontamination.hits(docs, items.limit(0)).count() == 0
    kept = decontamination.drop_contaminated(docs, items.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert edit_counts.count_edits(none.select("doc_id", "text"), queries.scripted_edits(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    none.select("doc_id", "text", "shard", "ids").write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
