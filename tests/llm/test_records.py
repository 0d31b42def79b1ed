"""Files of token records, the check of the tokenizer, and lists of spans in parts."""

import json
from pathlib import Path

import public_tokenizers
import pytest

from weftgraph.llm import substring_dedup, token_records

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_records_of_one_id_are_many_files(spark, tmp_path):
    """Long texts without an id, equal ones among them, go to files of about the wanted size."""
    rows = spark.range(600).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "repeat(concat('word', IF(id % 2 = 0, 0, id), ' '), 400) AS text").repartition(6)
    size = rows.agg({"text": "count"}).first()[0] * 2_800
    path = token_records.write_records(rows, WORD, 1, f"file://{tmp_path}/records", file_bytes=size // 12)
    index = token_records.read_index(spark, token_records.write_index(spark, path))
    counts = [r["count"] for r in index.groupBy("file").count().collect()]
    assert sum(counts) == 600 and len(counts) >= 8 and max(counts) < 150
    assert index.where("doc_id IS NULL").select("start").distinct().count() == 600


def test_other_tokenizers_are_told(tmp_path):
    token_records.check_tokenizer(WORD)
    with pytest.raises(ValueError):
        token_records.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    told = json.loads(Path(WORD).read_text(encoding="utf-8"))
    told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[a-z]+"
    (tmp_path / "other.json").write_text(json.dumps(told), encoding="utf-8")
    with pytest.raises(ValueError, match="pre-tokenizer"):
        token_records.check_tokenizer(str(tmp_path / "other.json"))


def test_spans_of_one_text_in_parts(spark, monkeypatch):
    """Lists of spans that are cut give what whole ones give."""
    rows = [(k, " ".join(f"w{(k // 7 + j) % 60}" for j in range(30))) for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    take = lambda: sorted(tuple(r) for r in substring_dedup.remove_repeats(docs, window=6, anchor=2).select("doc_id", "n_removed", "kept_sha256").collect())
    want = take()
    monkeypatch.setattr(substring_dedup, "SPANS", 3)
    assert take() == want and any(n for _, n, _ in want)


def test_pre_tokens_outlive_words(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, learned = token_records.WordEncoder(path, most=13), []
    alone = token_records.WordEncoder(path).tokenizer
    learn = encode._learn_units
    monkeypatch.setattr(encode, "_learn_units", lambda: learned.append(len(encode.units.new)) or learn())
    forms = ["{}", "{},", "({})", "{}!"]
    words = ["Alpha", "beta", "Größe", "ÉTÉ", "x²", "Ⅷ", "ab3c"]
    for form in forms:  # each time all words are new and over the limit, but not what they are made of
        text = " ".join(form.format(w) for w in words * 2)
        ids, counts = encode([text.encode(), " ".join(f"{w}?{k}" for k, w in enumerate(words)).encode()])
        assert ids[: counts[0]].tolist() == alone.encode(text, add_special_tokens=False).ids
    assert learned[0] > 0 and sum(learned[1:]) < learned[0]
