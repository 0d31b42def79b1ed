"""The corpus pipeline: stages over documents, each a DataFrame to a DataFrame.

quality rules drop what they reject; of near duplicates one document stays; words of passages that an earlier
document holds go; documents with benchmark items go; what is left is encoded to pieces and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontamination, near_dedup, piece_lattice, quality_rules, substring_dedup
from weftgraph.llm.common import shared_path, table
from weftgraph.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.filter_quality(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked on 5-word shingles at 0.8."""
    return near_dedup.drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 50-word windows that an earlier document holds; a document all of
    whose words go stays with an empty text. n_chars follows the text."""
    return substring_dedup.remove_repeats(docs).selectExpr(*["CAST(length(text) AS BIGINT) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the piece ids of their best segmentation and its decoded text in place of the text."""
    path = tokenizer_path("piece_bpe_32k.model")
    return piece_lattice.segmentations(docs, path, 4, with_ids=True)


STAGES = [("quality rules", quality), ("near duplicates", near), ("substrings", substrings), ("decontamination", decontaminate), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written and read again, as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
