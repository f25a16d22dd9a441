"""From raw documents to packed training sequences: stages that each read what the one before has kept.

Null or empty texts have no words, so the rules reject them. Null doc_ids pass all stages; they are never trusted. Rows that
repeat are judged alike, and one of them stays after the join. Scores that equal a threshold are kept. Very long texts are
read whole. Columns beyond those of documents go along, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heapscope.llm import ngram_join, packing, quality_crf, quality_rules, substring_bytes
from heapscope.llm.common import documents, staged


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio."""
    return quality_rules.kept_documents(spark, docs, sf_dir)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to whose lines the random field gives a quality of 0.3 or more."""
    return quality_crf.kept_documents(spark, docs, sf_dir)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the strings of 200 bytes that also stand elsewhere."""
    return substring_bytes.cleaned_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens in the corpus mixture; one row for each piece."""
    import public_tokenizers

    return packing.packed_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("packing", packed),
]
#: Hashed ratios and tokenizers aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs
