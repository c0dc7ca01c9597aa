"""The corpus pipeline: documents in, training sequences of token ids out, one written table between stages.

Defined results: a null or empty text fails the base rules and goes; of a group
of copies the row with the least doc_id stays, and of rows that repeat it one,
the first by fingerprint and text; a null doc_id stays only where its group has
no other; a document that loses all its words to substring dedup stays as an
empty text and is packed as the end token alone; a benchmark that is empty, or
has only empty items, takes nothing away; without labels the base rules judge
alone; an empty table gives no sequence; further columns, whatever their names,
are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontam, packing, quality, simhash, substring
from tidelog.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the forest reject go."""
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that repeat go; every document stays, an empty one as an empty text."""
    return substring.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.filter_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 4,096 token ids, with the documents' pieces that each holds."""
    import public_tokenizers

    return packing.sequences(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing_stage),
]

#: The stages train, hash and tokenize: SQL cannot express them, so tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
