"""A corpus pipeline over documents: quality rules, exact dedup, near dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paygrove.llm import bpe, dedup, mixing, rules, simhash
from paygrove.session import scratch_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the strict policy stay.

    A null text counts as empty and goes; repeated rows stay or go together.
    """
    return rules.passing(docs, rules.STRICT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays.

    A null text counts as empty; of rows that repeat in id and text one stays.
    """
    return dedup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints are linked the one with the smallest doc_id stays.

    Texts without words share a fingerprint and are one group.
    """
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one of its own; a document may come twice or not at all, so rows repeat.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each row of the mix.

    Repeated rows give repeated rows; an empty mix gives an empty result, as does any stage of an empty table.
    """
    return bpe.encode_decode(docs)


STAGES = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix),
    ("bpe", encode),
]

#: XXH64 fingerprints, the draw of the mix and BPE ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch_table(docs, name)
    return docs
