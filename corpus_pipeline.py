"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing, each on all that the stage before it kept.

run() writes what each stage returns to the folder of spark.checkpoint.dir as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import exact_dedup, langid, mixing, packing, simhash
from framewright.llm.common import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts among them) or unlike every learned language; repeated rows are judged alike; an empty table stays empty."""
    return langid.keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the fullest of the documents that are equal up to white space, then the smallest id, null last; one row of those that agree in both."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id, null last; null texts count as empty."""
    return simhash.keep_one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources (null is one) meet their targets; texts without a word are never taken."""
    return mixing.repeat_by_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences; null texts have just the end id, rows with a repeated id are documents of their own."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Learned languages, fingerprints and tilted rates are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on all documents. Texts are read whole; other columns pass through all stages but the last, whatever their names; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
