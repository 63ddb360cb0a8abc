"""The corpus pipeline: quality rules, near-duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import packing, pii, quality, simhash
from tidemark.llm.common import documents, new_folder
from tidemark.llm.queries import CAPACITY, END_ID, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the compression bands."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data."""
    return pii.pseudonymise(docs, any_phone=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in the training sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), END_ID, CAPACITY)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: Compression, SimHash and tokens can't be expressed in SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        folder = new_folder(spark, f"stage{k}")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
    raise ValueError("no stages")
