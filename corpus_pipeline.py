"""The corpus pipeline: five stages from raw documents to packed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard, packing, pii, quality
from quire.llm.common import free_name, made_paths, release, table, written
from quire.llm.queries import PII_KEY, WORD_VOCABULARY


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "score")
    return quality.score(docs, model, name=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal numbers and dates."""
    return pii.pseudonymise(docs, PII_KEY)




def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of tokens."""
    return packing.pack(docs, WORD_VOCABULARY)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", unique_documents),
    ("benchmark decontamination", clean_documents),
    ("PII", private_documents),
    ("packing", packed_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read by the next.

    What a stage wrote besides its result is deleted when the result is there.
    """
    docs, others = table(spark, sf_dir, "documents"), made_paths()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            release(spark, keep=docs, besides=others)
    return docs


#: The stages use trained models, random projections and dynamic programming, which SQL cannot express.
ORACLE_SQL = None
