"""A corpus in four stages: language, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.exact_dedup import deduplicated
from flowsieve.llm.language import identified
from flowsieve.llm.minhash import near_duplicates
from flowsieve.llm.packing import packed
from flowsieve.session import written

#: A document stays if its words agree on a language at least this much.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or with words of no prevailing language go."""
    good = identified(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return good.select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, the one with the largest doc_id."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies (five words, similarity 0.8), the one with the smallest doc_id."""
    stay = written(near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct(), "near-kept")
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_id"]), "left_semi")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, placed in sequences of at most 4096 tokens."""
    return packed(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: A trained model's decisions cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
