"""A training-corpus pipeline: stages over the columns of ``documents``, each written and read again.

1. ``language_id`` drops documents without an identifiable language.
2. ``line_dedup`` takes out lines that spread over many sources; ``n_chars`` follows the text.
3. ``simhash`` keeps one document of each group of near duplicates.
4. ``mixing`` repeats documents so that source weights meet the repetition limit; none is lost.
5. ``packing`` returns the pieces that training sequences are made of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.common import materialize
from ferrolith.llm.language_id import keep_identified, train
from ferrolith.llm.line_dedup import dedup_lines
from ferrolith.llm.mixing import mix_documents
from ferrolith.llm.packing import pack_documents
from ferrolith.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash", simhash),
    ("mixing", mixing),
    ("packing", packing),
]

#: Mixture inference, fingerprints and the tokenizer are beyond SQL; a test holds every stage, and run(), against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
