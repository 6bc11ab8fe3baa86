"""The corpus pipeline: stages over the documents, each reading what the one before it wrote.

Documents without a language go, then exact copies, then near copies (one document of each
group stays), and what is left is packed into training sequences. ``ORACLE_SQL`` is None: neither
the trained language classifier nor the packing can be stated in SQL; tests compare the stages with
brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlane.llm.exact_dedup import drop_copies
from cohortlane.llm.jaccard_join import one_of_each
from cohortlane.llm.language_id import drop_unidentified
from cohortlane.llm.queries import packed
from cohortlane.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return drop_copies(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a likeness of 0.8 the one with the smallest id stays."""
    return one_of_each(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/cohortlane/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
