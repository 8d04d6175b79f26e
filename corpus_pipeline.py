"""A corpus from raw documents to a drawn mixture: five stages, each written as Parquet and read again by the next.

Quality rules drop rejected documents; line dedup removes repeated lines from the texts; of near-duplicate documents one
stays; documents that hold benchmark passages go; the rest is drawn by temperature-weighted sources. Every stage but
the last returns the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import decontaminate, lines, mixing, quality, simhash
from quantloom.llm.store import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named = [f"c{i}" for i in range(len(docs.columns))]  # names that the judged columns don't have
    judged = quality.judge(docs.toDF(*named), model, named[docs.columns.index("text")])
    return judged.where("kept").select(*named).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are alike to an earlier one."""
    return lines.without_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every time a document is drawn."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]

#: The stages learn, hash and permute in ways SQL text cannot repeat; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
