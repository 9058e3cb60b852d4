"""A training corpus in five stages: language, repeated lines, near copies, benchmark passages, source weights.

Every stage works on what the one before it kept. All but the last return the columns of documents; the last adds
`copies`, how often a document is to be taken. Each stage's result is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontaminate, language, line_dedup, mixture, near_dup
from matchloom.llm.tables import read, stored, unused


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those like no known language, go; `lang` becomes the language that the text tells."""
    return language.with_language(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out of the texts; texts of which nothing is left go. n_chars follows the text."""
    out = line_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id."""
    own = unused(docs, "_copy")
    gone = near_dup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(own), "left_anti")


def clear_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often."""
    return mixture.mixed(docs)


STAGES = [
    ("language", told_language),
    ("lines", fresh_lines),
    ("near copies", one_of_each),
    ("benchmark", clear_of_tests),
    ("mixture", weighted),
]

#: SQL cannot learn the language profiles; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
