"""Labelled corpus in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom import fixed_values as V
from matchloom.operators.dedup import drop_incomplete, keep_first
from matchloom.sources.csv_records import read_records

# multiLine keeps line ends inside values as they are.
_OPTIONS = {"multiLine": "true", "escape": '"', "header": "false"}


def _columns(spark: SparkSession, path: str) -> list[str]:
    """Names of the first record of the first file."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns


def read_labelled_csv(spark: SparkSession, path: str, text: str = "Text", category: str = "Category") -> DataFrame:
    """(row_id, text, category) without incomplete rows.

    Columns go by their header name, each file begins with the same header, and quoted text may span lines. A row is
    dropped when any of its columns is empty or spells a missing value. `row_id` grows with file name and place in
    the file. A file is read by as many tasks as it has splits.
    """
    names = _columns(spark, path)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    records = read_records(spark, path)
    parsed = records.where(~F.col("first")).select("row_id", F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), _OPTIONS).alias("r"))
    rows = parsed.select("row_id", *[F.col("r")[f"c{i}"].alias(n) for i, n in enumerate(names)])
    clean = rows.select("row_id", *[F.when(~F.col(n).isin(V.NA_TOKENS), F.col(n)).alias(n) for n in names])
    return drop_incomplete(clean).select("row_id", F.col(text).alias("text"), F.col(category).alias("category"))


def read_corpus(spark: SparkSession, path: str, text: str = "Text", category: str = "Category") -> DataFrame:
    """The labelled rows, each distinct text once: its first occurrence, with that row's category."""
    return keep_first(read_labelled_csv(spark, path, text, category), "text", "row_id")


def write_labelled_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
