"""Key terms of each document: by frequency, by TF-IDF weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_TERMS = 10


def top_terms(scored: DataFrame, key: str, by: str, k: int = TOP_TERMS, term: str = "term", ascending: bool = False) -> DataFrame:
    """The k best terms per document, with `rank`; of equal scores the smaller term."""
    first = F.asc(by) if ascending else F.desc(by)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(first, term)))
    return ranked.where(F.col("rank") <= k)
