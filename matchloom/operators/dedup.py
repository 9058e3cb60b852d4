"""Keep-first de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.sources.tables import materialise


def keep_first(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per distinct text: the one with the smallest `order`, which is unique.

    Texts are told apart by digests, and only (digest, order) is grouped, with a map-side combine, so a text that makes
    up a third of all rows costs its group no more than a rare one. The rows that come later are then taken out;
    where they are few Spark broadcasts them, and no text is moved.
    """
    narrow = df.select(F.unhex(F.sha2(F.col(text), 256)).alias("_digest"), F.col(order).alias("_order"))
    # Stored, so that the join with it can be split where a text is everywhere.
    repeated = narrow.groupBy("_digest").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest", "_first")
    later = narrow.join(materialise(repeated, "repeated"), "_digest").where(F.col("_order") > F.col("_first")).select("_order")
    # Stored, so that texts are digested once, however often the rows are used.
    later = materialise(later, "later")
    return df.join(later, F.col(order) == F.col("_order"), "left_anti")


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drops every row that has a null (or NaN) in any column."""
    return df.na.drop()
