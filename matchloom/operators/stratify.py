"""Exact ranks within a category, without ever sorting a whole category in one task."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.sources.tables import materialise

# First hex digits of the digest that form a bucket: 16^3 slices per category.
BUCKET_DIGITS = 3


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def shuffled_rank(df: DataFrame, category: str, key: str, seed: int = V.RANDOM_STATE) -> DataFrame:
    """Adds `rank` (1..n in the category, ordered by a seeded digest of the key) and `category_size`.

    A category may hold a third of all rows, so it is cut into digest slices: the rank is the number of
    rows in earlier slices plus the place in the own slice. Slice counts are at most 4096 rows per
    category, and a slice is the only thing that is sorted.
    """
    rows = df.withColumn("_digest", _digest(key, seed)).withColumn("_slice", F.substring("_digest", 1, BUCKET_DIGITS))
    counts = rows.groupBy(category, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(category)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        category, "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_n").over(whole).alias("category_size"),
    )
    place = F.row_number().over(Window.partitionBy(category, "_slice").orderBy("_digest", key))
    return (
        rows.join(starts, [category, "_slice"])
        .withColumn("rank", F.col("_start") + place)
        .drop("_digest", "_slice", "_start")
        .select(*df.columns, "rank", "category_size")
    )


def held_out(share: float = V.TEST_SHARE) -> Column:
    """True for the test part: the first round(share * n) rows of each category."""
    return F.col("rank") <= F.round(F.col("category_size") * share)


class HeldOut(NamedTuple):
    """bounds(_category, _last): a row a category, the last digest and key of its test part; flag: whether a row joined with it is in that part."""

    bounds: DataFrame
    flag: Column


def held_out_flag(df: DataFrame, category: str, key: str, share: float = V.TEST_SHARE, seed: int = V.RANDOM_STATE) -> HeldOut:
    """The test part of held_out() as a bound for each category, so that rows need no rank of their own."""
    ranked = shuffled_rank(df.select(key, category), category, key, seed).where(held_out(share))
    place = F.struct(_digest(key, seed).alias("digest"), F.col(key).alias("key"))
    bounds = materialise(ranked.groupBy(F.col(category).alias("_category")).agg(F.max(place).alias("_last")), "test_bounds")
    return HeldOut(bounds, F.coalesce(place <= F.col("_last"), F.lit(False)))


def fold(n: int = V.CALIBRATION_FOLDS) -> Column:
    """Stratified fold 0..n-1: rows of a category are dealt out in rank order."""
    return F.pmod(F.col("rank") - 1, F.lit(n)).cast("int")
