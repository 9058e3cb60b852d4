"""Vectors as whole numbers: floor(1024 x), exact squared distances, and sums by group on Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Components beyond this are set to it: then a squared distance over 64 components fits in 63 bits.
TOP = 1 << 27
#: Below this, products in doubles are whole numbers without rounding.
_SMALL = 1 << 22


def whole(vectors: DataFrame, *columns: str) -> DataFrame:
    """vectors(embedding, *columns) -> (*columns, x array<int>): the rows whose vector is not null and holds neither null nor non-finite components."""
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    number = lambda c: F.floor(F.least(F.greatest(c, F.lit(-TOP / SCALE)), F.lit(TOP / SCALE)) * SCALE).cast("int")
    return vectors.where(fine).select(*columns, F.transform(v, number).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as int64 rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x (n, w) to those of c (m, w), as int64 (n, m)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _SMALL:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for k in range(x.shape[1]):
        gap = x[:, k, None] - c[:, k]
        out += gap * gap
    return out


def group_sums(x: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Row counts (groups,) and exact sums (groups, w) of the rows of x by group."""
    order = np.argsort(group, kind="stable")
    there, first = np.unique(group[order], return_index=True)
    count, total = np.zeros(groups, np.int64), np.zeros((groups, x.shape[1]), np.int64)
    if len(there):
        count[there] = np.diff([*first, len(group)])
        total[there] = np.add.reduceat(x[order], first, axis=0)
    return count, total


def summed(partial: DataFrame, width: int, *keys: str) -> DataFrame:
    """partial(*keys, n, sums) of all tasks -> one row a key."""
    return partial.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", i)) for i in range(width)]).alias("sums"))


def long_or_null(total: Column) -> Column:
    """A sum of longs that null stands for where it leaves 64 bits."""
    return total.try_cast("bigint")
