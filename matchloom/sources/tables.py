"""Table reads and the write-once sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from matchloom import fixed_values as V
from matchloom.session import ensure_checkpoint_dir


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out when a table has fewer input splits than the cluster has cores.

    The operators here are heavy per row, so a small table in one row group would keep one core busy.
    AQE sizes the result from the bytes it sees; a large table has plenty of splits and is left alone.
    """
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.hint("rebalance") if few else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.parquet(path))


def materialise_once(df: DataFrame, path: str) -> DataFrame:
    """Writes `df` unless the path already holds a table, and reads the path either way."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def role_dimension(spark: SparkSession, roles: list[tuple[str, str]] | None = None) -> DataFrame:
    """(role, source): the roles on offer and where the description of each comes from."""
    return spark.createDataFrame(roles or V.ROLES, "role string, source string")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once below the shared checkpoint folder and reads it back.

    Cuts the lineage of what is used many times, in a place that outlives any executor.
    """
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
