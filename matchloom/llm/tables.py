"""Scratch tables in the shared folder, and removal of those of a finished iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.sources.tables import scratch_folder


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` below the shared checkpoint folder and reads it back: the lineage ends in a file that outlives executors."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    back = df.sparkSession.read.schema(df.schema).parquet(folder)
    back._scratch = folder
    return back


def forget(df: DataFrame) -> None:
    """Deletes a table made by stored() that no later plan reads."""
    folder = getattr(df, "_scratch", None)
    if folder:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
