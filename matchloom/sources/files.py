"""Directory scans with a user function per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = "filename string, result string, error string"


def any_case(suffix: str) -> str:
    """Glob that matches the suffix in either case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def scan_directory(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, filename, size, content) of the files right in the folder; no folder, no rows."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", any_case(suffix)).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, filename string, size bigint, content binary")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), "content")


def process_files(files: DataFrame, fn: Callable[[str, bytes], str | None]) -> DataFrame:
    """(filename, result, error): fn(filename, content) per file. A file that fails has a null result.

    Files travel to Python a few at a time: see `spark.sql.execution.arrow.maxBytesPerBatch`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["filename"], batch["content"]):
                try:
                    rows.append((name, fn(name, bytes(content)), None))
                except Exception as e:  # one bad file must not end the others
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["filename", "result", "error"])

    return files.select("filename", "content").mapInPandas(run, RESULT_SCHEMA)
