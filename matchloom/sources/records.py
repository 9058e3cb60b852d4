"""The training record as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import fixed_values as V

RECORD_SCHEMA = (
    "n_resumes bigint, n_categories bigint, holdout_top1_accuracy double, holdout_top3_accuracy double, "
    "holdout_macro_f1 double, trained_at string"
)


def write_metrics(record: DataFrame, path: str) -> None:
    """One row, one file."""
    record.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The record, or no row when the file is missing or is not valid JSON."""
    try:
        return spark.read.schema(RECORD_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD_SCHEMA)


def with_display_defaults(record: DataFrame) -> DataFrame:
    """Missing fields get the value that is shown for them."""

    def shown(name: str, default):
        as_text = isinstance(default, str)
        return F.coalesce(F.col(name).cast("string") if as_text else F.col(name), F.lit(default)).alias(name)

    return record.select(*[shown(n, d) for n, d in V.METRICS_DEFAULTS.items()])
