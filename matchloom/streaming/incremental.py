"""Only new or changed files are worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchloom.functions.text import fingerprint


def with_fingerprint(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    return files.withColumn("fingerprint", fingerprint(F.col(path), F.col(size)))


def only_new(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose name and size are not among those already worked on."""
    return files.join(done.select("fingerprint"), "fingerprint", "left_anti")


def process_stream(
    arrivals: DataFrame, work: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Runs `work` on the new files of each micro-batch and keeps its rows under `results`.

    `arrivals` is a stream with `fingerprint`. Which fingerprints were seen is the stream's keyed state: it lies with
    the checkpoint, is looked up by key, and remembers files for which `work` gave no rows. Each batch owns the folder
    batch=<id> and overwrites it, so a batch that is repeated after a failure leaves no doubles. A checkpoint that
    cannot be read stops the stream.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{results.rstrip('/')}/batch={batch_id}")

    fresh = arrivals.dropDuplicates(["fingerprint"])
    return fresh.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
