"""Records of CSV files whose quoted values span lines, read by as many tasks as the files have splits.

Whether a line begins inside a quoted value depends on the quotes before it, in its file, being odd or even in number.
The first pass counts the quotes of each split; their running parity, a row for each split, says how every split
begins. The second pass joins lines to records within its split; a record that crosses a split's border comes as
fragments, which are put together by a key of their own. No line is shuffled but those of such records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.sources.tables import materialise

#: Records that begin and end in one split; the beginning of one that goes on; a stretch that goes on from the split before.
WHOLE, HEAD, REST = 0, 1, 2

#: row_id has the number of the split above these bits, the record's place in it below.
PLACE_BITS = 33

_SCHEMA = "split bigint, place bigint, kind int, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): a task reads its splits from start to end, so rows come in file order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def splits(lines: DataFrame) -> DataFrame:
    """(file, start, split, inside): splits in the order of file name and offset, and whether each begins inside a quoted value."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    # A row for each split: the window without partition numbers some ten rows a gigabyte.
    return counted.select("file", "start", inside.alias("inside"), F.row_number().over(Window.orderBy("file", "start")).cast("bigint").alias("split"))


class _Open:
    """The lines of the split that is being read which no record has taken yet."""

    def __init__(self, split: int, inside: bool):
        self.split, self.lines, self.inside, self.place, self.begun = split, [], inside, 0, not inside

    def take(self, lines: pa.Array) -> list[tuple[int, int, int, str]]:
        text = lines.to_pylist()
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        odd = (np.cumsum(quotes) + self.inside) % 2
        out, lo = [], 0
        for end in np.flatnonzero(odd == 0).tolist():
            record = "\n".join([*self.lines, *text[lo : end + 1]])
            if not self.begun:
                out.append((self.split, -1, REST, record))
            elif record.strip("\r"):
                out.append((self.split, self.place, WHOLE, record))
                self.place += 1
            self.lines, self.begun, lo = [], True, end + 1
        self.lines += text[lo:]
        self.inside = bool(odd[-1]) if len(odd) else self.inside
        return out

    def end(self) -> list[tuple[int, int, int, str]]:
        return [(self.split, self.place, HEAD if self.begun else REST, "\n".join(self.lines))] if self.lines else []


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(split, inside, line) in file order -> records and fragments."""
    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["split", "place", "kind", "record"])

    now: _Open | None = None
    for batch in batches:
        split = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(split)) + 1).tolist(), len(split)] if len(split) else []
        rows: list[tuple] = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if now is None or now.split != split[lo]:
                rows += now.end() if now else []
                now = _Open(int(split[lo]), batch.column(1)[lo].as_py())
            rows += now.take(batch.column(2).slice(lo, hi - lo))
        yield out(rows)
    if now is not None:
        yield out(now.end())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, record, first): the records of all files below `path`, without line end; row_id grows with file name and place in the file, first marks a file's first record.

    Lines end at a line feed, with or without a carriage return before it; inside a quoted value line ends stay as they
    are. A quote inside a value is written twice. A quoted value that is never closed ends with its file. Blank lines
    between records are none. The table that says how splits begin is broadcast: a row for each split, some 100 bytes
    for each spark.sql.files.maxPartitionBytes of input.
    """
    lines = _lines(spark, path)
    begins = materialise(splits(lines), "csv_splits")
    # The line side streams through the broadcast join, so it stays in file order.
    told = lines.join(F.broadcast(begins), ["file", "start"]).select("split", "inside", "line")
    found = materialise(told.mapInArrow(_joined, _SCHEMA), "csv_records")

    row_id = F.shiftleft("split", PLACE_BITS).bitwiseOR(F.col("place"))
    whole = found.where(F.col("kind") == WHOLE).select(row_id.alias("row_id"), "record")
    parts = found.where(F.col("kind") != WHOLE)
    # What belongs together is numbered from the places alone: a rest goes to the last head before it.
    at = Window.partitionBy("file").orderBy("split", F.desc("kind"))
    head = F.last(F.when(F.col("kind") == HEAD, row_id), ignorenulls=True).over(at)
    numbered = parts.select("split", "kind", "place").join(begins.select("split", "file"), "split").select("split", "kind", head.alias("row_id"))
    crossing = parts.select("split", "kind", "record").join(numbered, ["split", "kind"]).groupBy("row_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "record"))), lambda p: p["record"]), "\n").alias("record"))
    tops = begins.where("start = 0").select(F.shiftleft("split", PLACE_BITS).alias("top"))
    every = whole.unionByName(crossing).join(tops, F.col("row_id") == F.col("top"), "left")
    return every.select("row_id", F.regexp_replace("record", "\r$", "").alias("record"), F.col("top").isNotNull().alias("first"))
