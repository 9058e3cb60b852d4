"""Repeated runs of lines by a suffix array over line-ID sequences, built by distributed prefix doubling.

A line is deleted when it lies in a run of lines that has occurred before and holds min_chars characters. A repeated run
of that size is covered by shortest windows that are: the shortest from its first line on, and the shortest up to each
of its lines that reach back no further. So two windows a line tell every maximal run, whatever its length. Two windows of l lines are equal
where the suffixes at both their ends' stretches of 2^k <= l lines have equal ranks: they lie in one interval of the
suffix array whose longest common prefix is l lines or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.tables import forget, stored, unused

#: A repeated run counts from so many characters of its lines on.
MIN_CHARS = 50
#: Lines that are put into one batch.
BATCH = 1 << 16

_AT = ["doc_id", "version", "pos"]
_LINES = "doc_id bigint, version bigint, pos int, h1 bigint, h2 bigint, ahead int, behind int"


def windows(chars: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, how many lines the shortest window with `least` characters has that begins there, and that ends there; 0: none."""
    n, upto = len(chars), np.concatenate([[0], np.cumsum(chars)])
    stop = np.searchsorted(upto, upto[:-1] + least, "left")
    start = np.searchsorted(upto, upto[1:] - least, "right") - 1
    at = np.arange(n)
    return np.where(stop <= n, np.maximum(stop - at, 1), 0), np.where(upto[1:] >= least, np.minimum(at + 1 - start, at + 1).clip(1), 0)


def _split(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, version, text) -> a row a line: two hashes of it, and its windows()."""
    for batch in batches:
        for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            lines = text.as_py().split("\n")
            ahead, behind = windows(np.fromiter(map(len, lines), np.int64, len(lines)), least)
            for lo in range(0, len(lines), BATCH):
                part = lines[lo : lo + BATCH]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode()) for x in part), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(part), doc)), pa.array(np.full(len(part), version)), pa.array(np.arange(lo, lo + len(part), dtype=np.int32)),
                    pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1])),
                    pa.array(ahead[lo : lo + BATCH].astype(np.int32)), pa.array(behind[lo : lo + BATCH].astype(np.int32))], [
                    "doc_id", "version", "pos", "h1", "h2", "ahead", "behind"])


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs(doc_id, text) -> stored (doc_id, version, pos, h1, h2, ahead, behind), one row for each line of each different document.

    version tells texts apart that share a doc_id; repeated rows are one document. Null ids and null texts have no lines here.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("version"), "text")
    return stored(rows.mapInArrow(lambda batches: _split(batches, min_chars), _LINES).distinct(), "lines")


def _ranked(suffixes: DataFrame, first: str, second: str) -> DataFrame:
    """Suffixes whose key (first, second) occurs again, with the key's rank in key order.

    A key that occurs once needs no rank: its suffixes share no longer prefix. Keys are sorted by range over all
    tasks; their running number is a rank that keeps the order, whatever its gaps.
    """
    keys = suffixes.groupBy(first, second).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = stored(keys.repartitionByRange(first, second).sortWithinPartitions(first, second).select(
        F.col(first).alias("k1"), F.col(second).alias("k2"), F.monotonically_increasing_id().alias("place")), "ranks")
    return suffixes.join(keys, (F.col(first) == F.col("k1")) & (F.col(second) == F.col("k2"))).select(*_AT, F.col("place").alias("rank"))


def intervals(lines: DataFrame, longest: int | None = None) -> list[DataFrame]:
    """Level k of the suffix array: (doc_id, version, pos, rank) of the suffixes whose first 2^k lines occur again.

    Suffixes of one rank are one interval of the array, with a longest common prefix of at least 2^k lines; ranks of a
    level are in suffix order. Level k + 1 pairs a suffix's rank with that of the suffix 2^k lines on and ranks the
    pairs. Suffixes that became unique are left out, so each level is smaller than the one before; the levels end
    where nothing is repeated, or with the last that prefixes of `longest` lines need.
    """
    out = [stored(_ranked(lines, "h1", "h2"), "suffixes")]
    ahead = 1
    while (longest is None or 2 * ahead <= longest) and out[-1].limit(1).count():
        level = out[-1]
        later = level.select("doc_id", "version", (F.col("pos") - ahead).alias("pos"), F.col("rank").alias("then"))
        pairs = stored(level.join(later, _AT).select(*_AT, "rank", "then"), "pairs")
        out.append(stored(_ranked(pairs, "rank", "then"), "suffixes"))
        forget(pairs)
        ahead *= 2
    return out if out[-1].limit(1).count() else out[:-1]


def repeated_windows(lines: DataFrame) -> DataFrame:
    """line_table() -> (doc_id, version, pos, size) of the windows that have occurred before, in the order of (doc_id, version, pos)."""
    begun = lines.where("ahead > 0").select(*_AT, F.col("ahead").alias("size"))
    ended = lines.where("behind > 0").select("doc_id", "version", (F.col("pos") - F.col("behind") + 1).alias("pos"), F.col("behind").alias("size"))
    every = stored(begun.unionByName(ended).distinct(), "windows")
    longest = every.agg(F.max("size")).first()[0] or 0
    same = None
    for k, level in enumerate(intervals(lines, longest)):
        own = every.where((F.col("size") >= 1 << k) & (F.col("size") < 2 << k))
        head = level.withColumnRenamed("rank", "r1")
        tail = level.select("doc_id", "version", F.col("pos").alias("last"), F.col("rank").alias("r2"))
        met = own.join(head, _AT).withColumn("last", F.col("pos") + F.col("size") - (1 << k)).join(tail, ["doc_id", "version", "last"])
        met = met.select(*_AT, "size", "r1", "r2")
        same = met if same is None else same.unionByName(met)
    if same is None:
        return every.limit(0)
    same = stored(same, "window_ranks")
    # r1 and r2 are ranks of the level that size names. Stored, so that the join can be split where a window is everywhere.
    firsts = stored(same.groupBy("size", "r1", "r2").agg(F.min(F.struct(*_AT)).alias("first_at"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first_windows")
    return same.join(firsts, ["size", "r1", "r2"]).where(F.struct(*_AT) != F.col("first_at")).select(*_AT, "size")


def deletions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, version, deleted): positions of the lines to delete, ascending, for documents that have any.

    Deleted is each line that lies in a run of lines, of any length, with at least min_chars characters that has
    occurred before, in the order of (doc_id, version, position); runs may overlap. The first copy stays. Runs do not
    cross documents. Two texts under one doc_id are two documents.
    """
    gone = repeated_windows(line_table(docs, min_chars))
    # Overlapping windows become one stretch before lines are listed, so a line is listed once.
    before = Window.partitionBy("doc_id", "version").orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "version").orderBy("pos", "size")
    marked = gone.withColumn("opens", (F.col("pos") > F.coalesce(F.max(F.col("pos") + F.col("size")).over(before), F.lit(-1))).cast("int"))
    stretches = marked.withColumn("k", F.sum("opens").over(upto)).groupBy("doc_id", "version", "k").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("size")).alias("hi"))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda s: F.sequence(s["lo"], s["hi"] - 1)))
    return stretches.groupBy("doc_id", "version").agg(listed.alias("deleted"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_lines, n_deleted, deleted), one row per row; deleted holds positions, comma-joined.

    Null text: 0 lines. Empty text: one empty line. A null doc_id takes part in no comparison and loses nothing.
    Repeated rows are one document and each get its result. Other columns are not read. No rows, no rows.
    """
    rows = _rows(docs)
    gone = deletions(rows).withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    counted = rows.select("doc_id", F.xxhash64("text").alias("version"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"))
    counted = counted.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("bigint")))
    out = counted.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    none = F.array().cast("array<int>")
    deleted = F.coalesce("deleted", none)
    return out.select("doc_id", "n_lines", F.size(deleted).cast("bigint").alias("n_deleted"), F.array_join(deleted.cast("array<string>"), ",").alias("deleted"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with the deleted lines taken out of `text`; a document that loses its last line with any character goes.

    Other columns, whatever their names, stay as they are. Rows without an id or a text stay.
    """
    own = {c: unused(docs, c) for c in ("_id", "_version", "_deleted", "_lines", "_left")}
    gone = deletions(_rows(docs)).select(F.col("doc_id").alias(own["_id"]), F.col("version").alias(own["_version"]), F.col("deleted").alias(own["_deleted"]))
    deleted, left = F.col(own["_deleted"]), F.col(own["_left"])
    keys = (F.col("doc_id").cast("bigint") == F.col(own["_id"])) & (F.xxhash64(F.col("text").cast("string")) == F.col(own["_version"]))
    # array_except works through a hash set, so a text of many lines is not compared position by position.
    places = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), deleted)
    kept = F.transform(places, lambda i: F.get(F.col(own["_lines"]), i))
    out = docs.join(gone, keys, "left").withColumn(own["_lines"], F.when(deleted.isNotNull(), F.split("text", "\n")))
    out = out.withColumn(own["_left"], F.when(deleted.isNotNull(), F.array_join(kept, "\n")))
    out = out.where(left.isNull() | (F.length(F.trim(left)) > 0))
    return out.withColumn("text", F.coalesce(left, "text")).select(docs.columns)
