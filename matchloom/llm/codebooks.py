"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, found by norm-of-sum bounds and exact rescans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import integers
from matchloom.llm.tables import forget, stored

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Consecutive codebook entries that share a lower bound. A bound an entry would be tighter, and sixteen times as much to keep.
GROUP = 16
#: Bounds are roots of whole numbers in doubles: each is moved by this share to the safe side.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12

_STATE = "vec_id bigint, label bigint, x array<int>, code binary, upper binary, lower binary, stamps binary, scanned bigint"
_NAMES = ["vec_id", "label", "x", "code", "upper", "lower", "stamps", "scanned"]


class Bounds(NamedTuple):
    """What a part of many vectors knows: its entry, a bound above the distance to it, bounds below those to the other
    entries of each group, and for each bound the number of the codebook that it was computed with (the first column
    of `stamps` belongs to `upper`)."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    stamps: np.ndarray


def _groups(entries: int) -> list[slice]:
    return [slice(lo, min(lo + GROUP, entries)) for lo in range(0, entries, GROUP)]


def unknown(n: int, entries: int) -> Bounds:
    groups = len(_groups(entries))
    return Bounds(np.zeros(n, np.int64), np.full(n, np.inf), np.full((n, groups), -np.inf), np.zeros((n, groups + 1), np.uint8))


def displacements(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry of each earlier codebook lies from where it is now, (rounds, entries), and the most of each group, (rounds, groups).

    This is the norm of the sum of an entry's moves. The sum of their norms, which bounds that are carried on from
    round to round add up, is at least as large, so a bound that keeps its round's stamp stays tighter.
    """
    gap = np.stack([h - history[-1] for h in history]).astype(np.float64)
    moved = np.sqrt((gap * gap).sum(axis=2)) * _UP
    return moved, np.stack([moved[:, g].max(axis=1) for g in _groups(moved.shape[1])], axis=1)


def assign(x: np.ndarray, history: list[np.ndarray], known: Bounds) -> tuple[Bounds, int]:
    """Entries of history[-1] nearest to the rows of x (ties: the lower index), the bounds now known, and the entry distances computed.

    A row keeps its entry where every lower bound, less what its group has moved since the bound's round, still exceeds
    the upper bound, plus what its entry has moved since then. Else its own distance is computed anew, and then each
    group that still can hold a nearer or equal entry is scanned.
    """
    now, c = len(history) - 1, history[-1]
    moved, most = displacements(history)
    code, upper, lower, stamps = (a.copy() for a in known)
    high = (upper + moved[stamps[:, 0], code]) * _UP
    low = lower - most[stamps[:, 1:], np.arange(most.shape[1])]
    rows = np.flatnonzero((low <= high[:, None]).any(axis=1))
    own = x[rows]
    gap = own - c[code[rows]]
    best, who = (gap * gap).sum(axis=1), code[rows].copy()
    was, was_d = code[rows], np.sqrt(best.astype(np.float64))
    low = low[rows]
    scan = low <= (was_d * _UP)[:, None]
    first, second, at = low.copy(), low.copy(), np.full(scan.shape, -1)
    scanned = len(rows)
    for g, members in enumerate(_groups(len(c))):
        r = np.flatnonzero(scan[:, g])
        if not len(r):
            continue
        d2 = integers.squared(own[r], c[members])
        scanned += d2.size
        k = d2.argmin(axis=1)
        d = d2[np.arange(len(r)), k]
        at[r, g] = members.start + k
        first[r, g] = np.sqrt(d.astype(np.float64)) * _DOWN
        d2[np.arange(len(r)), k] = np.iinfo(np.int64).max
        second[r, g] = np.sqrt(d2.min(axis=1).astype(np.float64)) * _DOWN
        better = (d < best[r]) | ((d == best[r]) & (members.start + k < who[r]))
        best[r[better]], who[r[better]] = d[better], (members.start + k)[better]
    # A scanned group's bound is its least distance, or its second least where the least is the row's entry.
    bound = np.where(at == who[:, None], second, first)
    # The entry that a row leaves counts among the others of its group again.
    left = np.flatnonzero((who != was) & ~scan[np.arange(len(rows)), was // GROUP])
    bound[left, was[left] // GROUP] = np.minimum(bound[left, was[left] // GROUP], was_d[left] * _DOWN)
    fresh = scan.copy()
    fresh[left, was[left] // GROUP] = True
    code[rows], upper[rows] = who, np.sqrt(best.astype(np.float64)) * _UP
    lower[rows] = np.where(fresh, bound, lower[rows])
    stamps[rows, 0] = now
    stamps[rows, 1:] = np.where(fresh, now, stamps[rows, 1:])
    return Bounds(code, upper, lower, stamps), scanned


def cuts(width: int, parts: int) -> list[slice]:
    """Consecutive parts of a vector, equal where `parts` divides its width, else the first ones longer by one."""
    ends = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(width), parts))])
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:], strict=False)]


def _blob(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _unblob(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _step(batches: Iterator[pa.RecordBatch], history: list[list[np.ndarray]], where: list[slice]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, x) or a state table's rows -> the state after the codebooks history[part][-1]."""
    entries = len(history[0][-1])
    groups, parts = len(_groups(entries)), len(where)
    for batch in batches:
        n = len(batch)
        x = integers.matrix(batch.column(2))
        if batch.num_columns == 3:
            known = [unknown(n, entries)] * parts
        else:
            code, upper = _unblob(batch.column(3), np.uint8, (parts,)), _unblob(batch.column(4), np.float64, (parts,))
            lower, stamps = _unblob(batch.column(5), np.float64, (parts, groups)), _unblob(batch.column(6), np.uint8, (parts, groups + 1))
            known = [Bounds(code[:, p].astype(np.int64), upper[:, p], lower[:, p], stamps[:, p]) for p in range(parts)]
        new = [assign(x[:, w], history[p], known[p]) for p, w in enumerate(where)]
        cell = lambda i, kind: _blob(np.stack([b[i] for b, _ in new], axis=1).astype(kind))
        scanned = sum(s for _, s in new)
        yield pa.RecordBatch.from_arrays([
            *batch.columns[:3], cell(0, np.uint8), cell(1, np.float64), cell(2, np.float64), cell(3, np.uint8),
            pa.array([scanned] + [0] * (n - 1) if n else [], pa.int64())], _NAMES)


def _partial_sums(batches: Iterator[pa.RecordBatch], entries: int, where: list[slice]) -> Iterator[pa.RecordBatch]:
    """(x, code) -> one row for each part and entry that this task has vectors of."""
    count = np.zeros((len(where), entries), np.int64)
    total = [np.zeros((entries, w.stop - w.start), np.int64) for w in where]
    for batch in batches:
        x, code = integers.matrix(batch.column(0)), _unblob(batch.column(1), np.uint8, (len(where),))
        for p, w in enumerate(where):
            n, s = integers.group_sums(x[:, w], code[:, p].astype(np.int64), entries)
            count[p] += n
            total[p] += s
    part, entry = np.nonzero(count)
    yield pa.RecordBatch.from_arrays([
        pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]),
        pa.array([total[p][e] for p, e in zip(part, entry, strict=True)], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])


def _told(batches: Iterator[pa.RecordBatch], history: list[list[np.ndarray]], where: list[slice]) -> Iterator[pa.RecordBatch]:
    """A state table's rows -> (vec_id, label, code, error) with the last codebooks."""
    for batch in _step(batches, history, where):
        x, code = integers.matrix(batch.column(2)), _unblob(batch.column(3), np.uint8, (len(where),))
        error = np.zeros(len(batch), np.int64)
        for p, w in enumerate(where):
            gap = x[:, w] - history[p][-1][code[:, p]]
            error += (gap * gap).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], [
            "vec_id", "label", "code", "error"])


def _common_width(points: DataFrame) -> int:
    top = points.where(F.size("x") > 0).groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    return top[0]["w"] if top else 0


class Trained(NamedTuple):
    """history[part] holds that part's codebook of every round, the last one last; state is the table of the last assignment."""

    history: list[list[np.ndarray]]
    state: DataFrame
    where: list[slice]


def trained(points: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Trained:
    """points(vec_id, label, x), all `width` wide and at least one row -> codebooks after `rounds` rounds.

    The start is the vectors of the `entries` least ids, one for each id (of an id's several vectors the least, component
    by component; a null id is the greatest). The driver and each task hold the codebooks of all rounds, at most
    (rounds + 1) * entries * width numbers, whatever the input. Bounds go from round to round in the state table; a
    round's sums are at most parts * entries rows a task before they are shuffled.
    """
    where = cuts(width, parts)
    ids = [r["vec_id"] for r in points.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    last = max((i for i in ids if i is not None), default=None)
    wanted = F.coalesce(F.col("vec_id") <= F.lit(last).cast("bigint"), F.lit(False)) | (F.col("vec_id").isNull() & F.lit(None in ids))
    start = {r["vec_id"]: r["x"] for r in points.where(wanted).groupBy("vec_id").agg(F.min("x").alias("x")).collect()}
    first = np.array([start[i] for i in ids], np.int64)
    history = [[first[:, w]] for w in where]
    state = points
    for _ in range(rounds):
        new = stored(state.mapInArrow(partial(_step, history=[list(h) for h in history], where=where), _STATE), "codes")
        if state is not points:
            forget(state)
        state = new
        step = partial(_partial_sums, entries=len(first), where=where)
        partials = state.select("x", "code").mapInArrow(step, "part int, entry int, n bigint, sums array<bigint>")
        books = [h[-1].copy() for h in history]
        for r in integers.summed(partials, max(w.stop - w.start for w in where), "part", "entry").collect():
            own = books[r["part"]]
            own[r["entry"]] = np.array(r["sums"][: own.shape[1]], np.int64) // r["n"]
        for h, book in zip(history, books, strict=True):
            h.append(book)
    return Trained(history, state, where)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, code, error, label_error, codebooks_sha256), one row for each vector kept.

    Kept are vectors that are not null and hold neither null, NaN nor infinite components; components become
    floor(1024 x), those beyond 131,072 in size count as that. Vectors of another length than most (ties: the
    shorter), and empty ones, have no place in the codebooks and are dropped. code has two hex digits a part; error is the
    squared distance to the coded vector, label_error its sum over the label (null labels together; null beyond 64
    bits). Repeated rows each count. `entries` is at most 256; fewer ids, fewer entries. No vector kept, no rows. Other
    columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    points = stored(integers.whole(rows, "vec_id", "label"), "points")
    width = _common_width(points)
    if not width:
        return points.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"),
                             F.lit("").alias("codebooks_sha256")).where("false")
    model = trained(points.where(F.size("x") == width), width, parts, entries, rounds)
    last = partial(_told, history=model.history, where=model.where)
    told = stored(model.state.mapInArrow(last, "vec_id bigint, label bigint, code string, error bigint"), "told")
    digest = hashlib.sha256(",".join(str(v) for h in model.history for v in h[-1].reshape(-1).tolist()).encode()).hexdigest()
    # Stored, so that the join can be split where many vectors share a label.
    sums = stored(told.groupBy(F.col("label").alias("own_label")).agg(
        integers.long_or_null(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")), "label_errors")
    return told.join(sums, F.col("label").eqNullSafe(F.col("own_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
