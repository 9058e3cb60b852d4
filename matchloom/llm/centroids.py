"""Centroid clustering in whole numbers: a vantage-point tree over the centroids is built each round and searched best first."""

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
from matchloom.llm.tables import stored

CLUSTERS, ROUNDS, WIDTH, SEED = 8, 10, 64, 3
#: Vectors that are searched at once; the search holds a bound for each of them and each centroid.
SLICE = 4096
#: Distances are whole, their roots are not: what rounding could hide is searched too.
_SLACK = 1e-9

_LAST = np.iinfo(np.int64).max


class Node(NamedTuple):
    """A centroid and up to two subtrees, (node, least, greatest distance from this centroid) each."""

    point: int
    children: tuple[tuple[int, float, float], ...]


def vantage_tree(c: np.ndarray) -> list[Node]:
    """Nodes of a vantage-point tree over the rows of c, the root first. Each node's centroid parts the others at the median distance."""
    nodes: list[Node] = []

    def grow(members: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(Node(int(members[0]), ()))
        rest = members[1:]
        if len(rest):
            d = np.sqrt(integers.squared(c[rest], c[members[:1]])[:, 0].astype(np.float64))
            order = np.argsort(d, kind="stable")
            half = (len(rest) + 1) // 2
            parts = [p for p in (order[:half], order[half:]) if len(p)]
            nodes[at] = Node(int(members[0]), tuple((grow(rest[p]), float(d[p].min()), float(d[p].max())) for p in parts))
        return at

    if len(c):
        grow(np.arange(len(c)))
    return nodes


def nearest(x: np.ndarray, c: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances computed) of the rows of x; ties go to the smaller number.

    Every vector goes on with its own subtree of least bound until that bound exceeds its best distance; a bound equal
    to it is still searched, as a tie may lie there. Vectors that are at the same node are compared with it together.
    """
    bound = np.full((len(x), len(nodes)), np.inf)
    bound[:, 0] = 0
    best, who, seen = np.full(len(x), _LAST), np.full(len(x), -1), 0
    rows = np.arange(len(x))
    while len(rows):
        at = bound[rows].argmin(axis=1)
        low = bound[rows, at]
        go = low <= np.sqrt(best[rows].astype(np.float64))
        rows, at, low = rows[go], at[go], low[go]
        bound[rows, at] = np.inf
        for node in np.unique(at):
            own = at == node
            r, point = rows[own], nodes[node].point
            d2 = integers.squared(x[r], c[point : point + 1])[:, 0]
            seen += len(r)
            better = (d2 < best[r]) | ((d2 == best[r]) & (point < who[r]))
            best[r[better]], who[r[better]] = d2[better], point
            d = np.sqrt(d2.astype(np.float64))
            for child, least, most in nodes[node].children:
                bound[r, child] = np.maximum(low[own], np.maximum(d - most, least - d) - _SLACK * (d + most))
        rows = rows[np.isfinite(bound[rows].min(axis=1))]
    return who, best, seen


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), SLICE):
            yield batch.slice(lo, SLICE)


def _partial_sums(batches: Iterator[pa.RecordBatch], c: np.ndarray, nodes: list[Node]) -> Iterator[pa.RecordBatch]:
    """(x) -> one row a centroid: how many vectors of this task it has, and their sums."""
    count, total = np.zeros(len(c), np.int64), np.zeros_like(c)
    for batch in _slices(batches):
        x = integers.matrix(batch.column(0))
        n, s = integers.group_sums(x, nearest(x, c, nodes)[0], len(c))
        count += n
        total += s
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([
        pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], c: np.ndarray, nodes: list[Node]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        who, best, _ = nearest(integers.matrix(batch.column(1)), c, nodes)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])


def trained(points: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """points(vec_id, x), all of one length -> centroids (clusters, width); fewer vectors, fewer centroids.

    The start is the vectors of the least sha256 of `seed:vec_id`, one for each id (of an id's several vectors the
    least, component by component); null ids are drawn last. The driver and each task hold the centroids and their
    tree, clusters * width numbers, whatever the input; a round's sums are one row a centroid and task before they
    are shuffled.
    """
    hashed = points.select("vec_id", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h")).distinct()
    drawn = [r["vec_id"] for r in hashed.orderBy(F.col("h").asc_nulls_last()).limit(clusters).collect()]
    wanted = F.col("vec_id").isin([i for i in drawn if i is not None]) | (F.col("vec_id").isNull() & F.lit(None in drawn))
    start = {r["vec_id"]: r["x"] for r in points.where(wanted).groupBy("vec_id").agg(F.min("x").alias("x")).collect()}
    c = np.array([start[i] for i in drawn], np.int64)
    for _ in range(rounds if len(c) else 0):
        step = partial(_partial_sums, c=c, nodes=vantage_tree(c))
        sums = integers.summed(points.select("x").mapInArrow(step, "cluster int, n bigint, sums array<bigint>"), c.shape[1], "cluster")
        c = c.copy()
        for r in sums.collect():
            c[r["cluster"]] = np.array(r["sums"], np.int64) // r["n"]
    return c


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector kept.

    Kept are vectors of `width` components, none null, NaN or infinite; components become floor(1024 x), those beyond
    131,072 in size count as that. Lloyd's rounds in whole numbers: each vector goes to its nearest centroid by squared
    distance (ties: the smaller number), each centroid that has vectors to their floored mean; one that has none stays.
    A sum beyond 64 bits is null. Repeated rows each count; a null vec_id takes part and is drawn last as a start. No
    vector kept, no rows. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    points = stored(integers.whole(rows, "vec_id").where(F.size("x") == width), "points")
    c = trained(points, clusters, rounds, seed)
    final = partial(_assigned, c=c, nodes=vantage_tree(c))
    told = stored(points.mapInArrow(final, "vec_id bigint, cluster int, distance bigint"), "assigned")
    wide = F.col("distance").cast("decimal(38,0)")
    # One row a centroid.
    sums = [(r["cluster"], int(r["d"])) for r in told.groupBy("cluster").agg(F.sum(wide).alias("d")).collect()]
    fits = lambda n: n if n <= _LAST else None
    own = [(k, fits(n), fits(sum(m for _, m in sums)), hashlib.sha256(",".join(map(str, c[k].tolist())).encode()).hexdigest()) for k, n in sums]
    table = told.sparkSession.createDataFrame(own, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return told.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
