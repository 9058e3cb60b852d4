"""Exact top-k search by inner product that visits only the cells of the index that can still hold a hit.

Passages belong to the cell of their nearest centre. No passage of a cell scores higher for a query q than
q.centre + |q| * radius. Each query first visits its most promising cells; the k-th best score found there is a floor,
and it then visits every cell whose bound reaches that floor. What is left out is proven to hold no hit.

Passages and queries are stored as blocks, each a piece of one cell. Spark's Cartesian product brings a block of queries
and the blocks of the cells that any of them wants together, so a vector is shuffled once for its block and never
for the cells that it visits; a task keeps the `top` best of its queries from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators.pairwise import BLOCK_ROWS, STRIP, TOP_PARTS, Best, _matrix, block_of, blocks, hit_batches
from matchloom.sources.tables import materialise

#: Cells of an index at most. Every task holds their centres: MAX_CELLS vectors, whatever the index.
MAX_CELLS = 4096
#: A query's first visit covers so many passages for each hit that is asked for.
FIRST_VISIT = 4
#: What rounding of scores to DECIMALS places, and of the sums themselves, can add to a score.
DECIMALS = 6


class CellIndex(NamedTuple):
    """rows(r, rv, cell, gap): every passage; blocks(block, ids, vectors, cell): the same in pieces of cells, so no cell is one task's."""

    rows: DataFrame
    blocks: DataFrame
    key: T.DataType
    centres: np.ndarray  # (cells, width)
    radii: np.ndarray
    sizes: np.ndarray


class Search(NamedTuple):
    """hits(query, passage, score) hold each query's `top` best and more; visits(query, cells) tells how many cells were compared."""

    hits: DataFrame
    visits: DataFrame


def _nearest_centre(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    half = (centres * centres).sum(axis=1) / 2
    for batch in batches:
        x = _matrix(pa.table({"v": batch.column(1)}), "v") if len(batch) else np.zeros((0, centres.shape[1]))
        cell = (x @ centres.T - half).argmax(axis=1)
        gap = x - centres[cell]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt((gap * gap).sum(axis=1)))], ["r", "rv", "cell", "gap"])


def _placed(rows: DataFrame, centres: np.ndarray, name: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(r, rv) -> (r, rv, cell, gap), stored, and the radius and the rows of each cell."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    placed = materialise(rows.mapInArrow(lambda batches: _nearest_centre(batches, centres), schema), name)
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for c in placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row a centre
        radii[c["cell"]], sizes[c["cell"]] = c["radius"] * (1 + 1e-9), c["n"]
    return placed, radii, sizes


def _cut(placed: DataFrame, sizes: np.ndarray, block_rows: int) -> DataFrame:
    """(block, ids, vectors, cell) of `block_rows` rows at most; a large cell is dealt out by hash before."""
    pieces = F.get(F.array(*[F.lit(int(b)) for b in np.maximum(1, -(-sizes // block_rows))]), F.col("cell"))
    dealt = placed.select("r", "rv", "cell", F.pmod(F.xxhash64("r"), pieces).cast("int").alias("piece")).repartition("cell", "piece")
    return blocks(dealt.sortWithinPartitions("cell"), "r", "rv", block_rows, "cell")


def build(passages: DataFrame, passage: str, vec: str = "vec", cells: int | None = None, block_rows: int = BLOCK_ROWS) -> CellIndex:
    """The index of all passages that have a vector; all vectors are of one length.

    Centres are passages chosen by a hash of their key, about as many as the root of their number, MAX_CELLS at most.
    """
    rows = passages.select(F.col(passage).alias("r"), F.col(vec).cast("array<double>").alias("rv")).where(F.col("rv").isNotNull())
    n = rows.count()
    wanted = min(MAX_CELLS, cells or int(np.ceil(np.sqrt(n))) or 1)
    # About as many as wanted, by a hash of the key: nothing is ordered, and each task gives its own share.
    drawn = rows.where(F.pmod(F.xxhash64("r"), F.lit(max(1, n))) < wanted).limit(2 * wanted + 100).collect() or rows.limit(1).collect()
    centres = np.array([x["rv"] for x in sorted(drawn, key=lambda x: str(x["r"]))], np.float64)
    key = rows.schema["r"].dataType
    if not len(centres):
        empty = rows.withColumns({"cell": F.lit(0), "gap": F.lit(0.0)})
        return CellIndex(empty, blocks(empty, "r", "rv", block_rows, "cell"), key, np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64))
    placed, radii, sizes = _placed(rows, centres, "cells")
    return CellIndex(placed, materialise(_cut(placed, sizes, block_rows), "cell_blocks"), key, centres, radii, sizes)


class _Cells(NamedTuple):
    """What every task holds of the index."""

    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    enough: int

    def bounds(self, q: np.ndarray, cells: slice | int = slice(None)) -> np.ndarray:
        """(queries, cells): no passage of the cell scores higher."""
        return (q @ self.centres[cells].T) + np.multiply.outer(np.sqrt((q * q).sum(axis=1)), self.radii[cells])

    def first(self, bounds: np.ndarray) -> np.ndarray:
        """(queries, cells): the cells of greatest bounds, until they hold `enough` passages."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        out = np.empty(bounds.shape, bool)
        np.put_along_axis(out, order, before < self.enough, axis=1)
        return out & (self.sizes > 0)

    def first_of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, query) of the first visits, ordered by cell."""
        row, cell = (np.concatenate(c) for c in zip(*(
            (at[:, 0] + lo, at[:, 1]) for lo in range(0, len(q), STRIP) for at in [np.argwhere(self.first(self.bounds(q[lo : lo + STRIP])))]), strict=True))
        order = np.argsort(cell, kind="stable")
        return cell[order].astype(np.int32), row[order].astype(np.int32)


def _with_first_cells(batches: Iterator[pa.RecordBatch], index: _Cells) -> Iterator[pa.RecordBatch]:
    """(block, ids, vectors) -> with the cells that some query of the block visits first."""
    for batch in batches:
        for i in range(len(batch)):
            cell = np.unique(index.first_of(block_of(batch["ids"][i], batch["vectors"][i])[1])[0])
            yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([cell], pa.list_(pa.int32()))], [*batch.schema.names, "cells"])


def _first_scores(batches: Iterator[pa.RecordBatch], index: _Cells, top: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries beside blocks of passages -> (block, scores): the `top` best scores of each query in its first cells."""
    state: dict[int, tuple[Best, np.ndarray, np.ndarray]] = {}  # of the query blocks of this task's partition
    for batch in batches:
        for i, (block, cell) in enumerate(zip(batch["block"].to_pylist(), batch["cell"].to_pylist(), strict=True)):
            if block not in state:
                ids, x = block_of(batch["ids"][i], batch["vectors"][i])
                state[block] = Best(ids, x, top, DECIMALS), *index.first_of(x)
            best, cells, rows = state[block]
            best.meet(*block_of(batch["other_ids"][i], batch["other_vectors"][i]), rows[slice(*np.searchsorted(cells, [cell, cell + 1]))])
    for block, (best, _, _) in state.items():
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([best.scores().tobytes()], pa.binary())], ["block", "scores"])


def _with_cells(batches: Iterator[pa.RecordBatch], index: _Cells, top: int) -> Iterator[pa.RecordBatch]:
    """(block, ids, vectors, parts) -> (block, ids, vectors, floors, cells, visits): what no hit of a query scores below, the cells
    that some query of the block wants, and how many each query has compared in the end."""
    for batch in batches:
        for i, parts in enumerate(batch["parts"].to_pylist()):
            x = block_of(batch["ids"][i], batch["vectors"][i])[1]
            scores = np.concatenate([np.full((len(x), top), -np.inf), *(np.frombuffer(p).reshape(len(x), top) for p in parts or [])], axis=1)
            # One unit of the last place: more than rounding moves a score.
            floors = np.partition(scores, -top, axis=1)[:, -top] - 10.0**-DECIMALS
            wanted, visits = np.zeros(len(index.sizes), bool), np.zeros(len(x), np.int32)
            for lo in range(0, len(x), STRIP):
                bounds = index.bounds(x[lo : lo + STRIP])
                open_ = ~(bounds < floors[lo : lo + STRIP, None]) & (index.sizes > 0)
                wanted |= open_.any(axis=0)
                visits[lo : lo + STRIP] = (open_ | index.first(bounds)).sum(axis=1)
            lists = [pa.array([floors], pa.list_(pa.float64())), pa.array([np.flatnonzero(wanted).astype(np.int32)], pa.list_(pa.int32())), pa.array([visits], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:3], *lists], ["block", "ids", "vectors", "floors", "cells", "visits"])


def _best_hits(batches: Iterator[pa.RecordBatch], index: _Cells, top: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries beside blocks of passages -> (query, passage, score): the `top` best of each query in this task."""
    state: dict[int, Best] = {}  # of the query blocks of this task's partition
    for batch in batches:
        for i, (block, cell) in enumerate(zip(batch["block"].to_pylist(), batch["cell"].to_pylist(), strict=True)):
            if block not in state:
                state[block] = Best(*block_of(batch["ids"][i], batch["vectors"][i]), top, DECIMALS, batch["floors"][i].values.to_numpy())
            own = state[block]
            rows = np.flatnonzero(~(index.bounds(own.x, cell) < own.floor))
            if len(rows):
                own.meet(*block_of(batch["other_ids"][i], batch["other_vectors"][i]), rows)
    yield from hit_batches(state, names)


def _beside(wanting: DataFrame, index: CellIndex) -> DataFrame:
    """Every block of queries with every block of the cells that it wants; the query blocks of a partition are what the product holds."""
    other = index.blocks.select("cell", F.col("ids").alias("other_ids"), F.col("vectors").alias("other_vectors"))
    met = other.coalesce(TOP_PARTS).join(wanting.hint("shuffle_replicate_nl"), F.array_contains("cells", F.col("cell")))
    return met.drop("cells", "visits")


def search(queries: DataFrame, index: CellIndex, query: str, passage: str, top: int, vec: str = "vec", block_rows: int = BLOCK_ROWS) -> Search:
    """The passages among which each query's `top` best are: highest score, rounded to DECIMALS places, then smallest key.

    Queries without a vector have no hits.
    """
    q = queries.select(F.col(query).alias("r"), F.col(vec).cast("array<double>").alias("rv")).where(F.col("rv").isNotNull())
    kind = q.schema["r"].dataType
    found = T.StructType([T.StructField(query, kind), T.StructField(passage, index.key), T.StructField("score", T.DoubleType())])
    if not len(index.sizes):
        return Search(q.sparkSession.createDataFrame([], found), q.select(F.col("r").alias(query), F.lit(0).alias("cells")))
    cells = _Cells(index.centres, index.radii, index.sizes, FIRST_VISIT * top)
    placed, _, sizes = _placed(q, index.centres, "query_cells")
    cut = _cut(placed, sizes, block_rows).drop("cell")
    ints, names = T.ArrayType(T.IntegerType()), found.names
    first = materialise(cut.mapInArrow(lambda batches: _with_first_cells(batches, cells), T.StructType([*cut.schema.fields, T.StructField("cells", ints)])), "first_cells")
    scores = _beside(first, index).mapInArrow(lambda batches: _first_scores(batches, cells, top), "block long, scores binary")
    # A block of queries has at most TOP_PARTS parts.
    known = first.drop("cells").join(scores.groupBy("block").agg(F.collect_list("scores").alias("parts")), "block", "left")
    told = T.StructType([*cut.schema.fields, T.StructField("floors", T.ArrayType(T.DoubleType())), T.StructField("cells", ints), T.StructField("visits", ints)])
    wanting = materialise(known.mapInArrow(lambda batches: _with_cells(batches, cells, top), told), "wanted_cells")
    hits = _beside(wanting, index).mapInArrow(lambda batches: _best_hits(batches, cells, top, names), found)
    visits = wanting.select(F.inline(F.arrays_zip(F.col("ids").alias(query), F.col("visits").alias("cells"))))
    return Search(hits, visits)
