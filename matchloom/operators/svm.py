"""Linear SVMs of all folds and classes at once: each optimiser step is one pass over the rows that serves every plane.

A plane (w, b) of a fold and a class minimises |w|^2 / 2 + b^2 / 2 + C * sum of max(0, 1 - y (w.x + b))^2 over the
rows of the other folds: squared hinge, and a bias that counts as a weight. Rows are stored as blocks of binary arrays,
each of one fold, with their entries in the order of terms, so that no pass sorts or unpacks them again. A pass multiplies
the blocks by all planes that they belong to, plane by plane over pieces of entries that stay in a core's cache, and adds
up their losses and gradients; L-BFGS with backtracking runs for each plane on the driver, which holds some vectors a
plane. It starts from the inverse of the curvature's diagonal: sums of squares of the terms, times the share of rows
inside the margin at that pass.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from matchloom.sources.tables import materialise

C = 1.0
#: A plane is done when its gradient is this share of its first one.
TOLERANCE = 1e-4
MAX_PASSES = 1000
#: Steps that a plane remembers.
MEMORY = 20
#: Entries of a block, a longer row apart, and its rows.
BLOCK_ENTRIES = 1_000_000
BLOCK_ROWS = 1 << 16
#: Entries that a plane goes through at once: they and what is made of them stay in a core's cache.
PIECE = 32_768
#: Bytes of all tasks' gradients up to which the driver adds them up itself; beyond, a group for each plane does.
DIRECT = 64 << 20
#: Numbers (entries of rows times planes) that a task holds at once.
SLICE = 4_000_000


#: Loss, rows and a number for each term and the bias.
_Sums = tuple[float, int, np.ndarray]
_BLOCKS = "folds binary, labels binary, rows binary, terms binary, weights binary"


class Sparse:
    """Rows of a batch as flat entries: row numbers, term numbers and weights, in row order."""

    def __init__(self, indices: pa.Array, values: pa.Array):
        self.rows = len(indices)
        lengths = np.nan_to_num(indices.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        self.at = indices.flatten().to_numpy(zero_copy_only=False)
        self.value = values.flatten().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(self.rows), lengths)
        self.ends = np.concatenate([[0], np.cumsum(lengths)])

    def slices(self, planes: int) -> Iterator[tuple[int, int]]:
        """Ranges of rows whose entries times planes stay below SLICE; a longer row is a range of its own."""
        lo = 0
        while lo < self.rows:
            hi = int(np.searchsorted(self.ends, self.ends[lo] + SLICE // planes, "right")) - 1
            hi = min(max(hi, lo + 1), self.rows)
            yield lo, hi
            lo = hi

    def times(self, weights: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Rows lo to hi by weights (terms, planes) -> (rows, planes)."""
        a, b = self.ends[lo], self.ends[hi]
        out = np.zeros((hi - lo, weights.shape[1]))
        some = np.flatnonzero(np.diff(self.ends[lo : hi + 1]))
        if len(some):
            out[some] = np.add.reduceat(weights[self.at[a:b]] * self.value[a:b, None], self.ends[lo + some] - a, axis=0)
        return out


def margins(sparse: Sparse, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """weights (terms, planes) -> (rows, planes)."""
    parts = [sparse.times(weights, lo, hi) for lo, hi in sparse.slices(max(1, weights.shape[1]))]
    return np.concatenate(parts) + bias if parts else np.zeros((0, len(bias)))


def blocked(rows: DataFrame) -> DataFrame:
    """(fold, label, indices, values) -> blocks of rows of one fold: folds and labels of the rows, and rows, terms and weights of their entries by term."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            rows = Sparse(batch.column(2), batch.column(3))
            fold, label = (batch.column(i).to_numpy().astype(np.int32) for i in (0, 1))
            lo = 0
            while lo < rows.rows:
                hi = max(lo + 1, int(np.searchsorted(rows.ends, rows.ends[lo] + BLOCK_ENTRIES, "right")) - 1)
                hi = min(hi, lo + BLOCK_ROWS, int(np.searchsorted(fold, fold[lo], "right")))
                a, b = rows.ends[lo], rows.ends[hi]
                order = np.argsort(rows.at[a:b], kind="stable")
                parts = (fold[lo:hi], label[lo:hi], (rows.row[a:b] - lo)[order].astype(np.uint16), rows.at[a:b][order].astype(np.int32), rows.value[a:b][order])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], _BLOCKS.replace(" binary", "").split(", "))
                lo = hi

    return rows.select("fold", "label", "indices", "values").mapInArrow(cut, _BLOCKS)


class _Block:
    """A row of blocked()."""

    def __init__(self, row: Sequence):
        kinds = (np.int32, np.int32, np.uint16, np.int32, np.float64)
        parts = (x.as_buffer() if isinstance(x, pa.Scalar) else x for x in row)
        self.fold, self.label, self.row, self.at, self.value = (np.frombuffer(x, k) for x, k in zip(parts, kinds, strict=True))

    def _pieces(self, planes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, weights, where a term's entries begin, the terms) of some entries at a time."""
        step = max(1, min(PIECE, SLICE // max(1, planes)))
        for lo in range(0, len(self.at), step):
            at = self.at[lo : lo + step]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            yield self.row[lo : lo + step].astype(np.intp), self.value[lo : lo + step], first, at[first]

    def times(self, weights: np.ndarray) -> np.ndarray:
        """All rows by weights (planes, terms) -> (rows, planes)."""
        out = np.zeros((len(weights), len(self.fold)))
        for row, value, first, terms in self._pieces(len(weights)):
            counts = np.diff(np.append(first, len(row)))
            for own, plane in zip(out, weights, strict=True):
                x = np.repeat(plane[terms], counts)
                x *= value
                own += np.bincount(row, x, len(own))
        return out.T

    def add_outer(self, factors: np.ndarray, total: np.ndarray) -> None:
        """total (terms, planes) += transpose of the rows by factors (rows, planes)."""
        factors = np.ascontiguousarray(factors.T)
        for row, value, first, terms in self._pieces(len(factors)):
            for own, plane in zip(total.T, factors, strict=True):
                x = plane[row]
                x *= value
                own[terms] += np.add.reduceat(x, first)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(len(batch)):
            yield _Block([c[i] for c in batch.columns])


def _gradients(blocks: Iterator[tuple[bytes, ...]], shared, folds: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, _Sums]]:
    """Blocks -> for each plane, this task's loss, rows inside the margin and gradient."""
    planes = shared.value  # (planes, terms + 1), the bias last
    loss, inside, total = np.zeros(len(folds)), np.zeros(len(folds), np.int64), np.zeros_like(planes)
    for block in map(_Block, blocks):
        own = np.flatnonzero(folds != block.fold[0])
        y = np.where(block.label[:, None] == classes[own], 1.0, -1.0)
        short = np.maximum(0, 1 - y * (block.times(planes[own, :-1]) + planes[own, -1]))
        loss[own] += (short * short).sum(axis=0)
        inside[own] += (short > 0).sum(axis=0)
        slope = -2 * y * short
        made = np.zeros((len(own), planes.shape[1]))
        block.add_outer(slope, made[:, :-1].T)
        made[:, -1] = slope.sum(axis=0)
        total[own] += made
    yield from enumerate(zip(loss, inside, total, strict=True))


def _squares(blocks: Iterator[tuple[bytes, ...]], folds: np.ndarray, terms: int) -> Iterator[tuple[int, _Sums]]:
    """Blocks -> for each fold left out, this task's sums of squares of every term, the bias last, and the rows they are of."""
    total, rows = np.zeros((len(folds), terms + 1)), np.zeros(len(folds), np.int64)
    for block in map(_Block, blocks):
        kept = np.flatnonzero(folds != block.fold[0])
        total[kept, :-1] += np.bincount(block.at, block.value * block.value, terms)
        rows[kept] += len(block.fold)
    total[:, -1] = rows
    yield from enumerate(zip(np.zeros(len(folds)), rows, total, strict=True))


def _plus(a: _Sums, b: _Sums) -> _Sums:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _summed(sums: RDD, count: int, terms: int) -> list[_Sums]:
    """The sums of all tasks; they meet in a group for each number where all of them would be more than DIRECT bytes."""
    made: list[_Sums] = [(0.0, 0, np.zeros(terms + 1)) for _ in range(count)]
    tasks = sums.getNumPartitions()
    for k, x in (sums.reduceByKey(_plus, min(tasks, count)) if tasks * count * (terms + 1) * 8 > DIRECT else sums).collect():
        made[k] = _plus(made[k], x)
    return made


class _Plane:
    """L-BFGS of one plane between passes."""

    def __init__(self, squares: np.ndarray, rows: int, start: np.ndarray | None = None):
        width = len(squares)
        #: Where the first step from zero leads, if there is a guess.
        self.start = start
        self.squares, self.rows, self.inverse = squares, max(1, rows), np.ones(width)
        self.w, self.step, self.direction = np.zeros(width), 1.0, np.zeros(width)
        self.loss, self.gradient, self.limit, self.done = np.inf, None, 0.0, False
        self.moves: deque = deque(maxlen=MEMORY)

    def trial(self) -> np.ndarray:
        return self.w + self.step * self.direction

    def take(self, loss: float, gradient: np.ndarray, inside: int) -> None:
        """The sums at trial(): moves there, or halves the step."""
        at = self.trial()
        loss, gradient = C * loss + at @ at / 2, C * gradient + at
        if self.gradient is not None:
            if loss > self.loss + 1e-4 * self.step * (self.gradient @ self.direction):
                self.step /= 2
                self.done = self.step < 1e-12
                return
            s, y = at - self.w, gradient - self.gradient
            self.moves.append((s, y, 1 / (s @ y)))
        else:
            self.limit = TOLERANCE * np.sqrt(gradient @ gradient)
        self.inverse = 1 / (1 + 2 * C * inside / self.rows * self.squares)
        self.w, self.loss, self.gradient, self.step = at, loss, gradient, 1.0
        size = np.sqrt(gradient @ gradient)
        self.done = size <= self.limit
        self.direction = -self._scaled(gradient)
        if self.start is not None:
            self.direction, self.start = (self.start if gradient @ self.start < 0 else self.direction), None

    def _scaled(self, q: np.ndarray) -> np.ndarray:
        """The inverse curvature that the remembered moves tell, times q."""
        parts = []
        for s, y, r in reversed(self.moves):
            a = r * (s @ q)
            q = q - a * y
            parts.append(a)
        q = self.inverse * q
        if self.moves:
            s, y, r = self.moves[-1]
            q = q / (r * (y @ (self.inverse * y)))
        for (s, y, r), a in zip(self.moves, reversed(parts), strict=True):
            q = q + s * (a - r * (y @ q))
        return q


def fit_planes(rows: DataFrame, planes: list[tuple[int, int]], terms: int, max_passes: int = MAX_PASSES) -> tuple[np.ndarray, np.ndarray]:
    """rows(fold, label, indices, values), planes as (fold left out, class) -> weights (planes, terms) and biases (planes,)."""
    return fit_blocks(materialise(blocked(rows), "blocks"), planes, terms, max_passes)


def fit_blocks(
    blocks: DataFrame, planes: list[tuple[int, int]], terms: int, max_passes: int = MAX_PASSES, start: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """fit_planes() of a stored table of blocked() rows; `start` (planes, terms + 1), the bias last, is where the planes may be.

    One job a pass, however many planes: the planes that are not done yet travel as a broadcast, one row a plane comes back.
    The blocks are kept as they go to Python, so that a pass does not decode the table; what does not fit into memory is on
    the executors' disks, and what is lost is read from the table again.
    """
    context = blocks.sparkSession.sparkContext
    kept = blocks.rdd.map(lambda row: tuple(map(bytes, row)))
    # So many tasks that the driver can add their sums up itself, but one for each core at least.
    few = max(context.defaultParallelism, DIRECT // max(1, len(planes) * (terms + 1) * 8))
    kept = (kept.coalesce(few) if few < kept.getNumPartitions() else kept).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        left_out = sorted({f for f, _ in planes})
        sums = kept.mapPartitions(lambda rows, f=np.array(left_out): _squares(rows, f, terms))
        squares = {f: (x, n) for f, (_, n, x) in zip(left_out, _summed(sums, len(left_out), terms), strict=True)}
        fits = [_Plane(*squares[f], None if start is None else start[k]) for k, (f, _) in enumerate(planes)]
        for _ in range(max_passes):
            left = [k for k, f in enumerate(fits) if not f.done]
            if not left:
                break
            shared = context.broadcast(np.stack([fits[k].trial() for k in left]))
            folds, classes = (np.array([planes[k][i] for k in left]) for i in (0, 1))
            sums = kept.mapPartitions(lambda rows, s=shared, f=folds, c=classes: _gradients(rows, s, f, c))
            for k, (loss, inside, gradient) in zip(left, _summed(sums, len(left), terms), strict=True):
                fits[k].take(float(loss), gradient, int(inside))
            shared.destroy()
        else:
            if left := [p for p, f in zip(planes, fits, strict=True) if not f.done]:
                raise RuntimeError(f"planes without an optimum after {max_passes} passes: {left}")
    finally:
        kept.unpersist()
    weights = np.stack([f.w for f in fits])
    return weights[:, :-1], weights[:, -1]


def held_out_margins(blocks: DataFrame, weights: np.ndarray, biases: np.ndarray, n_folds: int) -> DataFrame:
    """(fold, label, margins ARRAY<DOUBLE>) of every row by the planes of its own fold; weights (folds x classes, terms)."""
    shared = blocks.sparkSession.sparkContext.broadcast((weights.reshape(n_folds, -1, weights.shape[-1]), biases.reshape(n_folds, -1)))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, bias = shared.value
        for block in _blocks(batches):
            m = block.times(planes[block.fold[0]]) + bias[block.fold[0]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(block.fold), pa.array(block.label), lists], ["fold", "label", "margins"])

    return blocks.mapInArrow(own, "fold int, label int, margins array<double>")
