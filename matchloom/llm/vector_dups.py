"""Near-duplicate vectors by NN-descent: a neighbour graph is refined through joins of neighbours' neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.components import components
from matchloom.llm.tables import forget, stored

#: Cosine from which on vectors are linked.
LINK = 0.98
#: Neighbours that a list holds.
NEIGHBOURS = 8
#: Random-hyperplane trees that start a round, and the vectors that a leaf should hold.
TREES, LEAF = 4, 256
#: Vectors that are compared in one task's cell.
BLOCK = 512
#: Vectors that a round's audit compares with all of their label, about; rounds after which what is left is swept.
AUDIT, ROUNDS = 512, 8
#: Vectors of a block of the sweep, which compares each two blocks of a label, and rows of it that are multiplied at once.
SWEEP, STRIP = 1024, 256
#: Bits of a leaf's code; 2^24 leaves of 256 vectors are more than any label has.
BITS = 24
#: What single floats can take from a cosine.
FLOATS = 1e-5
#: Sub-keys over which a vector's reverse neighbours are first ranked.
SALTS = 16


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> with a digest of label and unit vector, and the vector; both null if it can link with nothing."""
    for batch in batches:
        labels = batch.column(1).to_pylist()
        out: list[tuple[str | None, list[float] | None]] = []
        for label, x in zip(labels, batch.column(2), strict=True):
            v = None if label is None or not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            # The largest component is divided out first: squares of very large or small ones leave the range.
            top = np.abs(v).max() if v is not None and len(v) else 0.0
            if not np.isfinite(top) or top == 0:
                out.append((None, None))
                continue
            v = v / top
            v /= np.sqrt(v @ v)
            out.append((xxhash.xxh3_128_hexdigest(v.tobytes(), seed=hash(label) & 0xFFFF) + str(label), v))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([i for i, _ in out], pa.string()), pa.array([v for _, v in out], pa.list_(pa.float64()))],
            ["vec_id", "label", "id", "v"])


def _stack(table: pa.Table) -> tuple[list[str], np.ndarray]:
    v = table.column("v").combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return table.column("id").to_pylist(), flat.reshape(len(v), -1)


def _codes(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """(id, label, v, mean) -> (id, label, v, codes): for each tree, the sides of BITS planes through the label's mean."""
    for batch in batches:
        x, mean = (np.stack([v.values.to_numpy(zero_copy_only=False) for v in batch.column(i)]) if len(batch) else np.empty((0, 1)) for i in (2, 3))
        planes = np.random.default_rng([17, seed]).standard_normal((x.shape[1], TREES * BITS))
        codes = (((x - mean) @ planes > 0).reshape(len(x), TREES, BITS) << np.arange(BITS)).sum(axis=2)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(codes.tolist(), pa.list_(pa.int64()))], ["id", "label", "v", "codes"])


def _leaves(nodes: DataFrame, seed: int) -> DataFrame:
    """nodes(id, label, dim, v, mean) dealt to cells (label, dim, tree, leaf, block), where near vectors often share a cell in some tree.

    A label gets as many leaves as its count asks for, a leaf that is large is cut by further planes, and one that is
    large still, whose vectors hardly differ, is dealt to blocks by a hash that changes with tree and round.
    """
    out = None
    sizes = stored(nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label_sizes")
    bits = lambda n, more: F.greatest(F.lit(0), F.least(F.lit(BITS), more + F.ceil(F.log2(F.col(n) / LEAF)).cast("int")))
    # Vectors of different length can not be stacked: one run for each length, of which a table has one or few.
    for (dim,) in nodes.select("dim").distinct().collect() or [(0,)]:
        own = nodes.where(F.col("dim") == dim).select("id", "label", "v", "mean")
        rows = own.mapInArrow(lambda batches: _codes(batches, seed), "id string, label bigint, v array<double>, codes array<bigint>")
        rows = rows.select("id", "label", "v", F.posexplode("codes").alias("tree", "code")).withColumn("dim", F.lit(dim))
        out = rows if out is None else out.unionByName(rows)
    keys = ["label", "dim", "tree", "leaf"]
    leaf = F.expr("code % shiftleft(1L, bits)")
    out = out.join(sizes, "label").withColumn("bits", bits("n", F.lit(0))).withColumn("leaf", leaf).drop("n")
    crowded = stored(out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "leaf_sizes")
    out = out.join(crowded, keys).withColumn("bits", F.when(F.col("n") > BLOCK, bits("n", F.col("bits"))).otherwise(F.col("bits"))).withColumn("leaf", leaf).drop("n")
    blocks = stored(out.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "leaf_blocks")
    return out.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.col("blocks"))).drop("code", "bits", "blocks")


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold every component of a symmetric matrix together."""
    new, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        queue = [start] if new[start] else []
        new[start] = False
        while queue:
            i = queue.pop()
            found = np.flatnonzero(linked[i] & new)
            new[found] = False
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


_EDGES = "u string, v string, sim double, link boolean"


def _edge_table(edges: list[tuple[str, str, float, bool]]) -> dict[str, pa.Array]:
    columns = list(zip(*edges, strict=True)) or [[]] * 4
    return {n: pa.array(c, t) for n, c, t in zip(("u", "v", "sim", "link"), columns, (pa.string(), pa.string(), pa.float64(), pa.bool_()), strict=True)}


def _nearest(table):
    """Of a cell: each vector's NEIGHBOURS nearest, and links that span what is linked."""
    ids, x = _stack(table)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    edges = [(ids[i], ids[j], float(s[i, j]), True) for i, j in _spanning(s >= LINK)]
    k = min(NEIGHBOURS, len(ids) - 1)
    if k > 0:
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        edges += [(ids[i], ids[j], float(s[i, j]), False) for i, row in enumerate(at) for j in row]
    return pa.table(_edge_table(edges))


def _across(table: pa.Table) -> pa.Table:
    """Links of a cell between components, one for each pair of components; a cell of two blocks is searched between them, one of one block within."""
    ids, x = _stack(table)
    comp, at = np.unique(np.array(table.column("component").to_pylist(), object).astype(str), return_inverse=True)
    block = table.column("block").to_numpy()
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    seen: dict[int, tuple[str, str]] = {}
    for lo in range(0, len(left), STRIP):
        rows = left[lo : lo + STRIP]
        i, j = np.nonzero((x[rows] @ x[right].T >= LINK) & (at[rows][:, None] != at[right][None, :]))
        i, j = rows[i], right[j]
        pairs, first = np.unique(np.minimum(at[i], at[j]) * len(comp) + np.maximum(at[i], at[j]), return_index=True)
        for pair, k in zip(pairs.tolist(), first, strict=True):
            seen.setdefault(pair, (ids[i[k]], ids[j[k]]))
    return pa.table({"a": pa.array([p for p, _ in seen.values()], pa.string()), "b": pa.array([q for _, q in seen.values()], pa.string())})


def _swept(labelled: DataFrame) -> DataFrame:
    """labelled(id, label, dim, component, v) -> links between components: each two blocks of a label are compared, so every pair of vectors is."""
    keys = ["label", "dim"]
    counts = stored(labelled.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SWEEP).alias("blocks")), "blocks")
    dealt = labelled.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cells = dealt.select(*keys, "id", "component", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return cells.groupBy(*keys, "i", "j").applyInArrow(_across, "a string, b string").distinct()


def _top(edges: DataFrame, salted: bool = False) -> DataFrame:
    """The NEIGHBOURS best edges (u, v, sim) of each u. salted: u may have any number of edges; they are first ranked in parts."""
    best = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("sim"), "v")
    if salted:
        part = F.pmod(F.xxhash64("v"), F.lit(SALTS))
        edges = edges.withColumn("part", part).withColumn("r", F.row_number().over(best("u", "part"))).where(F.col("r") <= NEIGHBOURS).drop("r", "part")
    return edges.withColumn("r", F.row_number().over(best("u"))).where(F.col("r") <= NEIGHBOURS).drop("r")


def _join_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each vector, its neighbours compared with each other: pairs that better the worst of either's list, and links that span what seems linked."""
    for batch in batches:
        edges = []
        for members in batch.column(0):
            m = members.values
            ids = m.field("id").to_pylist()
            if len(ids) < 2:
                continue
            tau = m.field("tau").to_numpy(zero_copy_only=False)
            x = m.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            better = np.triu((s > tau[:, None]) | (s > tau[None, :]), 1)
            edges += [(ids[i], ids[j], float(s[i, j]), False) for i, j in zip(*np.nonzero(better), strict=True)]
            edges += [(ids[i], ids[j], float(s[i, j]), True) for i, j in _spanning(s >= LINK - FLOATS)]
        yield pa.RecordBatch.from_pydict(_edge_table(edges))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "sim").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))


def _joined(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that joins of neighbours' neighbours find: (u, v, sim, link)."""
    worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(-1.0)).alias("tau")).withColumnRenamed("u", "id")
    reverse = _top(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"), salted=True)
    around = graph.select("u", "v").unionByName(reverse.select("u", "v")).distinct()
    holders = nodes.select("id", F.col("v").cast("array<float>").alias("x")).join(worst, "id", "left")
    member = F.struct("id", F.coalesce("tau", F.lit(-1.0)).alias("tau"), F.col("x").alias("v"))
    lists = around.select("u", F.col("v").alias("id")).join(holders, "id").groupBy("u").agg(F.collect_list(member).alias("members"))
    return lists.select("members").mapInArrow(_join_neighbours, _EDGES)


def _bettered(graph: DataFrame, found: DataFrame) -> DataFrame:
    every = _both_ways(found.where(~F.col("link")).groupBy("u", "v").agg(F.max("sim").alias("sim"))).unionByName(graph)
    return _top(every.groupBy("u", "v").agg(F.max("sim").alias("sim")), salted=True)


def _linking(edges: DataFrame) -> DataFrame:
    """Edges that are or seem links, each once and one way."""
    near = edges.where(F.col("sim") >= LINK - FLOATS)
    return near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _descended(nodes: DataFrame, graph: DataFrame | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """A round: (graph of nearest neighbours, pairs that seem linked). New trees add to the graph, then joins of neighbours refine it until they find no more."""
    first = stored(_leaves(nodes, seed).groupBy("label", "dim", "tree", "leaf", "block").applyInArrow(_nearest, _EDGES), "leaf_edges")
    edges = first.where(~F.col("link")).select("u", "v", "sim")
    edges = edges if graph is None else edges.unionByName(graph)
    graph = stored(_top(edges.groupBy("u", "v").agg(F.max("sim").alias("sim")), salted=True), "graph")
    linked = stored(_linking(first), "linked")
    forget(first)
    known = -1
    while (n := graph.where(F.col("sim") >= LINK).count()) > known:
        known = n
        found = stored(_joined(graph, nodes), "found")
        better, more = stored(_bettered(graph, found), "graph"), stored(linked.unionByName(_linking(found)).distinct(), "linked")
        for old in (graph, found, linked):
            forget(old)
        graph, linked = better, more
    return graph, linked


def _audited(labelled: DataFrame, seed: int) -> DataFrame:
    """labelled(id, label, dim, component, v) -> links(a, b) between components that some vectors, chosen by hash, have with any of their label.

    About AUDIT vectors, whatever the table, travel to all others.
    """
    n = labelled.count()
    chosen = labelled.where(F.pmod(F.xxhash64("id", F.lit(seed + 100)), F.lit(max(1, n // AUDIT))) == 0).select("id", "label", "dim", "component", "v").collect()
    groups: dict[tuple[int, int], tuple[list, list, np.ndarray]] = {}
    for key in {(r["label"], r["dim"]) for r in chosen}:
        own = [r for r in chosen if (r["label"], r["dim"]) == key]
        groups[key] = ([r["id"] for r in own], [r["component"] for r in own], np.array([r["v"] for r in own]))
    shared = labelled.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            a, b = [], []
            for key in set(keys) & set(shared.value):
                ids, comps, q = shared.value[key]
                rows = np.array([i for i, k in enumerate(keys) if k == key])
                x = np.stack([batch.column(4)[int(i)].values.to_numpy(zero_copy_only=False) for i in rows])
                apart = np.array(batch.column(3).to_pylist(), object)[rows][:, None] != np.array(comps, object)
                for i, j in zip(*np.nonzero((x @ q.T >= LINK) & apart), strict=True):
                    a.append(batch.column(0)[int(rows[i])].as_py())
                    b.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    return labelled.select("id", "label", "dim", "component", "v").mapInArrow(run, "a string, b string")


def _confirmed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    left, right = nodes.select(F.col("id").alias("u"), F.col("v").alias("x")), nodes.select(F.col("id").alias("v"), F.col("v").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    return pairs.join(left, "u").join(right, "v").where(dot >= LINK).select(F.col("u").alias("a"), F.col("v").alias("b"))


def _count_cell(table: pa.Table) -> pa.Table:
    """How many rows each vector of a cell links with there; a cell of two blocks counts between them, one of one block within."""
    ids, x = _stack(table)
    block = table.column("block").to_numpy()
    mult = table.column("mult").to_numpy().astype(np.float64)
    linked = x @ x.T >= LINK
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    np.fill_diagonal(linked, False)
    return pa.table({"id": pa.array(ids), "n": (linked @ mult).astype(np.int64)})


def near_vectors(vectors: DataFrame, sweep: bool = False) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), one row per row.

    Vectors of one label with cosine >= 0.98 in double precision are linked. Equal vectors are one node that counts
    its copies. Random-hyperplane leaves start a graph of the nearest neighbours; joins of neighbours' neighbours
    refine it until a pass finds no further link. A list full of links is saturated: it grows to all of its component,
    compared in blocks of bounded size, so no link within a component is missed and a group's pairs are only counted.
    An audit then compares some vectors, chosen by hash, with all of their label: as long as it finds a link between
    components, that link is added and another round of new trees, descent and audit follows. After ROUNDS of them, or
    with `sweep`, all pairs of a label that lie in different components are compared, at a cost of the square of a label's vectors.

    Null labels, null, zero or empty vectors and those with null or non-finite components link with nothing; then
    component_id is vec_id. Null vec_id: the row takes part, and component_id is the least id that is not null, or null; kept if it is null. No rows, no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    table = stored(rows.select("vec_id", "label", "embedding").mapInArrow(_nodes, "vec_id bigint, label bigint, id string, v array<double>"), "vectors")
    single = stored(table.where("id is not null").groupBy("id").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least")).withColumn("dim", F.size("v")), "nodes")
    means = stored(single.groupBy("label", "dim").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("mean")), "means")
    nodes = single.join(means, ["label", "dim"])

    def labelled_by(links: DataFrame) -> DataFrame:
        comps = stored(components(links), "components")
        return single.join(comps, single["id"] == comps["node"], "left").select("id", "label", "dim", "mult", "least", F.coalesce("component", "id").alias("component"), "v")

    graph, links = None, None
    for seed in range(ROUNDS):
        graph, linked = _descended(nodes, graph, seed)
        # The descent multiplies single floats; what is near the threshold is computed anew in double precision.
        own = _confirmed(linked, single)
        links = stored(own if links is None else links.unionByName(own), "links")
        labelled = labelled_by(links)
        missed = stored(_audited(labelled, seed), "missed")
        if not missed.limit(1).count():
            break
        links = links.unionByName(missed)
    else:
        sweep = True
    if sweep:
        labelled = labelled_by(links.unionByName(stored(_swept(labelled_by(links)), "links")))
    # A table, so that the join can be split where a component is large.
    sizes = stored(labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    grown = labelled.join(sizes, "component")
    blocks = F.ceil(F.col("size") / BLOCK)
    grown = grown.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    counted = grown.select("component", "id", "mult", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    n_links = counted.groupBy("component", "i", "j").applyInArrow(_count_cell, "id string, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    least = stored(labelled.groupBy("component").agg(F.min("least").alias("least_id")), "least_ids")
    told = labelled.select("id", "mult", "component").join(n_links, "id", "left").join(least, "component").select("id", "mult", "n", "least_id")
    out = table.select("vec_id", "id").join(told, "id", "left")
    found = F.col("mult").isNotNull()
    component = F.when(found, F.col("least_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(found, F.col("mult") - 1 + F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
