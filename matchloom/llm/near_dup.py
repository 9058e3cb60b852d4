"""Near-duplicate documents by min-max hashing: both the least and the greatest value under each permutation enter the signature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import words as W
from matchloom.llm.components import components
from matchloom.llm.tables import stored

#: 64 hash evaluations a shingle give 128 signature values.
PERMUTATIONS = 64
#: 32 bands of four values: a pair at similarity 0.75 shares none with probability (1 - 0.75^4)^32 = 5e-6.
ROWS = 4
#: Similarity from which on documents are linked, in hundredths.
PERCENT = 75
#: Bucket members that are compared in one cell of the third round.
BLOCK = 128
#: Columns of a membership matrix that are held at once.
COLUMNS = 1 << 14

_RNG = np.random.default_rng(7)
FLIPS = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
FACTORS = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets_of(raws: list[bytes | None], memory: W.WordHashes) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    return [np.unique(W.shingles(memory.of(W.space_words(raw)))) if raw else np.empty(0, np.uint64) for raw in raws]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS): minima in even columns, maxima in odd ones. No set may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        y = (flat ^ FLIPS[k]) * FACTORS[k]
        out[:, 2 * k] = np.minimum.reduceat(y, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(y, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, bands): one hash a band, with the band's number in it."""
    parts = W.mixed(signature).reshape(len(signature), -1, ROWS)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        keys = W.mixed(keys * W._ODD + parts[:, :, r])
    return keys


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n_shingles, digest of the set, band keys)."""
    memory = W.WordHashes()
    for batch in batches:
        ids, raws = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
        for lo, hi in W.slices(raws):
            sets = sets_of(raws[lo:hi], memory)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            bands = 2 * PERMUTATIONS // ROWS
            keys = np.empty((0, bands), np.uint64)
            if len(full):
                keys = band_keys(signatures([sets[i] for i in full]))
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
            yield pa.RecordBatch.from_arrays([
                ids.slice(lo, hi - lo), pa.array(sizes),
                pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64))),
            ], ["doc_id", "n_shingles", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = W.WordHashes()
    for batch in batches:
        raws = batch.column(1).cast(pa.binary()).to_pylist()
        for lo, hi in W.slices(raws):
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets_of(raws[lo:hi], memory)], pa.binary()),
            ], ["id", "shingles"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, on whole sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(left, right, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block, by products of slices of the membership matrix."""
    flat, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, len(flat), COLUMNS):
        i, j = np.searchsorted(at, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, len(flat) - lo)), np.float32)
        m[row[i:j], at[i:j] - lo] = 1
        out += m @ m.T
    return out


def _cell(table: pa.Table) -> pa.Table:
    """Links of a cell between members that are not yet of one component, a spanning set of them."""
    ids = table.column("id").to_pylist()
    comp = table.column("component").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets], np.float64)
    both = intersections(sets)
    linked = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
    root = {c: c for c in comp}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = find(comp[i]), find(comp[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((ids[i], ids[j]))
    kind = table.schema.field("id").type
    return pa.table({"a": pa.array([x for x, _ in out], kind), "b": pa.array([y for _, y in out], kind)})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id bigint, text) -> (doc_id, n_shingles, component_id, kept), one row per row.

    Documents are linked when 100 * |A n B| >= 75 * |A u B| of their distinct five-word shingles. Texts with the
    same set are one node, its least doc_id. Round one verifies one pair for each node: with the least node of its
    buckets. Round two takes the buckets that still hold several components and verifies each member outside the
    largest one with a member of it. Round three compares, in the buckets that are still mixed, the members outside the
    largest component with one another and with its members, in blocks, each pair of blocks a task of its own, so no
    bucket is cut off and none meets in one task; a cell gives back at most a spanning set of links. Links are
    confirmed on whole sets in every round.

    Null, empty or blank text: no shingles, component_id is its own doc_id. A null doc_id takes part in no link:
    component_id null, kept. Rows that share a doc_id are one node. Other columns are not read. No rows, no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = stored(rows.mapInArrow(_digest, "doc_id bigint, n_shingles bigint, digest string, bands array<bigint>"), "sets")
    named = digest.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # Stored, so that the joins below read a table and can be split where many documents share a set.
    nodes = stored(named.groupBy("digest").agg(F.min("doc_id").alias("id")), "nodes")
    bands = named.join(nodes, (named["digest"] == nodes["digest"]) & (named["doc_id"] == nodes["id"]), "left_semi").select(
        F.col("doc_id").alias("id"), F.explode("bands").alias("key")).distinct()
    members = shared_buckets(bands)
    wanted = members.select("id").distinct()
    shingles = stored(rows.join(wanted, rows["doc_id"] == wanted["id"], "left_semi").mapInArrow(_sets, "id bigint, shingles binary"), "shingles")
    whole = clusters(members, shingles)

    final = digest.join(nodes, "digest", "left").join(whole, F.col("id") == F.col("node"), "left")
    component = F.when(F.col("digest").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "id"))
    return final.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def shared_buckets(bands: DataFrame) -> DataFrame:
    """bands(id, key) -> stored (key, id, leader, n): the buckets of two or more nodes, with their least node and their size."""
    leaders = stored(bands.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "leaders")
    return stored(bands.join(leaders, "key"), "members")


def clusters(members: DataFrame, shingles: DataFrame) -> DataFrame:
    """shared_buckets() and shingles(id, shingles) of their nodes -> (node, component): the three rounds that near_duplicates() describes."""
    pairs = members.groupBy("id").agg(F.min("leader").alias("leader")).where("id != leader")
    links = stored(_verified(pairs.select(F.col("id").alias("a"), F.col("leader").alias("b")), shingles), "first_links")
    first = stored(components(links), "first_components")

    tried = _mixed(members, first).where("component != main").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    links = links.unionByName(stored(_verified(tried, shingles), "second_links"))
    second = stored(components(links), "second_components")

    more = stored(_cells(_mixed(members, second, left_over=True), shingles), "third_links")
    return components(links.unionByName(more))


def _mixed(members: DataFrame, found: DataFrame, left_over: bool = False) -> DataFrame:
    """Members of the buckets that hold several components: (key, id, component, main, n_main, n_rest, rep).

    main is the bucket's largest component, n_main and n_rest count its members and the others, rep is one of main,
    chosen by a hash of bucket and id, so that buckets offer different ones. left_over: of buckets with the same members
    (as many of them, with the same 128 bits) one stands for all, and buckets of two are left out, as round two has
    compared those two.
    """
    labelled = members.join(found, members["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    marks = (F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit("second")))) if left_over else (F.lit(0), F.lit(0))
    sizes = labelled.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("key", "id"), "id")).alias("first"), marks[0].alias("mark"), marks[1].alias("second"))
    per_key = sizes.groupBy("key").agg(
        F.max(F.struct("n", "component", "first.id")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"),
        F.bit_xor("mark").alias("mark"), F.bit_xor("second").alias("second")).where("parts > 1")
    if left_over:
        per_key = per_key.where("n > 2").groupBy("n", "mark", "second").agg(F.min(F.struct("key", "m")).alias("one")).select("n", "one.key", "one.m")
    open_keys = stored(per_key.select(
        "key", F.col("m.component").alias("main"), F.col("m.n").alias("n_main"), (F.col("n") - F.col("m.n")).alias("n_rest"), F.col("m.id").alias("rep")), "open")
    return labelled.join(open_keys, "key")


def _links_type(shingles: DataFrame) -> str:
    kind = shingles.schema["id"].dataType.simpleString()
    return f"a {kind}, b {kind}"


def _verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    left = shingles.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = shingles.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirmed, _links_type(shingles))


def _cells(mixed: DataFrame, shingles: DataFrame) -> DataFrame:
    """Each bucket's main component and the rest of its members are dealt to blocks of about BLOCK by hash.

    Blocks of the rest meet each other and the main blocks, each pair of blocks in one group. Main blocks do not meet:
    their members are of one component. So a group of copies with few strangers costs what it has members.
    """
    is_main = F.col("component") == F.col("main")
    n_rest, n_main = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_rest", "n_main"))
    at = F.when(is_main, n_rest + F.pmod(F.xxhash64("id"), n_main)).otherwise(F.pmod(F.xxhash64("id"), n_rest)).cast("int")
    met = F.when(is_main, n_rest).otherwise(n_rest + n_main)
    dealt = mixed.select("key", "id", "component", at.alias("block"), F.explode(F.sequence(F.lit(0), met - 1)).alias("other"))
    spread = dealt.select("key", "id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return spread.join(shingles, "id").groupBy("key", "i", "j").applyInArrow(_cell, _links_type(shingles)).distinct()
