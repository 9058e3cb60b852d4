"""Language-model scoring by context-tree weighting over bytes, with counts that live in shards and are looked up in blocks.

Documents are packed into blocks. A block asks for the distinct grams (a context of DEPTH bytes and the byte after it)
and words that it holds, so what is shuffled is distinct within some megabytes of text. Shards of the key space add up
the counts of all blocks; the context tree is built from the deepest contexts to the root over buckets of contexts, and
the mixed probabilities go back down the same way; the shards answer the blocks, which add up their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm import words as W
from matchloom.llm.tables import forget, stored

#: Bytes of the longest context.
DEPTH = 5
#: Bytes of text that share their requests, in one task's memory; a longer text is a block of its own.
BLOCK = 16 << 20
#: Bytes of text for each shard of the key space: a shard's task holds the requests of all blocks in it.
SHARD = 16 << 20
#: Grams or nodes of a bucket of the tree; a bucket holds whole contexts.
BUCKET = 200_000
#: Bytes of text that are cut into grams at once, and packed into one row.
SLICE, CHUNK = 1 << 19, 1 << 20

_GRAMS, _WORDS = 1, 2
#: Stands before and after a text; no UTF-8 text holds it.
_EDGE = b"\xff"
#: The end of a text among the words; no word holds a space.
_END = b" "
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_HALF = np.log(0.5)


# --- packing ---------------------------------------------------------------------------------------------------------

def _planes(values: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, place by place: sorted differences and small counts are mostly zeros, which any codec drops."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, np.uint64), dtype=np.uint64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts added up."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    flat, n = np.concatenate(keys), np.concatenate(counts)
    if not len(flat):
        return flat, n
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[first], np.add.reduceat(n[order], first)


# --- grams and words of texts ----------------------------------------------------------------------------------------

def _pieces(raws: list[bytes], depth: int) -> Iterator[tuple[int, bytes]]:
    """(text, piece): of each text, with its edges, pieces that overlap by the context, so each byte ends one gram."""
    for i, raw in enumerate(raws):
        whole = _EDGE * depth + raw + _EDGE
        for lo in range(0, len(whole) - depth, SLICE):
            yield i, whole[lo : lo + SLICE + depth]


def grams(raws: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, texts): the grams of lower-cased texts in slices, and which text each belongs to.

    The low byte of a key is the byte to predict, above it the context, the latest byte on top: a shift by one byte
    more than the lowest shortens the context by its oldest byte.
    """
    def keys_of(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        b = np.frombuffer(b"".join(p for _, p in held), np.uint8)
        sizes = np.array([len(p) for _, p in held])
        key = b[depth:].astype(np.uint64)
        for k in range(depth):
            key |= b[k : len(b) - depth + k].astype(np.uint64) << np.uint64(8 * (k + 1))
        inside = np.ones(len(key), bool)
        ends = np.cumsum(sizes)[:-1]
        for k in range(depth):
            inside[ends - depth + k] = False
        return key[inside], np.repeat([i for i, _ in held], sizes - depth)

    held, total = [], 0
    for i, piece in _pieces(raws, depth):
        held.append((i, piece))
        total += len(piece)
        if total >= SLICE:
            yield keys_of(held)
            held, total = [], 0
    if held:
        yield keys_of(held)


def word_hashes(raw: bytes, memory: W.WordHashes) -> Iterator[np.ndarray]:
    """64-bit hashes of a lower-cased text's words and of its end, in slices that end at white space."""
    lo = 0
    while lo < len(raw):
        cut = _SPACE.search(raw, lo + SLICE)
        hi = cut.start() if cut else len(raw)
        yield memory.of(raw[lo:hi].split())
        lo = hi
    yield memory.of([_END])


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (W.mixed(keys) % np.uint64(shards)).astype(np.int64)


class Parts:
    """The distinct grams and words of a block, with their counts in what is learned from; merged whenever they have doubled."""

    LEAST = 500_000

    def __init__(self):
        self.held = {kind: [(np.empty(0, np.uint64), np.empty(0, np.int64))] for kind in (_GRAMS, _WORDS)}

    def add(self, raws: list[bytes], depth: int, memory: W.WordHashes, counted: bool = True) -> None:
        hashed = [h for raw in raws for h in word_hashes(raw, memory)]
        for kind, found in ((_GRAMS, (k for k, _ in grams(raws, depth))), (_WORDS, [np.concatenate(hashed)] if hashed else [])):
            for keys in found:
                distinct, n = np.unique(keys, return_counts=True)
                self.held[kind].append((distinct, n if counted else np.zeros(len(n), np.int64)))
            if sum(len(k) for k, _ in self.held[kind][1:]) > max(self.LEAST, len(self.held[kind][0][0])):
                self.merged(kind)

    def merged(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[kind]) > 1:
            self.held[kind] = [_merged(*map(list, zip(*self.held[kind], strict=True)))]
        return self.held[kind][0]


_BLOCKS = "block bigint, kind int, shard int, ids array<bigint>, held array<boolean>, sizes array<int>, texts binary, keys binary, counts binary"
_NAMES = ["block", "kind", "shard", "ids", "held", "sizes", "texts", "keys", "counts"]


def _blocks(batches: Iterator[pa.RecordBatch], depth: int, shards: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) -> a block's documents in packed chunks (kind 0), and its distinct grams (1) and words (2) by shard.

    counts are those of documents that are learned from; what only others hold is asked for with a count of 0.
    """
    memory, codec, task = W.WordHashes(), pa.Codec("zstd"), TaskContext.get().partitionId() << 32
    docs, size, block, parts = [], 0, 0, Parts()

    def chunk() -> pa.RecordBatch:
        joined = b"".join(raw for _, _, raw in docs)
        row = (task + block, 0, None, [i for i, _, _ in docs], [h for _, h, _ in docs], [len(r) for _, _, r in docs],
               codec.compress(joined, asbytes=True) if joined else b"", None, None)
        for held in (False, True):
            parts.add([raw for _, h, raw in docs if h == held], depth, memory, not held)
        return pa.RecordBatch.from_pylist([dict(zip(_NAMES, row, strict=True))], _SCHEMA)

    def requests() -> Iterator[pa.RecordBatch]:
        for kind in (_GRAMS, _WORDS):
            keys, n = parts.merged(kind)
            if not len(keys):
                continue
            shard = _shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            there, first = np.unique(shard[order], return_index=True)
            rows = []
            for s, own in zip(there.tolist(), np.split(order, first[1:]), strict=True):
                rows.append(dict(zip(_NAMES, (task + block, kind, s, None, None, None, None, _pack_keys(keys[own]), _planes(n[own])), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    pending = 0
    for batch in batches:
        for i, held, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            docs.append((i, held, (raw.as_py() or b"").lower()))
            pending += len(docs[-1][2])
            if pending >= CHUNK or len(docs) >= 10_000:
                yield chunk()
                size, pending = size + pending, 0
                docs.clear()
                if size >= BLOCK:
                    yield from requests()
                    block, size, parts = block + 1, 0, Parts()
    if docs:
        yield chunk()
    yield from requests()


_SCHEMA = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    ("sizes", pa.list_(pa.int32())), ("texts", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])


def _counted(key, table):
    """A shard's requests -> (kind, key, n), one row for each distinct key."""
    keys, n = _merged([_unpack_keys(k) for k in table.column("keys").to_pylist()], [_from_planes(c, np.int64) for c in table.column("counts").to_pylist()])
    kind, shard = key[0].as_py(), key[1].as_py()
    return pa.table({"kind": pa.array(np.full(len(n), kind, np.int32)), "shard": pa.array(np.full(len(n), shard, np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n)})


# --- the context tree ------------------------------------------------------------------------------------------------

def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1/2, by Stirling's series seven places on."""
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(
        x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - np.log(np.pi) - lgamma(zeros + ones + 1.0)


class Nodes:
    """The nodes of one depth: key = context << 8 | bits of the next byte that are known, behind a leading 1; sorted by key."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray):
        self.key, self.zeros, self.ones, self.weighted = key, zeros, ones, weighted

    @classmethod
    def leaves(cls, gram: np.ndarray, n: np.ndarray) -> Nodes:
        """gram: sorted keys of grams() as int64. A byte is eight binary decisions, each a node of its own."""
        key, zeros, ones = [], [], []
        for i in range(8):
            first = np.flatnonzero(np.concatenate([[True], (gram[1:] >> (8 - i)) != (gram[:-1] >> (8 - i))])) if len(gram) else np.empty(0, np.int64)
            at = gram[first]
            key.append((at >> 8 << 8) | (1 << i) | ((at & 255) >> (8 - i)))
            total, one = (np.add.reduceat(v, first) if len(first) else v for v in (n, n * ((gram >> (7 - i)) & 1)))
            zeros.append(total - one)
            ones.append(one)
        key, zeros, ones = map(np.concatenate, (key, zeros, ones))
        order = np.argsort(key, kind="stable")
        key, zeros, ones = key[order], zeros[order].astype(np.float64), ones[order].astype(np.float64)
        return cls(key, zeros, ones, log_kt(zeros, ones))

    @classmethod
    def of(cls, table: pa.Table) -> Nodes:
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        return cls(key[order], *(table.column(c).to_numpy()[order] for c in ("zeros", "ones", "weighted")))

    def parents_of(self) -> np.ndarray:
        return (self.key >> 16 << 8) | (self.key & 255)

    def up(self) -> Nodes:
        """The nodes one byte of context shorter: half the estimate of the node's own counts, half the product of its children."""
        key, at = np.unique(self.parents_of(), return_inverse=True)
        zeros, ones, below = (np.bincount(at, v, len(key)) for v in (self.zeros, self.ones, self.weighted))
        return Nodes(key, zeros, ones, np.logaddexp(_HALF + log_kt(zeros, ones), _HALF + below))

    def table(self) -> pa.Table:
        return pa.table({"key": pa.array(self.key), "zeros": pa.array(self.zeros), "ones": pa.array(self.ones), "weighted": pa.array(self.weighted)})


class Mixed:
    """For nodes of one depth: the probabilities of 0 and 1 mixed over the depths so far, and the weight that is left for deeper ones."""

    def __init__(self, key: np.ndarray, zero: np.ndarray, one: np.ndarray, left: np.ndarray):
        self.key, self.zero, self.one, self.left = key, zero, one, left

    @classmethod
    def of(cls, table: pa.Table) -> Mixed:
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        return cls(key[order], *(table.column(c).to_numpy()[order] for c in ("zero", "one", "left")))

    @classmethod
    def above_root(cls, root: Nodes) -> Mixed:
        none = np.zeros(len(root.key))
        return cls(root.key, none, none, none + 1)

    def down(self, nodes: Nodes, parent: np.ndarray, last: bool) -> Mixed:
        """`nodes` one depth on, parent their keys here. A node's weight is the posterior that the tree ends there; the last depth takes all that is left."""
        at = np.searchsorted(self.key, parent)
        stop = np.ones(len(at)) if last else np.exp(_HALF + log_kt(nodes.zeros, nodes.ones) - nodes.weighted)
        own, total = self.left[at] * stop, nodes.zeros + nodes.ones + 1
        return Mixed(nodes.key, self.zero[at] + own * (nodes.zeros + 0.5) / total, self.one[at] + own * (nodes.ones + 0.5) / total,
                     self.left[at] * np.maximum(1 - stop, 0))

    def table(self) -> pa.Table:
        return pa.table({"key": pa.array(self.key), "zero": pa.array(self.zero), "one": pa.array(self.one), "left": pa.array(self.left)})


def gram_logs(gram: np.ndarray, mixed: Mixed) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context: its eight decisions."""
    out = np.zeros(len(gram))
    for i in range(8):
        at = np.searchsorted(mixed.key, (gram >> 8 << 8) | (1 << i) | ((gram & 255) >> (8 - i)))
        out += np.log10(np.where((gram >> (7 - i)) & 1, mixed.one[at], mixed.zero[at]))
    return out


def _sorted_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    return key[order], table.column("n").to_numpy()[order]


def _levels(table: pa.Table, steps: int, deepest: bool) -> list[Nodes]:
    """The nodes of a bucket at its own depth and at the `steps` depths above, the shallowest last."""
    out = [Nodes.leaves(*_sorted_grams(table)) if deepest else Nodes.of(table)]
    for _ in range(steps):
        out.append(out[-1].up())
    return out


# Functions that Spark calls with a group are made without annotations: it takes their number of arguments, not their types.
def _climb(steps: int, deepest: bool):
    return lambda table: _levels(table, steps, deepest)[-1].table()


def _descend(steps: int, deepest: bool):
    def run(table, above):
        levels = _levels(table, steps, deepest)
        mixed = Mixed.of(above)
        for k in range(steps - 1, -1, -1):
            mixed = mixed.down(levels[k], levels[k].parents_of(), deepest and k == 0)
        if not deepest:
            return mixed.table()
        gram, _ = _sorted_grams(table)
        return pa.table({"key": pa.array(gram), "value": pa.array(gram_logs(gram, mixed))})

    return run


def _root(table):
    root = Nodes.of(table)
    return Mixed.above_root(root).down(root, root.key, False).table()


_NODE, _MIXED = "key bigint, zeros double, ones double, weighted double", "key bigint, zero double, one double, left double"


def ladder(depth: int) -> list[int]:
    """Depths between which a step of the tree goes: two bytes at a time, so that a context's subtree has at most 2^16 contexts, then 1 and 0."""
    steps = [depth]
    while steps[-1] > 0:
        steps.append(steps[-1] - (2 if steps[-1] > 2 else 1))
    return steps


def _bucket(context: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(context), F.lit(buckets))


def gram_table(counts: DataFrame, depth: int) -> DataFrame:
    """counts(key, n), one row a gram -> (key, value): log10 of the weighted probability of its byte after its context.

    A step up or down works on buckets of whole contexts of the shallower depth; what two bytes of context and one of
    text can hold bounds a context, BUCKET rows on average a bucket. The root step has at most 65,280 nodes.
    """
    rungs = ladder(depth)
    tables, keyed = {depth: counts}, {}
    for e, s in zip(rungs, rungs[1:], strict=False):
        n = tables[e].count() // BUCKET + 1
        keyed[e] = tables[e].withColumn("bucket", _bucket(F.shiftright("key", 8 * (e - s + 1)), n)), n
        tables[s] = stored(keyed[e][0].groupBy("bucket").applyInArrow(_climb(e - s, e == depth), _NODE), "nodes")
    # The empty context is one group.
    mixed = stored(tables[0].groupBy(F.shiftright("key", 8)).applyInArrow(_root, _MIXED), "mixed")
    for e, s in list(zip(rungs, rungs[1:], strict=False))[::-1]:
        rows, n = keyed[e]
        above = mixed.withColumn("bucket", _bucket(F.shiftright("key", 8), n))
        lower = stored(rows.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(_descend(e - s, e == depth), "key bigint, value double" if e == depth else _MIXED), "mixed")
        forget(mixed)
        forget(tables[s])
        mixed = lower
    return mixed


# --- answers ---------------------------------------------------------------------------------------------------------

def _answers(key, asked, known):
    """A shard's values for each block that asked: float32 for grams, doubles for words."""
    at = known.column("key").to_numpy().view(np.uint64)
    order = np.argsort(at)
    at, value = at[order], known.column("value").to_numpy()[order].astype(np.float32 if key[0].as_py() == _GRAMS else np.float64)
    out = [_planes(value[np.searchsorted(at, _unpack_keys(k))]) for k in asked.column("keys").to_pylist()]
    return pa.table({"block": asked.column("block"), "kind": asked.column("kind"), "shard": asked.column("shard"), "value": pa.array(out, pa.binary())})


def _lookup(answers: pa.Table, kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """The answers for the distinct keys of a block, in the keys' order; they came by shard, in key order within each."""
    own = sorted((s, v) for t, s, v in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "value")), strict=True) if t == kind)
    out = np.empty(len(keys))
    if own:
        out[np.argsort(_shard_of(keys, shards), kind="stable")] = np.concatenate([_from_planes(v, np.float32 if kind == _GRAMS else np.float64) for _, v in own])
    return out


class Table:
    """Values by key, for keys that are all in it: entries in the order of a bijective hash, found through its first bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(hashed := W.mixed(keys))
        self.hashed, self.values = hashed[order], values[order]
        bits = max(1, len(keys).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        starts = np.cumsum(np.bincount((self.hashed >> self.shift).astype(np.int64), minlength=1 << bits))
        self.starts = np.concatenate([[0], starts[:-1]]).astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        hashed = W.mixed(keys)
        at = self.starts[(hashed >> self.shift).astype(np.int64)]
        missed = np.flatnonzero(self.hashed[at] != hashed)
        while len(missed):
            at[missed] += 1
            missed = missed[self.hashed[at[missed]] != hashed[missed]]
        return self.values[at]


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, n_bytes bigint, base_score double, score double"


def _texts(chunks: pa.Table) -> Iterator[tuple[list, list, list[bytes]]]:
    codec = pa.Codec("zstd")
    for ids, held, sizes, texts in zip(*(chunks.column(c).to_pylist() for c in ("ids", "held", "sizes", "texts")), strict=True):
        joined = codec.decompress(texts, sum(sizes), asbytes=True) if texts else b""
        ends = np.cumsum([0, *sizes]).tolist()
        yield ids, held, [joined[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _scores(chunks: pa.Table, answers: pa.Table, depth: int, shards: int, tokens: int, distinct: int) -> pa.Table:
    """A block's documents and the answers to it -> a row a document. The block's keys are found again rather than sent along."""
    memory, parts = W.WordHashes(), Parts()
    for _, _, raws in _texts(chunks):
        parts.add(raws, depth, memory)
    gram, word = parts.merged(_GRAMS)[0], parts.merged(_WORDS)[0]
    logs = Table(gram, _lookup(answers, _GRAMS, gram, shards))
    count = _lookup(answers, _WORDS, word, shards)
    base = np.log10((count + 0.1) / (tokens + 0.1 * (distinct + 1)))
    known, base = Table(word, count > 0), Table(word, base)
    out: dict[str, list] = {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score")}
    for ids, held, raws in _texts(chunks):
        score = np.zeros(len(raws))
        for keys, owner in grams(raws, depth):
            score += np.bincount(owner, logs.of(keys), len(raws))
        out["score"].append(score)
        told = np.zeros((len(raws), 3))
        for i, raw in enumerate(raws):
            for hashes in word_hashes(raw, memory):
                told[i] += len(hashes), known.of(hashes).sum(), base.of(hashes).sum()
        for c, v in zip(("n_tokens", "n_known"), told[:, :2].astype(np.int64).T, strict=True):
            out[c].append(v)
        out["base_score"].append(told[:, 2])
        out["doc_id"].extend(ids)
        out["held_out"].extend(held)
        out["n_bytes"].append(np.array([len(raw) for raw in raws], np.int64))
    return pa.table({c: pa.array(v, pa.int64() if c == "doc_id" else pa.bool_()) if c in ("doc_id", "held_out") else pa.array(np.concatenate(v)) for c, v in out.items()})


def scored(docs: DataFrame, depth: int = DEPTH, one_in: int = 10) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), one row per row.

    Learned from are documents whose crc32(doc_id as text) mod one_in is not 0; the others, and null ids, are held out.
    A-Z are lower-cased. score is the log10 probability of the text's UTF-8 bytes and its end: each byte is eight binary
    decisions; every context of 0 to `depth` bytes keeps a Krichevsky-Trofimov estimate for each, and the context
    tree's posterior weights mix them. bits_per_byte is the code length over the bytes and the end. base_score, n_tokens
    and n_known follow the words and one end: counts of all words of the documents learned from (train_tokens), kept
    under 64-bit hashes. Null is empty, whose only token is its end. Repeated rows each count. depth is at most 6. No
    rows, no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % one_in == 0, F.lit(True))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(total // SHARD) + 1
    blocks = stored(rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(partial(_blocks, depth=depth, shards=shards), _BLOCKS), "blocks")
    asked = blocks.where("kind > 0").select("block", "kind", "shard", "keys", "counts")
    counts = stored(asked.groupBy("kind", "shard").applyInArrow(_counted, "kind int, shard int, key bigint, n bigint"), "counts")
    words = counts.where(F.col("kind") == _WORDS)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    grams_of = counts.where(F.col("kind") == _GRAMS)
    logs = gram_table(grams_of.select("key", "n"), depth)
    known = grams_of.select("kind", "shard", "key").join(logs, "key").unionByName(words.select("kind", "shard", "key", F.col("n").cast("double").alias("value")))
    answers = stored(asked.drop("counts").groupBy("kind", "shard").cogroup(known.groupBy("kind", "shard")).applyInArrow(
        _answers, "block bigint, kind int, shard int, value binary"), "answers")
    forget(counts)
    forget(logs)
    texts = blocks.where("kind = 0").select("block", "ids", "held", "sizes", "texts")
    tokens, distinct = int(tokens), int(distinct)
    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda chunks, told: _scores(chunks, told, depth, shards, tokens, distinct), _SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "n_bytes",
                      (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
