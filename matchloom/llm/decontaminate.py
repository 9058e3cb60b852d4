"""Benchmark decontamination on a positional inverted index of the training documents.

The index is sharded by document, as search engines shard theirs: a row holds the postings of one document (its terms
in order, where each term's positions end, the positions), and lives as a table in the shared folder. A search sends
the test phrases to every shard; inside it offset-adjusted position lists are intersected from the rarest term on, so
neither texts nor postings are shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import words as W
from matchloom.llm.tables import stored, unused

#: Words of a test window.
WINDOW = 13
#: Words of test items that are sent to the shards at once (some 100 MB in a worker); more items make more passes over the index.
BLOCK_WORDS = 500_000
#: A document is contaminated when hit words are at least one in so many.
SHARE = 20

#: Bytes of a word stay, A-Z in lower case; any other byte parts words.
_TO_WORDS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

INDEX = "row bigint, doc_id bigint, n_words bigint, terms array<bigint>, ends array<int>, positions array<int>"
RANGES = "array<struct<item:string,start:int,stop:int>>"


def split_words(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TO_WORDS).split() if raw else []


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = W.WordHashes()
    for batch in batches:
        raws = batch.column(2).cast(pa.binary()).to_pylist()
        for lo, hi in W.slices(raws):
            sizes, counts, terms, ends, places = [], [0], [], [], []
            for raw in raws[lo:hi]:
                h = memory.of(split_words(raw)).view(np.int64)
                order = np.argsort(h, kind="stable").astype(np.int32)
                h = h[order]
                last = np.flatnonzero(np.append(h[1:] != h[:-1], True)) if len(h) else np.empty(0, np.int64)
                sizes.append(len(h))
                counts.append(len(last))
                terms.append(h[last])
                ends.append((last + 1).astype(np.int32))
                places.append(order)
            cut = pa.array(np.cumsum(counts), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(cut, pa.array(np.concatenate(terms))), pa.ListArray.from_arrays(cut, pa.array(np.concatenate(ends))),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(places))),
            ], ["row", "doc_id", "n_words", "terms", "ends", "positions"])


def index(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> the stored positional index: one row for each row of docs, also for null and empty texts (no terms).

    A term is the 64-bit hash of a word. Documents keep a row number of the index, so repeated or null doc_id values stay apart.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_postings, INDEX), "postings")


class Tests:
    """The windows of a block of test items, with their words ordered from the rarest."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        memory = W.WordHashes()
        of: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.names = [name for name, _ in items]
        for k, (_, words) in enumerate(items):
            h = memory.of(words).tolist()
            size = min(width, len(h))
            for i in range(len(h) - size + 1 if h else 0):
                of[tuple(h[i : i + size])].add(k)
        self.windows = list(of)
        self.items = [sorted(x) for x in of.values()]
        self.terms = np.unique(np.array([t for w in self.windows for t in w], np.uint64))
        self.steps: list[list[tuple[int, int]]] = []
        self.by_anchor: dict[int, np.ndarray] = {}
        self.needs = np.empty((0, width), np.int64)

    def order(self, frequency: np.ndarray, width: int) -> None:
        """frequency: documents that hold each term."""
        at = {int(t): i for i, t in enumerate(self.terms)}
        anchors = defaultdict(list)
        self.needs = np.empty((len(self.windows), width), np.int64)
        for w, window in enumerate(self.windows):
            steps = sorted(((at[t], o) for o, t in enumerate(window)), key=lambda s: (frequency[s[0]], s[0], s[1]))
            self.steps.append(steps)
            self.needs[w] = [t for t, _ in steps] + [steps[0][0]] * (width - len(steps))
            anchors[steps[0][0]].append(w)
        self.by_anchor = {t: np.array(w) for t, w in anchors.items()}
        self.is_anchor = np.zeros(len(self.terms), bool)
        self.is_anchor[list(anchors)] = True


def phrase(steps: list[tuple[int, int]], positions) -> np.ndarray:
    """Starts of a window: the rarest word's positions less its offset, kept where each next word stands at its own offset."""
    starts = positions(steps[0][0]) - steps[0][1]
    for term, offset in steps[1:]:
        if not len(starts):
            break
        p, want = positions(term), starts + offset
        i = np.searchsorted(p, want)
        i[i == len(p)] = 0
        starts = starts[p[i] == want]
    return starts


def close(steps: list[tuple[int, int]], positions, span: int) -> list[tuple[int, int]]:
    """Stretches of at most `span` words that hold every word of a window, in any order; one for each place where a stretch can end."""
    lists = [positions(t) for t in {t for t, _ in steps}]
    stop = np.unique(np.concatenate(lists))
    start = np.full(len(stop), np.iinfo(np.int64).max)
    for p in lists:
        i = np.searchsorted(p, stop, "right") - 1
        start = np.minimum(start, np.where(i >= 0, p[np.maximum(i, 0)], -(1 << 40)))
    good = stop - start < span
    return list(zip(start[good].tolist(), (stop[good] + 1).tolist(), strict=True))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))


def _searcher(shared, slack: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = shared.value
        slot = np.full(len(tests.terms), -1, np.int64)
        for batch in batches:
            terms, t_cut = _flat(batch.column(1))
            ends, _ = _flat(batch.column(2))
            places, p_cut = _flat(batch.column(3))
            at = np.searchsorted(tests.terms, terms.view(np.uint64))
            at[at == len(tests.terms)] = 0
            known = np.flatnonzero(tests.terms[at] == terms.view(np.uint64))
            doc = np.searchsorted(t_cut, known, "right") - 1
            rows, found = [], []
            for d in np.unique(doc[tests.is_anchor[at[known]]]):
                mine = known[slice(*np.searchsorted(doc, [d, d + 1]))]
                slot[at[mine]] = mine
                hits = _search(tests, at[mine], slot, ends, places[p_cut[d] : p_cut[d + 1]], t_cut[d], slack)
                slot[at[mine]] = -1
                if hits:
                    rows.append(d)
                    found.append(hits)
            if rows:
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)),
                    pa.array([[{"item": i, "start": a, "stop": b} for i, a, b in x] for x in found], pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))),
                ], ["row", "ranges"])

    return run


def _search(tests: Tests, present: np.ndarray, slot, ends, places, first: int, slack: int | None) -> list[tuple[str, int, int]]:
    windows = np.concatenate([tests.by_anchor[t] for t in present[tests.is_anchor[present]]])
    windows = windows[(slot[tests.needs[windows]] >= 0).all(axis=1)]

    def positions(term: int) -> np.ndarray:
        s = slot[term]
        return places[ends[s - 1] if s > first else 0 : ends[s]].astype(np.int64)

    by_item = defaultdict(list)
    for w in windows.tolist():
        size = len(tests.steps[w])
        if slack is None:
            ranges = [(s, s + size) for s in phrase(tests.steps[w], positions).tolist()]
        else:
            ranges = close(tests.steps[w], positions, size + slack)
        for k in tests.items[w] if ranges else ():
            by_item[k] += ranges
    return [(tests.names[k], a, b) for k, ranges in by_item.items() for a, b in _merged(ranges)]


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        n = np.zeros(len(terms), np.int64)
        for batch in batches:
            t = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.searchsorted(terms, t)
            at[at == len(terms)] = 0
            n += np.bincount(at[terms[at] == t], minlength=len(terms))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["term", "n"])

    return run


def matches(postings: DataFrame, items: DataFrame, width: int = WINDOW, slack: int | None = None) -> DataFrame:
    """index() and items(item_id, text) -> (row, ranges): rows of the index with any match, and for each item the word ranges it covers.

    slack None: exact phrases, the ranges that occurrences of the item's windows cover. A number: also looser places,
    stretches of window size + slack words that hold all words of a window in any order. An item of fewer words than
    `width` is one window; one without words none. Items with the same id are one item; a null id is the empty string.
    Items go out in hash blocks of about BLOCK_WORDS words, each one pass over the index.
    """
    spark = postings.sparkSession
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    # A word has a byte at least and a separator: this bounds the words without splitting texts.
    volume = items.agg(F.sum(F.floor((F.octet_length("text") + 1) / 2))).first()[0] or 0
    blocks = max(1, -(-int(volume) // (4 * BLOCK_WORDS)))
    out = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        tests = Tests([(r["item"], split_words((r["text"] or "").encode())) for r in own], width)
        if not len(tests.terms):
            continue
        counted = postings.select("terms").mapInArrow(_counter(spark.sparkContext.broadcast(tests.terms)), "term bigint, n bigint")
        frequency = np.zeros(len(tests.terms), np.int64)
        for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most one row for each test term
            frequency[r["term"]] = r["n"]
        tests.order(frequency, width)
        out.append(postings.select("row", "terms", "ends", "positions").mapInArrow(
            _searcher(spark.sparkContext.broadcast(tests), slack), f"row bigint, ranges {RANGES}"))
    if not out:
        return spark.createDataFrame([], f"row bigint, ranges {RANGES}")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found if len(out) == 1 else found.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of docs.

    A word inside any occurrence of an item's window is hit; contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    Null, empty or wordless texts have no words and are clean; no items or no rows give clean or no rows. Other columns are not read.
    """
    return _verdicts(index(docs), items)


def _verdicts(postings: DataFrame, items: DataFrame) -> DataFrame:
    found = matches(postings, items)
    covered = F.aggregate(
        F.array_sort(F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(r["start"], acc["stop"]))).alias("n"), F.greatest(acc["stop"], r["stop"]).alias("stop")),
        lambda acc: acc["n"])
    names = F.array_sort(F.array_distinct(F.transform("ranges", lambda r: r["item"])))
    found = found.select("row", covered.cast("bigint").alias("n_hit"), names.alias("items"))
    out = postings.select("row", "doc_id", "n_words").join(found, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    held = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "row", "doc_id", "n_words", hit.alias("n_hit"), F.size(held).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(held, ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names.

    A verdict follows from the text alone: rows are told apart by a 64-bit hash of it, so null and shared ids matter to no one.
    """
    digest, own = F.xxhash64(F.col("text").cast("string")), unused(docs, "_contaminated")
    told = contamination(docs.select(digest.alias("doc_id"), "text"), items)
    bad = told.where("contaminated").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(bad, digest == F.col(own), "left_anti")
