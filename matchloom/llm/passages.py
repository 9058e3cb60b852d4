"""Repeated and nearly repeated passages: paragraph MinHash banding, verified by exact Jaccard and clustered by components.

A paragraph is a line of some length. A passage can also stand inside longer lines, so the words of a document are
cut a second way, into short windows whose places their own content decides: equal stretches of text have equal windows.
A window also knows the words up to the end of the next one, so that where these are equal too all between them is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import near_dup
from matchloom.llm import words as W
from matchloom.llm.tables import stored

#: Words from which on a line is a paragraph.
PARAGRAPH = 20
#: Words of a window.
WINDOW = 12
#: A window starts at the least shingle of so many in a row: any stretch of 51 words that occurs twice holds a window in both places.
SPAN = 40
#: Eleven bands of two minima: a pair at similarity 0.75 shares none with probability (1 - 0.75^2)^11 = 1e-4. Bands of one minimum need
#: fewer values for that, but let every two paragraphs with a phrase in common meet.
BANDS = 11
#: Minima of a band.
ROWS = 2

_SECOND = np.uint64(0xA24BAED4963EE407)
_INVERSE = np.uint64(pow(int(W._ODD), -1, 1 << 64))


def _paragraphs(raw: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Words of a text, and (first word, words) of its paragraphs."""
    words: list[bytes] = []
    out = []
    for line in raw.lower().split(b"\n"):
        own = line.split()
        if len(own) >= PARAGRAPH:
            out.append((len(words), len(own)))
        words += own
    return words, out


def anchors(s: np.ndarray) -> np.ndarray:
    """Positions that are the first least one in some SPAN shingles in a row; of fewer shingles, the first least one."""
    if not len(s):
        return np.empty(0, np.int64)
    if len(s) <= SPAN:
        return np.array([s.argmin()])
    return np.unique(np.lib.stride_tricks.sliding_window_view(s, SPAN).argmin(axis=1) + np.arange(len(s) - SPAN + 1))


def windows(h: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows of a document's word hashes, whose shingles are s, and two hashes of each window's words;
    then how many words lie from its end to the end of the next window, and their hash; 0 for the last."""
    if len(h) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    at = anchors(s[: len(h) - WINDOW + 1])
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        one = one * W._ODD + h[at + k]
        two = (two ^ h[at + k]) * _SECOND
        two ^= two >> W._32
    # A sum of hashes times rising powers, over a stretch: its start's power is divided out.
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(np.full(len(h), W._ODD)))])
    down = np.cumprod(np.full(len(h) + 1, _INVERSE))
    ends = at + WINDOW
    gap, rest = np.append(np.diff(at), 0), np.zeros(len(at), np.uint64)
    rest[:-1] = W.mixed((upto[ends[1:]] - upto[ends[:-1]]) * down[ends[:-1]])
    return at, W.mixed(one), two, gap, rest


_KEYS = [f"k{b}" for b in range(BANDS)]
_UNITS = "doc_id bigint, start int, n_words int, digest binary, check int, gap int, rest bigint, " + ", ".join(f"{k} bigint" for k in _KEYS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs with a digest of their words and a key for each band; windows with one key and a second hash, without a digest."""
    memory = W.WordHashes()
    for batch in batches:
        ids, raws = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for lo, hi in W.slices(raws):
            doc, start, size, digest, parts, more = [], [], [], [], [], []
            for i in range(lo, hi):
                words, lines = _paragraphs(raws[i] or b"")
                h = memory.of(words)
                s = W.shingles(h)
                for a, n in lines:
                    doc.append(ids[i])
                    start.append(a)
                    size.append(n)
                    digest.append(xxhash.xxh3_128_digest(h[a : a + n].tobytes()))
                    parts.append(s[a : a + n - W.SHINGLE + 1])
                more.append((ids[i], *windows(h, s)))
            keys = np.zeros((BANDS, len(parts)), np.uint64)
            if parts:
                flat, first = np.concatenate(parts), np.cumsum([0, *(len(x) for x in parts[:-1])])
                for v in range(BANDS * ROWS):
                    least = np.minimum.reduceat((flat ^ near_dup.FLIPS[v]) * near_dup.FACTORS[v], first)
                    keys[v // ROWS] = W.mixed(keys[v // ROWS] * W._ODD + W.mixed(least + np.uint64(v)))
            places = np.concatenate([m[1] for m in more])
            n = len(places)
            none = pa.nulls(n, pa.int64())
            lines = len(parts)
            rest = [pa.chunked_array([pa.array(k.view(np.int64)), none]).combine_chunks() for k in keys[1:]]
            yield pa.RecordBatch.from_arrays([
                pa.array([*doc, *(m[0] for m in more for _ in m[1])], pa.int64()),
                pa.array(np.concatenate([np.array(start, np.int64), places]).astype(np.int32)),
                pa.array([*size, *[WINDOW] * n], pa.int32()), pa.array([*digest, *[None] * n], pa.binary()),
                pa.array(np.concatenate([np.zeros(lines, np.uint64), *(m[3] for m in more)]).astype(np.uint32).view(np.int32)),
                pa.array(np.concatenate([np.zeros(lines, np.int64), *(m[4] for m in more)]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(lines, np.uint64), *(m[5] for m in more)]).view(np.int64)),
                pa.array(np.concatenate([keys[0], *(m[2] for m in more)]).view(np.int64)), *rest,
            ], ["doc_id", "start", "n_words", "digest", "check", "gap", "rest", *_KEYS])


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = W.WordHashes()
    for batch in batches:
        for raw, places in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            words, lines = _paragraphs(raw.as_py() or b"")
            h, size = memory.of(words), dict(lines)
            own = [(x["id"], np.unique(W.shingles(h[x["start"] : x["start"] + size[x["start"]]]))) for x in places if x["start"] in size]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([x.tobytes() for _, x in own], pa.binary())], ["id", "shingles"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, kind, start, n_words, first_doc, first_start, removed): passages that occur in other words' company too.

    kind `paragraph`: lines of 20 words and more whose five-word shingle sets have a Jaccard similarity of 0.75 or more
    with another's, alone or through others (a component). kind `window`: stretches that occur again word for word, of 12
    words at a place that content decides, or up to the end of the next such place if all of it is as in the group's
    first place; these overlap. Of any 51 equal words one window at least is found, and what is listed of a longer stretch
    leaves at most 39 words before its first and 32 after its last window. The first place of a group, in the order of (doc_id, start), stays, the others are removed. start counts words of the text from 0.

    No row for what occurs once; null, empty and short texts have none. A null doc_id takes part in nothing. The
    passages of repeated rows are listed and, with the same doc_id and start as the first, not removed. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    units = stored(rows.mapInArrow(_cut, _UNITS).withColumn("unit", F.monotonically_increasing_id()), "units")

    texts = units.where("digest is not null")
    # Paragraphs of the same words are one node.
    nodes = stored(texts.groupBy("digest").agg(
        F.min("unit").alias("id"), F.count(F.lit(1)).alias("copies"), *[F.min(k).alias(k) for k in _KEYS]), "paragraphs")
    members = near_dup.shared_buckets(nodes.select("id", F.explode(F.array(*_KEYS)).alias("key")))
    places = texts.select("unit", "doc_id", "start").join(members.select("id").distinct(), F.col("unit") == F.col("id")).groupBy(F.col("doc_id").alias("_doc")).agg(
        F.collect_list(F.struct("id", "start")).alias("places"))
    shingles = rows.join(places, F.col("doc_id") == F.col("_doc")).select("text", "places").mapInArrow(_wanted_sets, "id bigint, shingles binary")
    whole = near_dup.clusters(members, stored(shingles.dropDuplicates(["id"]), "shingles"))
    named = nodes.select("digest", "id", "copies").join(whole, F.col("id") == F.col("node"), "left").where("component is not null or copies > 1")
    told = texts.select("doc_id", "start", "n_words", "digest").join(named.select("digest", F.coalesce("component", "id").alias("component")), "digest")
    told = stored(told.drop("digest"), "paragraph_groups")
    # Heads are tables of their own: a join with a stored table can be split where a group is hot, one with an aggregate below it can not.
    heads = stored(told.groupBy("component").agg(F.min(F.struct("doc_id", "start")).alias("head")), "heads")
    paragraphs = told.join(heads, "component").select("doc_id", F.lit("paragraph").alias("kind"), "start", "n_words", "head")

    cut = units.where("digest is null").select("doc_id", "start", "n_words", F.col("k0").alias("key"), "check", "gap", "rest")
    groups = stored(cut.groupBy("key", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "window_keys")
    again = stored(cut.join(groups, ["key", "check"]), "window_groups")
    heads = stored(again.groupBy("key", "check").agg(F.min(F.struct("doc_id", "start", "gap", "rest")).alias("first")), "heads")
    goes_on = (F.col("gap") == F.col("first.gap")) & (F.col("rest") == F.col("first.rest")) & (F.struct("doc_id", "start") != F.struct("first.doc_id", "first.start"))
    stretches = again.join(heads, ["key", "check"]).select(
        "doc_id", F.lit("window").alias("kind"), "start", (F.col("n_words") + F.when(goes_on, F.col("gap")).otherwise(0)).alias("n_words"),
        F.struct("first.doc_id", "first.start").alias("head"))
    return paragraphs.unionByName(stretches).select(
        "doc_id", "kind", "start", "n_words", F.col("head.doc_id").alias("first_doc"), F.col("head.start").alias("first_start"),
        (F.struct("doc_id", "start") != F.col("head")).alias("removed"))
