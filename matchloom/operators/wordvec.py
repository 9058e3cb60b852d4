"""Documents as the mean of their words' vectors, looked up in a table of static word vectors, and such a table trained on a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom import fixed_values as V
from matchloom.functions.tokens import counted, words
from matchloom.sources.tables import materialise

#: Words of a block of documents, a longer document apart.
BLOCK_WORDS = 16_000_000
#: Words of a part of a block, which are counted at once.
PART_WORDS = 1_000_000
#: Tasks for each core that cut documents into blocks, at most: the more documents a task has, the fuller are its blocks.
CUTS = 2
#: Entries whose vectors are added up at once.
SLICE_ENTRIES = 20_000


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, tf): each word of a document once, counted inside its row."""
    return docs.select(key, F.inline(counted(words(F.col(text)))).alias("word", "tf"))


class _Part(NamedTuple):
    """Some documents of a block: words of each, places and counts of each one's different words, and the words at the places."""

    keys: pa.Array
    lengths: np.ndarray
    places: np.ndarray
    tfs: np.ndarray
    words: pa.Array


def _part(keys: pa.Array, words: pa.Array, lengths: np.ndarray) -> _Part:
    coded = words.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    entry, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, place = np.divmod(entry, width)
    return _Part(keys, np.bincount(row, minlength=len(lengths)).astype(np.int32), place.astype(np.int32), tf.astype(np.int32), coded.dictionary.cast(pa.string()))


def _block(number: int, parts: list[_Part]) -> pa.RecordBatch:
    keys, lengths, words = ([getattr(p, c) for p in parts] for c in ("keys", "lengths", "words"))
    coded = pa.concat_arrays(words).dictionary_encode()
    code, width, at, places, tfs = coded.indices.to_numpy(zero_copy_only=False), max(1, len(coded.dictionary)), 0, [], []
    while parts:  # a part goes as it is taken
        part = parts.pop(0)
        place = code[at : at + len(part.words)][part.places]
        order = np.argsort(np.repeat(np.arange(len(part.lengths)), part.lengths) * width + place)  # places rise within a document
        places.append(place[order])
        tfs.append(part.tfs[order])
        at += len(part.words)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([
        pa.array([number]), one(pa.concat_arrays(keys)), one(coded.dictionary),
        *(pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (lengths, places, tfs))], ["block", "keys", "words", "lengths", "places", "tfs"])


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words) -> blocks of documents: keys, words of each, and the block's different words with each entry's place among them."""
    made = TaskContext.get().partitionId() << 32
    parts: list[_Part] = []
    room = BLOCK_WORDS
    for batch in batches:
        lengths = np.nan_to_num(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        lo = 0
        while lo < len(batch):
            hi, part = (int(np.searchsorted(ends, ends[lo] + n, "right")) - 1 for n in (room, PART_WORDS))
            if hi <= lo and parts:
                yield _block(made, parts)
                made, parts, room = made + 1, [], BLOCK_WORDS
                continue
            hi = max(lo + 1, min(hi, part))
            parts.append(_part(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lengths[lo:hi]))
            room -= int(ends[hi] - ends[lo])
            lo = hi
        batch = None  # its words are counted; the last block is made without them
    if parts:
        yield _block(made, parts)


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers, mostly small: their bytes by significance, compressed."""
    by_byte = x.astype("<i4", copy=False).view(np.uint8)
    return pa.compress(b"".join(by_byte[k::4].tobytes() for k in range(4)), "zstd", asbytes=True)


def _numbers(squeezed: pa.Scalar, count: int) -> np.ndarray:
    whole = pa.decompress(squeezed.as_buffer(), 4 * count, "zstd")
    return np.ascontiguousarray(np.frombuffer(whole, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _squeezed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_block_words() whose places, as steps from one to the next, and counts take a third of the room."""
    for made in _block_words(batches):
        place, tf = (np.frombuffer(made[c][0].as_buffer(), np.int32) for c in ("places", "tfs"))
        columns = [*made.columns[:4], *(pa.array([_squeezed(x)], pa.binary()) for x in (np.diff(place, prepend=np.int32(0)), tf))]
        yield pa.RecordBatch.from_arrays(columns, made.schema.names)


class _Vectors:
    """The vectors of a block's words where they arrived, without a copy of all of them."""

    def __init__(self, known: pa.Table, words: int, width: int):
        self.width = width
        self.chunks = [c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in known.column("known").chunks]
        self.ends = np.cumsum([0, *map(len, self.chunks)])
        places = known.column("place").to_numpy()
        first = np.arange(len(places))
        if len(np.unique(places)) < len(places):  # of several the smallest, so that all blocks agree
            first = np.lexsort([*np.concatenate(self.chunks).T[::-1], places])
            first = first[np.concatenate([[True], places[first][1:] != places[first][:-1]])]
        #: Of a place's vector, -1 where there is none.
        self.at = np.full(words, -1, np.int64)
        self.at[places[first]] = first

    def take(self, at: np.ndarray) -> np.ndarray:
        out = np.empty((len(at), self.width))
        order = np.argsort(at)
        cuts = np.searchsorted(at[order], self.ends)
        for chunk, start, lo, hi in zip(self.chunks, self.ends, cuts, cuts[1:]):
            out[order[lo:hi]] = chunk[at[order[lo:hi]] - start]
        return out


def _means(width: int):
    """(block rows, (block, places, vecs) rows) of a block -> (key, n_words, n_known, vec)."""

    def of(blocks: pa.Table, known: pa.Table) -> pa.Table:
        keys, sizes, found, vecs = [], [], [], []
        for i in range(blocks.num_rows):
            own = blocks.column("keys")[i].values
            lengths = np.frombuffer(blocks.column("lengths")[i].as_buffer(), np.int32)
            place, tf = (_numbers(blocks.column(c)[i], int(lengths.sum())) for c in ("places", "tfs"))
            place = np.cumsum(place, dtype=np.int32)
            vectors = _Vectors(known, int(place.max(initial=-1)) + 1, width)
            row = np.repeat(np.arange(len(own), dtype=np.int32), lengths)
            n_words, n_known, sums = np.zeros(len(own)), np.zeros(len(own)), np.zeros((len(own), width))
            for lo in range(0, len(row), SLICE_ENTRIES):
                r, n, v = row[lo : lo + SLICE_ENTRIES], tf[lo : lo + SLICE_ENTRIES].astype(np.float64), vectors.at[place[lo : lo + SLICE_ENTRIES]]
                docs = slice(r[0], r[-1] + 1)
                n_words[docs] += np.bincount(r - r[0], n)
                hit = v >= 0
                if hit.any():
                    n_known[docs] += np.bincount(r - r[0], np.where(hit, n, 0.0))
                    r, n, v = r[hit], n[hit], v[hit]
                    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                    sums[r[first]] += np.add.reduceat(vectors.take(v) * n[:, None], first, axis=0)
            sums /= np.maximum(1, n_known)[:, None]
            offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * width)
            keys.append(own)
            sizes.append(pa.array(n_words.astype(np.int64)))
            found.append(pa.array(n_known.astype(np.int64)))
            vecs.append(pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()), mask=pa.array(n_known == 0)))
        return pa.table([pa.chunked_array(c) for c in (keys, sizes, found, vecs)], ["_key", "n_words", "n_known", "vec"])

    return of


def document_means(docs: DataFrame, table: DataFrame, key: str, text: str, width: int, word: str = "word", vec: str = "vec") -> DataFrame:
    """(key, n_words, n_known, vec): the mean of the vectors of a document's words, each occurrence counting.

    `table` has a row for each word it knows, of any number: it is joined, never collected. Words that it does not
    know, or whose vector is null or not `width` long, are left out of the mean; a document without any known word has
    a null vector; of several vectors of a word the smallest counts. Documents are worked on in blocks of about
    BLOCK_WORDS words: a block asks for each of its different words once, so what is shuffled is a vector a block and
    word, not one a document and part, as narrow as the table has it, and no word is asked for more often than there
    are blocks. Of the table nothing else is shuffled or stored.
    """
    narrow = isinstance(table.schema[vec].dataType, T.ArrayType) and isinstance(table.schema[vec].dataType.elementType, T.FloatType)
    known = table.where(F.size(vec) == width).select(F.col(word).alias("_word"), F.col(vec).cast("array<float>" if narrow else "array<double>").alias("known"))
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    most = CUTS * docs.sparkSession.sparkContext.defaultParallelism
    rows = rows.coalesce(most).select("key", words(F.col("text")).alias("words"))
    fields = [("block", T.LongType()), ("keys", T.ArrayType(kind)), ("words", T.ArrayType(T.StringType())), *((c, T.BinaryType()) for c in ("lengths", "places", "tfs"))]
    blocks = materialise(rows.mapInArrow(_squeezed_blocks, T.StructType([T.StructField(*f) for f in fields])), "word_blocks")
    asked = blocks.select("block", F.posexplode("words").alias("place", "word"))
    told = asked.join(known, F.col("word") == F.col("_word")).select(F.col("block").alias("_block"), "place", "known")
    schema = T.StructType([
        T.StructField("_key", kind), T.StructField("n_words", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    made = blocks.drop("words").groupBy("block").cogroup(told.groupBy("_block")).applyInArrow(_means(width), schema)
    return made.withColumnRenamed("_key", key)


def trained_table(docs: DataFrame, text: str, width: int = 64, min_count: int = 2, partitions: int = 8, seed: int = V.RANDOM_STATE) -> DataFrame:
    """(word, vec) by Spark ML's Word2Vec over the corpus, trained in a stated number of parts, on which the vectors depend.

    Its fit keeps the vocabulary on the driver; tables trained elsewhere go straight into document_means().
    """
    w2v = Word2Vec(inputCol="_words", outputCol="_vec", vectorSize=width, minCount=min_count, numPartitions=partitions, seed=seed)
    model = w2v.fit(docs.select(words(F.col(text)).alias("_words")))
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))
