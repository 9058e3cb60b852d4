"""Vectors for texts: hashed words, a joined vector table, or a user encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.tokens import words
from matchloom.functions.vectors import HASH_WIDTH, unit
from matchloom.operators import grams


def _hashed_rows(words: pa.Array, width: int) -> pa.Array:
    """Unit vectors of hashed word counts; a slice's different words are hashed once each."""
    parts = []
    for part in grams.slices(words):
        coded = part.flatten().dictionary_encode()
        buckets = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % width for w in coded.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False))
        n = np.bincount(row * width + buckets[coded.indices.to_numpy(zero_copy_only=False)], minlength=len(part) * width).astype(np.float64).reshape(-1, width)
        norm = np.sqrt((n * n).sum(axis=1, keepdims=True))
        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
        parts.append(pa.ListArray.from_arrays(offsets, pa.array((n / np.where(norm > 0, norm, 1.0)).ravel())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))


def hashed(df: DataFrame, text: str, out: str = "vec", width: int = HASH_WIDTH) -> DataFrame:
    """Adds the unit vector of hashed word counts (functions.vectors.hash_bucket). Words are cut by the JVM and hashed in Arrow batches; nothing shuffles."""

    def made(x: pa.Array) -> pa.Array:
        return _hashed_rows(x, width)

    # So marked, no filter on the vector is pushed below it, where it would be evaluated a second time.
    return df.withColumn(out, F.arrow_udf(made, "array<double>").asNondeterministic()(words(F.col(text))))


def from_table(df: DataFrame, vectors: DataFrame, key: str, vec: str = "vec", out: str = "vec") -> DataFrame:
    """Adds precomputed vectors by key, normalised; rows without a vector keep null."""
    v = vectors.select(F.col(key), unit(F.col(vec)).alias(out))
    return df.join(v, key, "left")


Encoder = Callable[[list[str]], np.ndarray]


def encoded(df: DataFrame, text: str, make_encoder: Callable[[], Encoder], out: str = "vec", batch: int = 256) -> DataFrame:
    """Adds the unit vectors of a user encoder.

    `make_encoder` is called once per task, so a model is loaded once and not per batch.
    """
    at = df.columns.index(text)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                texts = [t or "" for t in part.column(at).to_pylist()]
                m = np.asarray(encode(texts), dtype=np.float64)
                norms = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(m), type=pa.list_(pa.float64()))], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)
