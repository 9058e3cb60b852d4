"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.tables import unused

#: Length of a hypervector.
WIDTH = 1024
#: Characters that are worked on at once in a task.
SLICE_CHARS = 1 << 18
#: Entries of the texts by trigrams matrix of a slice, at most: many short texts make a wide one.
SLICE_CELLS = 1 << 24
#: Languages whose profiles fit the driver with ease (8 KB each).
MOST_LANGUAGES = 10_000

_BIT = np.uint64(21)
_LETTER = np.uint64((1 << 21) - 1)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(200_000)
def _letter_vector(code: int) -> np.ndarray:
    """A random vector of -1 and 1 that the code point alone decides; 0 stands for the gap between words."""
    return (np.random.default_rng([11, code]).integers(0, 2, WIDTH, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of the lower-cased text, gaps included, and how often each occurs. None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
    if len(codes) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(codes[:-2] << (_BIT + _BIT) | codes[1:-1] << _BIT | codes[2:], return_counts=True)


def bound(grams: np.ndarray) -> np.ndarray:
    """(grams, WIDTH): the first letter's vector permuted twice, the second's once, the third's as it is, bound by multiplication."""
    letters, at = np.unique(np.stack([grams >> (_BIT + _BIT), grams >> _BIT & _LETTER, grams & _LETTER]), return_inverse=True)
    table = np.stack([_letter_vector(int(c)) for c in letters])
    first, second, third = at.reshape(3, -1)
    return (np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]).astype(np.float32)


def _slices(texts: list[str | None]) -> Iterator[range]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= SLICE_CHARS or total * (i + 1 - start) >= SLICE_CELLS:
            yield range(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def _weighted(texts: list[str | None], group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundles of the texts by group: sums of bound trigrams, each text with weight one in all. group < 0: left out."""
    counted = [trigrams(t) if t and g >= 0 else None for t, g in zip(texts, group, strict=True)]
    rows = [i for i, c in enumerate(counted) if c is not None and len(c[0])]
    if not rows:
        return np.zeros((groups, WIDTH)), np.zeros(groups, bool)
    grams, at = np.unique(np.concatenate([counted[i][0] for i in rows]), return_inverse=True)
    weight = np.concatenate([counted[i][1] / counted[i][1].sum() for i in rows])
    owner = np.repeat([group[i] for i in rows], [len(counted[i][0]) for i in rows])
    shares = np.bincount(owner * len(grams) + at, weight, groups * len(grams)).reshape(groups, -1)
    out = np.zeros((groups, WIDTH))
    for lo in range(0, len(grams), 4096):
        out += shares[:, lo : lo + 4096].astype(np.float32) @ bound(grams[lo : lo + 4096])
    return out, np.bincount(owner, minlength=groups) > 0


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names = sorted(set(langs))
        of = {x: i for i, x in enumerate(names)}
        for part in _slices(texts):
            bundle, any_ = _weighted([texts[i] for i in part], np.array([of[langs[i]] for i in part]), len(names))
            for i in np.flatnonzero(any_):
                sums[names[i]] = sums.get(names[i], 0) + bundle[i]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """labelled(text, lang) -> languages and their unit prototype vectors, from all rows with a language and a letter.

    Each task bundles its own texts; Spark sums a row per task and language. Null languages and texts teach nothing; no rows, no languages.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(_profiles, "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(whole) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # Rounding keeps the order of summation, which differs between runs, out of the predictions.
    vectors = np.array([[e["x"] for e in r["v"]] for r in whole]).reshape(-1, WIDTH).round(6)
    return [r["lang"] for r in whole], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)


def predict(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of the nearest prototype by cosine, and the cosine, not below 0. `und` and 0 without a letter or a prototype."""
    best, score = ["und"] * len(texts), np.zeros(len(texts))
    for part in _slices(texts) if langs else ():
        bundles, any_ = _weighted([texts[i] for i in part], np.arange(len(part)), len(part))
        cosine = bundles @ prototypes.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-30)
        at = cosine.argmax(axis=1)
        for k in np.flatnonzero(any_):
            best[part[k]] = langs[at[k]]
            score[part[k]] = min(max(float(cosine[k, at[k]]), 0.0), 1.0)
    return best, score


def identify(spark, text: Column, langs: list[str], prototypes: np.ndarray) -> Column:
    """Struct column (lang, score) of a text column; no shuffle, the prototypes are broadcast."""
    shared = spark.sparkContext.broadcast((langs, prototypes))

    @F.pandas_udf("lang string, score double")
    def run(column: pd.Series) -> pd.DataFrame:
        names, score = predict([None if x is None or x != x else x for x in column], *shared.value)
        return pd.DataFrame({"lang": names, "score": score})

    # Called nondeterministic, it is not written out, and run, once for each use of its result.
    return run.asNondeterministic()(text.cast("string"))


def held_out(key: Column) -> Column:
    """Documents that teach nothing: a fifth, by crc32 of the id as text. A null id is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def languages(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> (doc_id, held_out, lang_pred, score), one row per row.

    Prototypes are learned from text and lang of the rows that are not held out; a prediction reads the text alone.
    Null, empty or letterless text: `und`, 0. Without any labelled text all is `und`. Ties go to the language first in order.
    """
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(docs.sparkSession, F.col("text"), *model).alias("told"))
    return told.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told, with that language as `lang`, whatever it was before.

    A text without a letter, or whose nearest prototype has a cosine of 0 or less, is rejected: it goes. Other columns, whatever their names, stay as they are.
    """
    model, own = learn(docs.where(~held_out(F.col("doc_id")))), unused(docs, "_told")
    told = docs.withColumn(own, identify(docs.sparkSession, F.col("text"), *model))
    told = told.where((F.col(f"{own}.lang") != "und") & (F.col(f"{own}.score") > 0))
    return told.withColumn("lang", F.col(f"{own}.lang")).select(docs.columns)
