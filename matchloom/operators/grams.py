"""1-2 grams of batches of rows as numbers: words are coded once a slice, grams are pairs of codes, and only different grams become strings.

A batch is a list column of words (functions.tokens.words), worked on in slices of about SLICE_WORDS words, whole rows
at a time; stop words are dropped before pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions import tokens

#: Words that are worked on at once.
SLICE_WORDS = 500_000


class _Coded(NamedTuple):
    """The content words of some rows: row and code of each, and the word of each code."""

    row: np.ndarray
    code: np.ndarray
    names: pa.Array

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, code) of neighbours in a row."""
        same = self.row[1:] == self.row[:-1]
        return self.row[1:][same], self.code[:-1][same], self.code[1:][same]


def stop_array(stop_words: list[str] | None) -> pa.Array:
    return pa.array(V.ENGLISH_STOP_WORDS if stop_words is None else stop_words, pa.string())


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def slices(words: pa.Array) -> Iterator[pa.Array]:
    ends = np.concatenate([[0], np.cumsum(_lengths(words))])
    lo = 0
    while lo < len(words):
        hi = min(len(words), max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_WORDS, "right")) - 1))
        yield words.slice(lo, hi - lo)
        lo = hi


def _coded(words: pa.Array, stop: pa.Array) -> _Coded:
    flat = words.flatten().dictionary_encode()
    names, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(words)), _lengths(words))
    dropped = pc.index_in(names, stop.cast(names.type)).is_valid().to_numpy(zero_copy_only=False)
    if dropped.any():
        own = ~dropped[code]
        row, code = row[own], code[own]
    return _Coded(row, code, names)


def _strings(key: np.ndarray, names: pa.Array) -> pa.Array:
    """Grams of ascending keys: a word's key is its code, a pair's (first + 1) x words + second."""
    words = int(np.searchsorted(key, max(1, len(names))))
    single = names.take(pa.array(key[:words]))
    a, b = np.divmod(key[words:], max(1, len(names)))
    pairs = pc.binary_join_element_wise(names.take(pa.array(a - 1)), names.take(pa.array(b)), " ")
    return pa.concat_arrays([single.cast(pa.string()), pairs.cast(pa.string())])


def term_stats(docs: DataFrame, text: str, grams: bool = True, stop_words: list[str] | None = None, part: str | None = None) -> DataFrame:
    """(term, n, df): occurrences in the corpus and documents that have the term; each slice of rows is summed up before the shuffle.

    With `part`, a boolean column, also (n_part, df_part): the same of the documents where it is true.
    """
    stop = stop_array(stop_words)
    names = ["n", "df"] if part is None else ["n", "df", "n_part", "df_part"]

    def sums(words: pa.Array, own: np.ndarray | None) -> pa.RecordBatch | None:
        x, rows = _coded(words, stop), len(words)
        keys = x.code * rows + x.row
        if grams:
            row, a, b = x.pairs()
            keys = np.concatenate([keys, ((a + 1) * len(x.names) + b) * rows + row])
        entry, tf = np.unique(keys, return_counts=True)
        if not len(entry):
            return None
        key = entry // rows
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        made = [np.add.reduceat(tf, first), np.diff(np.append(first, len(key)))]
        if own is not None:
            there = own[entry % rows]
            made += [np.add.reduceat(tf * there, first), np.add.reduceat(there, first, dtype=np.int64)]
        return pa.RecordBatch.from_arrays([_strings(key[first], x.names), *map(pa.array, made)], ["term", *names])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = None if part is None else batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            lo = 0
            for words in slices(batch.column(0)):
                # What a slice was counted with is gone before its rows are handed over.
                made = sums(words, None if own is None else own[lo : lo + len(words)])
                lo += len(words)
                if made is not None:
                    yield made

    rows = docs.select(tokens.words(F.col(text)).alias("words"), *([] if part is None else [F.coalesce(part, F.lit(False))]))
    parts = rows.mapInArrow(summed, "term string, " + ", ".join(f"{c} bigint" for c in names))
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])


class Vocabulary:
    """Terms of a fixed list by their places in it."""

    def __init__(self, terms: list[str]):
        parts = [t.split(" ") for t in terms]
        known = sorted({w for p in parts for w in p})
        code = {w: i for i, w in enumerate(known)}
        self.size, self.known = len(terms), pa.array(known, pa.string())
        self.single = np.full(len(known) + 1, -1)  # the last for words that are in no term
        pairs = []
        for place, p in enumerate(parts):
            if len(p) == 1:
                self.single[code[p[0]]] = place
            else:
                pairs.append((code[p[0]] * len(known) + code[p[1]], place))
        pairs.sort()
        self.pair, self.place = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))

    def counts(self, words: pa.Array, stop: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) of the known terms of each row, sorted by both."""
        rows, terms, tfs = [], [], []
        at = 0
        for part in slices(words):
            x = _coded(part, stop)
            code = pc.fill_null(pc.index_in(x.names, self.known.cast(x.names.type)), len(self.known)).to_numpy(zero_copy_only=False).astype(np.int64)
            term = self.single[code[x.code]]
            entries = [x.row[term >= 0] * self.size + term[term >= 0]]
            if len(self.pair):
                row, a, b = x.pairs()
                a, b = code[a], code[b]
                there = (a < len(self.known)) & (b < len(self.known))
                row, pair = row[there], a[there] * len(self.known) + b[there]
                near = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
                hit = self.pair[near] == pair
                entries.append(row[hit] * self.size + self.place[near[hit]])
            entry, tf = np.unique(np.concatenate(entries), return_counts=True)
            row, term = np.divmod(entry, max(1, self.size))
            rows.append(row + at)
            terms.append(term)
            tfs.append(tf)
            at += len(part)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(terms), np.concatenate(tfs)

    def weights(self, words: pa.Array, stop: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, term, w): sublinear tf x idf at unit length; row i has the entries ends[i] to ends[i + 1]."""
        row, term, tf = self.counts(words, stop)
        w = (1.0 + np.log(tf)) * idf[term]
        norm = np.sqrt(np.bincount(row, w * w, len(words)))
        w /= norm[row]
        return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))]), term, w
