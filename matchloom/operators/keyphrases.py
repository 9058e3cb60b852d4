"""Unsupervised key phrases of single documents, by the published YAKE features (Campos et al., 2020).

Every document is its own corpus, and a document is a row: its words are cut out by one expression, its features and
candidates are computed in Arrow batches, array by array for all documents of a batch, and of the candidates only those
are spelled out that the best ones are picked from. Nothing is shuffled. Lower scores are better.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as V

MAX_WORDS = 3
TOP = 20
DEDUP_LIMIT = 0.9
#: Scores are compared at so many places.
DECIMALS = 9
MIN_TERM_CHARS = 3

SENTENCE_END = rf"[.!?]+[{V.SPACE}]+|\n+"
BLOCK_END = rf"[^{V.WORD}{V.SPACE}]+"
WORD = rf"[{V.WORD}]+"
# Words with a digit are neither linked nor part of a phrase. _spelling() tells these three apart.
HAS_DIGIT = r"\p{N}"
ACRONYM = r"^\p{Lu}+$"
CAPITAL = r"^\p{Lu}"

#: Words that are worked on at once, whole documents at a time.
SLICE_WORDS = 100_000
_PLAIN, _CAPITAL, _ACRONYM = 0, 1, 2


def _tokens(text: Column) -> Column:
    """Words in their order; between them ends of sentences as they stand, and an empty string for any other end of a run of words."""
    pattern = rf"({WORD}|{SENTENCE_END})|[^{V.WORD}{V.SPACE}]"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def _spelling(word: str) -> tuple[str | None, int]:
    """A word in lower case, None if it has a digit, and its shape by HAS_DIGIT, ACRONYM and CAPITAL."""
    if word.isalpha() and (word.islower() or word.isascii()):
        return word.lower(), _PLAIN if word[0].islower() or word.islower() else _ACRONYM if word.isupper() else _CAPITAL
    kinds = [unicodedata.category(c) for c in word]
    shape = _ACRONYM if kinds.count("Lu") == len(kinds) else _CAPITAL if kinds[0] == "Lu" else _PLAIN
    return None if any(k[0] == "N" for k in kinds) else word.lower(), shape


class _Words(NamedTuple):
    """The words of some documents, one entry each: document, sentence in it, run of words without punctuation, whether it opens its
    sentence, term (-1: none), shape."""

    doc: np.ndarray
    sentence: np.ndarray
    run: np.ndarray
    opens: np.ndarray
    term: np.ndarray
    shape: np.ndarray
    sentences: np.ndarray  # of each document
    terms: pa.Array
    stop: np.ndarray  # of each term


class _Terms(NamedTuple):
    """The terms of each document: document, term, occurrences, whether it is a stop word, score; at[w] is the entry of word w, -1 without a term."""

    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    stop: np.ndarray
    score: np.ndarray
    at: np.ndarray


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def _words(docs: pa.Array, stop_words: frozenset[str]) -> _Words:
    coded = docs.flatten().dictionary_encode()
    raw, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(raw)
    word_at, sentence_at, term_at, shape_at = [False] * n, [False] * n, [-1] * n, [_PLAIN] * n
    ids: dict[str, int] = {}
    for i, word in enumerate(raw):
        if not word:
            continue
        if word[0] in ".!?\n":
            sentence_at[i] = True
            continue
        name, shape_at[i] = _spelling(word)
        word_at[i] = True
        if name is not None:
            term_at[i] = ids.setdefault(name, len(ids))
    is_word, ends_sentence, term, shape = np.array(word_at, bool), np.array(sentence_at, bool), np.array(term_at, np.int64), np.array(shape_at, np.int8)

    at = np.flatnonzero(is_word[code])
    doc = np.repeat(np.arange(len(docs)), _lengths(docs))[at]

    def counted(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are the first after such an end or of their document, and the number of each word's stretch."""
        before = np.cumsum(ends[code])[at]
        first = np.ones(len(at), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (before[1:] != before[:-1])
        return first, np.cumsum(first) - 1

    opens, sentence = counted(ends_sentence)
    run = counted(~is_word)[1]
    sentences = np.bincount(doc[opens], minlength=len(docs))
    names = list(ids)
    return _Words(
        doc, sentence - (np.cumsum(sentences) - sentences)[doc], run, opens, term[code[at]], shape[code[at]],
        sentences, pa.array(names, pa.string()), np.array([n in stop_words or len(n) < MIN_TERM_CHARS for n in names], bool))


def _neighbours(x: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the words before and after each word in its run, -1 where there is none."""
    same = x.run[1:] == x.run[:-1]
    left, right = np.full(len(x.term), -1), np.full(len(x.term), -1)
    left[1:][same], right[:-1][same] = x.term[:-1][same], x.term[1:][same]
    return left, right


def _features(x: _Words) -> _Terms:
    width = max(1, len(x.terms))
    valid = x.term >= 0
    left, right = (n[valid] for n in _neighbours(x))
    unit, u = np.unique(x.doc[valid] * width + x.term[valid], return_inverse=True)
    n = len(unit)
    doc, term = np.divmod(unit, width)
    count = lambda flags: np.bincount(u[flags], minlength=n)
    tf = np.bincount(u, minlength=n).astype(np.float64)
    cased = np.maximum(count(x.shape[valid] == _ACRONYM), count((x.shape[valid] == _CAPITAL) & ~x.opens[valid]))

    def spread(other: np.ndarray) -> np.ndarray:
        there = other >= 0
        different = np.bincount(np.unique(u[there] * width + other[there]) // width, minlength=n)
        return different / np.maximum(1, count(there))

    longest = int(x.sentence.max(initial=0)) + 1
    held, place = np.divmod(np.unique(u * longest + x.sentence[valid]), longest)
    in_sentences = np.bincount(held, minlength=n)
    first = np.cumsum(in_sentences) - in_sentences
    middle = (place[first + (in_sentences - 1) // 2] + place[first + in_sentences // 2]) / 2 if n else np.zeros(0)

    stop = x.stop[term] if n else np.zeros(0, bool)
    docs = len(x.sentences)
    most = np.zeros(docs)
    np.maximum.at(most, doc, tf)
    content = np.maximum(1, np.bincount(doc[~stop], minlength=docs))
    mean = np.bincount(doc[~stop], tf[~stop], docs) / content
    deviation = np.sqrt(np.bincount(doc[~stop], (tf[~stop] - mean[doc[~stop]]) ** 2, docs) / content)

    rel = 1 + (spread(left) + spread(right)) * tf / most[doc]
    case = cased / (1 + np.log(tf))
    # A document of stop words alone has no mean; its scores are not used.
    with np.errstate(divide="ignore"):
        freq = tf / (mean + deviation)[doc]
    share = in_sentences / x.sentences[doc]
    score = rel * np.log(np.log(3 + middle)) / (case + freq / rel + share / rel)
    at = np.full(len(x.term), -1)
    at[valid] = u
    return _Terms(doc, term, tf, stop, score, at)


class _Found(NamedTuple):
    """Candidate phrases of some documents, one entry each: document, score, first word and number of words of an occurrence."""

    doc: np.ndarray
    score: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _phrases(x: _Words, t: _Terms, max_words: int) -> _Found:
    """Every candidate; its score is the product of its word scores / (occurrences x (1 + their sum)).

    Candidates are runs of up to `max_words` words that neither begin nor end with a stop word. A stop word inside has
    no score; it counts by how firmly it is tied to its neighbours.
    """
    n, width = len(x.term), len(x.terms) + 1
    right = _neighbours(x)[1]
    at = t.at
    _, pair, ties = np.unique(at * width + right + 1, return_inverse=True, return_counts=True)
    links = ties[pair].astype(np.float64)
    valid = at >= 0
    stop, score, tf = (np.where(valid, v[at], fill) if len(v) else np.full(n, fill) for v, fill in ((t.stop, True), (t.score, 0.0), (t.tf, 1.0)))
    before, after = np.concatenate([[0], np.arange(n - 1)])[:n], np.minimum(np.arange(n) + 1, max(n - 1, 0))
    loose = 1 - (links[before] / tf[before]) * (links / tf[after])
    factor, addend = np.where(stop, 1 + loose, score), np.where(stop, -loose, score)
    found = [_Found(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    start = np.flatnonzero(valid)
    key, p, s = at[start], np.ones(len(start)), np.zeros(len(start))
    for size in range(1, max_words + 1):
        last = start + size - 1
        if size > 1:
            inside = last < n
            start, key, p, s, last = (v[inside] for v in (start, key, p, s, last))
            goes_on = (x.run[last] == x.run[start]) & valid[last]
            start, key, p, s, last = (v[goes_on] for v in (start, key, p, s, last))
            if size > 2:
                p, s = p * factor[last - 1], s + addend[last - 1]
            key = np.unique(key * width + x.term[last] + 1, return_inverse=True)[1]
        own = ~stop[start] & ~stop[last]
        if own.any():
            _, first, kf = np.unique(key[own], return_index=True, return_counts=True)
            a, b = start[own][first], last[own][first]
            # p and s are those of the words between the first and the last.
            product = p[own][first] * score[a] * (score[b] if size > 1 else 1.0)
            total = s[own][first] + score[a] + (score[b] if size > 1 else 0.0)
            found.append(_Found(x.doc[a], product / (kf * (1 + total)), a, np.full(len(a), size)))
    return _Found(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _spelled(x: _Words, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The phrases of so many words from these on."""
    order = np.argsort(size, kind="stable")
    parts = [pa.array([], pa.string())]
    for n in np.unique(size).tolist():
        words = [x.terms.take(pa.array(x.term[start[order][size[order] == n] + j])) for j in range(n)]
        parts.append(pc.binary_join_element_wise(*words, " ") if n > 1 else words[0])
    return pa.concat_arrays(parts).take(pa.array(np.argsort(order)))


def _rounded(score: np.ndarray) -> np.ndarray:
    """Spark's round(score, DECIMALS), which rounds the shortest decimal that names the number, halves away from zero."""
    unit = 10.0**DECIMALS
    with np.errstate(invalid="ignore", over="ignore"):
        y = score * unit
        out = np.floor(y + 0.5) / unit
        unsure = np.isfinite(score) & ((np.abs(y - np.floor(y) - 0.5) < 1e-3) | (np.abs(y) > 1e10))
    for i in np.flatnonzero(unsure).tolist():
        named = Decimal(repr(float(score[i])))
        if named.as_tuple().exponent < -DECIMALS:
            named = named.quantize(Decimal(1).scaleb(-DECIMALS), ROUND_HALF_UP)
        out[i] = float(named) + 0.0
    return out


def _within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of two strings is `edits` at most."""
    if edits < 0 or abs(len(a) - len(b)) > edits:
        return False
    piece = len(a) // (edits + 1)
    # Of edits + 1 pieces, one at least stays as it is.
    if piece and not any(a[i * piece : (i + 1) * piece] in b for i in range(edits + 1)):
        return False
    above = list(range(len(b) + 1))
    far = edits + 1
    for i, c in enumerate(a, 1):
        lo, hi = max(1, i - edits), min(len(b), i + edits)
        row = [far] * (len(b) + 1)
        row[0] = min(i, far)
        for j in range(lo, hi + 1):
            row[j] = min(above[j - 1] + (c != b[j - 1]), above[j] + 1, row[j - 1] + 1)
        if min(row[lo - 1 : hi + 1]) > edits:
            return False
        above = row
    return above[-1] <= edits


def _edits(limit: float) -> Callable[[int], int]:
    """The greatest edit distance at which phrases, the longer one of so many letters, are alike; -1 if at none."""

    @cache
    def most(longest: int) -> int:
        m = min(longest, max(0, int((1 - limit) * longest) + 2))
        while m >= 0 and not 1 - m / longest > limit:
            m -= 1
        return m

    return most


def _best(x: _Words, found: _Found, docs: int, k: int, limit: float) -> tuple[list[int], list[float], list[str]]:
    """(document, score, phrase) of each document's k best candidates, best first, skipping near spellings of better ones.

    Candidates are ordered by their rounded scores and spelled out as far as it takes to find k, to the last one if need be.
    """
    score, most = _rounded(found.score), _edits(limit)
    order = np.lexsort((score, found.doc))
    doc, score, start, size = (v[order] for v in (found.doc, score, found.start, found.size))
    same = (doc[1:] == doc[:-1]) & ((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1])))
    last = np.append(np.flatnonzero(~same), len(doc) - 1) if len(doc) else np.zeros(0, np.int64)  # of each tie
    tie = np.concatenate([[0], np.cumsum(~same)])[: len(doc)]
    ends = np.cumsum(np.bincount(doc, minlength=docs))
    lo = np.concatenate([[0], ends[:-1]])[:docs]
    kept: list[list[tuple[float, str]]] = [[] for _ in range(docs)]
    open_ = np.flatnonzero(lo < ends)
    while len(open_):
        # Phrases of one score are ordered by their spelling, so a tie is never parted.
        hi = last[tie[np.minimum(lo[open_] + k + k // 2, ends[open_] - 1)]] + 1
        lengths = hi - lo[open_]
        first = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(lo[open_] - first, lengths)
        rows = list(zip(tie[at].tolist(), _spelled(x, start[at], size[at]).to_pylist(), score[at].tolist(), strict=True))
        for d, a, n in zip(open_.tolist(), first.tolist(), lengths.tolist(), strict=True):
            own = kept[d]
            for _, phrase, s in sorted(rows[a : a + n], key=lambda r: r[:2]):
                if len(own) >= k:
                    break
                length = len(phrase)
                for _, other in own:
                    edits = most(max(length, len(other)))
                    if abs(length - len(other)) <= edits and _within(phrase, other, edits):
                        break
                else:
                    own.append((s, phrase))
        lo[open_] = hi
        open_ = np.array([d for d in open_.tolist() if len(kept[d]) < k and lo[d] < ends[d]], np.int64)
    flat = [(d, s, phrase) for d, own in enumerate(kept) for s, phrase in own]
    return [r[0] for r in flat], [r[1] for r in flat], [r[2] for r in flat]


def _as_lists(docs: np.ndarray, n: int, columns: dict[str, pa.Array]) -> pa.Array:
    order = pa.array(np.argsort(docs, kind="stable"))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([c.take(order) for c in columns.values()], list(columns)))


def _ends(lists: pa.Array) -> np.ndarray:
    """The entries, however deep, up to each list."""
    ends = np.concatenate([[0], np.cumsum(_lengths(lists))])
    return _ends(lists.flatten())[ends] if pa.types.is_list(lists.type.value_type) else ends


def _by_slices(docs: pa.Array, work) -> pa.Array:
    """work(documents) over ranges of documents of about SLICE_WORDS words and ends of runs."""
    ends = _ends(docs)
    parts, lo = [], 0
    while lo < len(docs):
        hi = min(len(docs), max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_WORDS, "right")) - 1))
        parts.append(work(docs.slice(lo, hi - lo)))
        lo = hi
    return pa.concat_arrays(parts) if parts else work(docs)


def _stop_set(stop_words: list[str] | None) -> frozenset[str]:
    return frozenset(V.ENGLISH_STOP_WORDS if stop_words is None else stop_words)


def terms_of(text: Column, stop_words: list[str] | None = None) -> Column:
    """array<struct<term, score>>: every term of the text that is not a stop word, with its score."""
    stop = _stop_set(stop_words)

    def work(docs: pa.Array) -> pa.Array:
        x = _words(docs, stop)
        t = _features(x)
        own = np.flatnonzero(~t.stop)
        return _as_lists(t.doc[own], len(docs), {"term": x.terms.take(pa.array(t.term[own])), "score": pa.array(t.score[own])})

    def run(docs: pa.Array) -> pa.Array:
        return _by_slices(docs, work)

    return F.arrow_udf(run, "array<struct<term:string,score:double>>")(_tokens(text))


def candidates(text: Column, max_words: int = MAX_WORDS, stop_words: list[str] | None = None) -> Column:
    """array<struct<score, phrase>>: every candidate phrase of the text."""
    stop = _stop_set(stop_words)

    def work(docs: pa.Array) -> pa.Array:
        x = _words(docs, stop)
        found = _phrases(x, _features(x), max_words)
        return _as_lists(found.doc, len(docs), {"score": pa.array(found.score), "phrase": _spelled(x, found.start, found.size)})

    def run(docs: pa.Array) -> pa.Array:
        return _by_slices(docs, work)

    return F.arrow_udf(run, "array<struct<score:double,phrase:string>>")(_tokens(text))


def best_phrases(text: Column, k: int = TOP, limit: float = DEDUP_LIMIT, max_words: int = MAX_WORDS, stop_words: list[str] | None = None) -> Column:
    """array<struct<score, phrase>>: the k best of candidates(), best first, skipping near spellings of better ones."""
    stop = _stop_set(stop_words)

    def work(docs: pa.Array) -> pa.Array:
        x = _words(docs, stop)
        doc, score, phrase = _best(x, _phrases(x, _features(x), max_words), len(docs), k, limit)
        return _as_lists(np.array(doc, np.int64), len(docs), {"score": pa.array(score, pa.float64()), "phrase": pa.array(phrase, pa.string())})

    def run(docs: pa.Array) -> pa.Array:
        return _by_slices(docs, work)

    return F.arrow_udf(run, "array<struct<score:double,phrase:string>>")(_tokens(text))


def term_scores(docs: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """(key, term, score) of every term that is not a stop word."""
    return docs.select(key, F.inline(terms_of(F.col(text), stop_words)))


def key_phrases(docs: DataFrame, key: str, text: str, k: int = TOP, limit: float = DEDUP_LIMIT, max_words: int = MAX_WORDS, stop_words: list[str] | None = None) -> DataFrame:
    """(key, rank, phrase, score): the k best phrases of each document."""
    kept = docs.select(key, F.posexplode(best_phrases(F.col(text), k, limit, max_words, stop_words)).alias("at", "_k"))
    return kept.select(key, (F.col("at") + 1).alias("rank"), "_k.phrase", "_k.score")
