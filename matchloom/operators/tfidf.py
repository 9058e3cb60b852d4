"""TF-IDF in long form: 1-2 grams, largest corpus counts, sublinear tf, smoothed idf, unit rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions import tokens
from matchloom.operators import grams
from matchloom.sources.tables import materialise

# The vocabulary is cut to `max_features` rows, so up to this many it is small enough to broadcast.
BROADCAST_TERMS = 200_000


def _grams(text: str, pairs: bool, stop_words: list[str] | None) -> Column:
    words = tokens.content_words(F.col(text), stop_words)
    return tokens.one_two_grams(words) if pairs else words


def term_counts(docs: DataFrame, key: str, text: str, grams: bool = True, stop_words: list[str] | None = None) -> DataFrame:
    """(key, term, tf). A document is one row, so its terms are counted inside the row and nothing is shuffled."""
    return docs.select(key, F.inline(tokens.counted(_grams(text, grams, stop_words))))


def term_stats(counts: DataFrame) -> DataFrame:
    """(term, n, df): occurrences in the corpus and documents that have the term."""
    return counts.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


def vocabulary(counts: DataFrame, max_features: int = V.MAX_FEATURES) -> DataFrame:
    """largest_terms() of term_counts()."""
    return largest_terms(term_stats(counts), max_features)


def largest_terms(stats: DataFrame, max_features: int = V.MAX_FEATURES) -> DataFrame:
    """(term, n, df) of the `max_features` terms with the largest corpus count; of equal ones the smaller term.

    A histogram of the counts gives the count at which the list ends: what lies above is taken without any order, and
    only the terms of exactly that count are ordered, over as many tasks as they need.
    """
    return stored_largest_terms(materialise(stats, "term_stats"), max_features)


def stored_largest_terms(stats: DataFrame, max_features: int = V.MAX_FEATURES) -> DataFrame:
    """largest_terms() of a stored table."""
    # One row a distinct count: 2^20 of them need a corpus of 2^39 terms.
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = stats.groupBy("n").agg(F.count(F.lit(1)).alias("terms")).withColumn("above", F.coalesce(F.sum("terms").over(above), F.lit(0)))
    edge = sizes.where((F.col("above") < max_features) & (F.col("above") + F.col("terms") >= max_features)).first()
    if edge is None:
        return stats
    wanted = max_features - edge["above"]
    ties = stats.where(F.col("n") == edge["n"])
    if wanted < edge["terms"]:
        ties = _first(ties, "term", wanted)
    return stats.where(F.col("n") > edge["n"]).unionByName(ties)


def _first(rows: DataFrame, by: str, wanted: int) -> DataFrame:
    """The `wanted` rows of smallest `by`: sorted by range, and cut where the sizes of the ranges add up to them."""
    placed = rows.repartitionByRange(by).sortWithinPartitions(by).select("*", F.monotonically_increasing_id().alias("_at"))
    placed = materialise(placed, "ranged")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(sizes, part == F.col("_part")).where(F.col("_before") + place < wanted).select(*rows.columns)


def idf(n_docs, df):
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((n_docs + 1.0) / (df + 1.0)) + 1.0


def weights(counts: DataFrame, vocab: DataFrame, n_docs, key: str, max_features: int = V.MAX_FEATURES) -> DataFrame:
    """(key, term, w) with unit length per document. `n_docs` is the size of the corpus behind `vocab`."""
    terms = vocab.select("term", idf(n_docs, F.col("df")).alias("_idf"))
    kept = counts.join(F.broadcast(terms) if max_features <= BROADCAST_TERMS else terms, "term")
    raw = kept.select(key, "term", ((F.log(F.col("tf").cast("double")) + 1.0) * F.col("_idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_w") / norm).alias("w"))


def row_weights(docs: DataFrame, key: str, text: str, vocab: DataFrame, n_docs: int, max_features: int = V.MAX_FEATURES, stop_words: list[str] | None = None) -> DataFrame:
    """weights() of the documents' own terms. A vocabulary of bounded size travels to the documents, and nothing is shuffled."""
    if max_features > BROADCAST_TERMS:
        return weights(term_counts(docs, key, text, stop_words=stop_words), vocab, F.lit(n_docs), key, max_features)
    listed = vocab.select("term", idf(F.lit(n_docs), F.col("df")).alias("idf")).orderBy("term").collect()
    terms = [r["term"] for r in listed]
    shared = docs.sparkSession.sparkContext.broadcast((grams.Vocabulary(terms), pa.array(terms, pa.string()), np.array([r["idf"] for r in listed], np.float64)))
    stop = grams.stop_array(stop_words)

    def weigh(words: pa.Array) -> pa.Array:
        known, names, idf_of = shared.value
        ends, term, w = known.weights(words, stop, idf_of)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([names.take(pa.array(term)), pa.array(w)], ["term", "w"]))

    made = F.arrow_udf(weigh, "array<struct<term:string,w:double>>")(tokens.words(F.col(text)))
    return docs.select(key, F.inline(made))


def fit_transform(docs: DataFrame, key: str, text: str, max_features: int = V.MAX_FEATURES, stop_words: list[str] | None = None) -> DataFrame:
    vocab = largest_terms(grams.term_stats(docs, text, stop_words=stop_words), max_features)
    return row_weights(docs, key, text, vocab, docs.count(), max_features, stop_words)


def cosine_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, score) over pairs that share a term; every other pair has cosine 0.

    Both inputs are long-form unit vectors. The join is on the term, and a term that a third of all
    documents have is split by AQE.
    """
    other = right.select(right_key, "term", F.col("w").alias("_w2"))
    met = left.join(other, "term")
    return met.groupBy(left_key, right_key).agg(F.sum(F.col("w") * F.col("_w2")).alias("score"))
