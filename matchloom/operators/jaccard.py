"""Word-set Jaccard: of two columns, and of all pairs above a threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.text import clean_text, let
from matchloom.operators.pairwise import BLOCK_ROWS, dealt

# Most frequent words that get a place of their own in the word order; bounded, so it can be broadcast.
HOT_WORDS = 10_000
#: Below this threshold most pairs share a word of their prefixes: then the shared words of all pairs are counted in blocks.
PREFIX_FROM = 0.3
#: Words of a block whose places are held at once as a dense matrix.
COLUMNS = 1 << 13


def word_set(s: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(clean_text(s), " ")), "")


def set_jaccard(a: Column, b: Column) -> Column:
    """|a n b| / |a u b| of duplicate-free arrays; 0 when both are empty."""

    def ratio(both: Column) -> Column:
        union = F.size(a) + F.size(b) - both
        return F.when(union > 0, both / union).otherwise(F.lit(0.0))

    return let(F.size(F.array_intersect(a, b)), ratio)


def text_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the cleaned words of two texts; 0 when either text is empty or missing."""
    return F.coalesce(let(word_set(a), lambda x: let(word_set(b), lambda y: set_jaccard(x, y))), F.lit(0.0))


def similar_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float, text: str = "text") -> DataFrame:
    """(left_key, right_key, jaccard) for every pair with jaccard >= threshold (> 0), exactly.

    Below PREFIX_FROM the shared words of every pair are counted, a block of left and of right sets at a time, and the
    ratio follows from the sizes. From there on prefix filtering: with the words of each set in one global order, rarest first, two sets that reach
    the threshold share a word within the first |s| - ceil(t |s|) + 1 words of both. Only those words are
    joined, and only as (key, word) rows; the shared ones are counted per pair. What the count and the
    last shared places leave possible decides which pairs have their whole sets compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    a = left.select(F.col(left_key), word_set(F.col(text)).alias("_set")).where(F.size("_set") > 0)
    b = right.select(F.col(right_key), word_set(F.col(text)).alias("_set")).where(F.size("_set") > 0)

    if threshold < PREFIX_FROM:
        return _counted_pairs(a, b, left_key, right_key, threshold)

    # The order needs the frequent words alone, which is a bounded list; any order gives the same pairs.
    both = a.select(F.explode("_set").alias("word")).unionAll(b.select(F.explode("_set").alias("word")))
    hot = both.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(HOT_WORDS)

    def prefixed(df: DataFrame, key: str, side: str) -> DataFrame:
        rows = df.select(key, F.size("_set").alias("_n"), F.explode("_set").alias("word"))
        placed = rows.join(F.broadcast(hot), "word", "left")
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")))
        # The slack keeps a product like 0.2 * 5 from rounding up to the next integer.
        keep = F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9).cast("int") + 1
        sets = placed.groupBy(key, "_n").agg(ordered.alias("_o")).select(key, "_n", F.posexplode(F.slice("_o", 1, keep)).alias("_at", "_w"))
        return sets.select(key, F.col("_n").alias(f"_n{side}"), (F.col("_at") + 1).alias(f"_at{side}"), "_w.word")

    met = prefixed(a, left_key, "l").join(prefixed(b, right_key, "r"), "word")
    nl, nr = F.col("_nl"), F.col("_nr")
    met = met.where((nl >= nr * threshold - 1e-9) & (nr >= nl * threshold - 1e-9))
    pairs = met.groupBy(left_key, right_key, "_nl", "_nr").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_atl").alias("_atl"), F.max("_atr").alias("_atr")
    )
    # Every further shared word stands behind the last counted one in both sets.
    possible = F.col("_c") + F.least(nl - F.col("_atl"), nr - F.col("_atr"))
    pairs = pairs.where(possible * (1 + threshold) >= (nl + nr) * threshold - 1e-9).select(left_key, right_key)
    whole = pairs.join(a.withColumnRenamed("_set", "_l"), left_key)
    whole = whole.join(b.withColumnRenamed("_set", "_r"), right_key)
    scored = whole.select(left_key, right_key, set_jaccard(F.col("_l"), F.col("_r")).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold)


def _shared(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the left and of the right sets, and how many words each two share."""
    left, right = (pa.concat_arrays(c.chunks) for c in (left, right))
    sizes = [c.value_lengths().to_numpy().astype(np.int64) for c in (left, right)]
    coded = right.flatten().dictionary_encode()
    entries = []
    for codes, n in zip((pc.index_in(left.flatten(), coded.dictionary), coded.indices), sizes, strict=True):
        known = codes.is_valid().to_numpy(zero_copy_only=False)
        row, word = np.repeat(np.arange(len(n)), n)[known], codes.drop_null().to_numpy().astype(np.int64)
        order = np.argsort(word, kind="stable")
        entries.append((row[order], word[order]))
    both = np.zeros((len(left), len(right)))
    for lo in range(0, len(coded.dictionary), COLUMNS):
        parts = []
        for (row, word), n in zip(entries, sizes, strict=True):
            i, j = np.searchsorted(word, [lo, lo + COLUMNS])
            m = np.zeros((len(n), min(COLUMNS, len(coded.dictionary) - lo)), np.float32)
            m[row[i:j], word[i:j] - lo] = 1
            parts.append(m)
        both += parts[0] @ parts[1].T
    return *sizes, both


def _counted_pairs(a: DataFrame, b: DataFrame, left_key: str, right_key: str, threshold: float) -> DataFrame:
    schema = T.StructType([T.StructField(left_key, a.schema[left_key].dataType), T.StructField(right_key, b.schema[right_key].dataType), T.StructField("jaccard", T.DoubleType())])

    def cell(lt, rt):
        ids = [t.column(c).combine_chunks() for t, c in ((lt, left_key), (rt, right_key))]
        rows, cols, ratio = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if lt.num_rows and rt.num_rows:
            nl, nr, both = _shared(lt.column("_set"), rt.column("_set"))
            every = both / (nl[:, None] + nr - both)
            rows, cols = np.nonzero(every >= threshold)
            ratio = every[rows, cols]
        return pa.table({left_key: ids[0].take(pa.array(rows)), right_key: ids[1].take(pa.array(cols)), "jaccard": pa.array(ratio)})

    left, right = dealt(a, b, left_key, right_key, BLOCK_ROWS)
    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(cell, schema)
