"""Word tokens and 1-2 grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions.text import let

TOKEN = rf"[{V.WORD}]{{2,}}"


def words(text: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def content_words(text: Column, stop_words: list[str] | None = None) -> Column:
    stop = V.ENGLISH_STOP_WORDS if stop_words is None else stop_words
    # array_except would drop repeats as well, so the words are filtered one by one.
    return F.filter(words(text), lambda w: ~w.isin(*stop)) if stop else words(text)


def one_two_grams(tokens: Column) -> Column:
    """Tokens followed by pairs of neighbours; stop words are gone before pairs are formed."""

    def grams(ts: Column) -> Column:
        right = F.slice(ts, 2, F.greatest(F.size(ts), F.lit(1)))
        left = F.slice(ts, 1, F.greatest(F.size(ts) - 1, F.lit(0)))
        return F.concat(ts, F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b)))

    return let(tokens, grams)


def counted(terms: Column) -> Column:
    """array<struct<term, tf>>: each term of the array once, in order, with how often it occurs. Linear after one sort."""

    def runs(ts: Column) -> Column:
        n = F.size(ts)
        starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(ts, i) != F.get(ts, i - 1)))
        return let(starts, lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda lo, j: F.struct(
            F.get(ts, lo).alias("term"), (F.get(at, j + 1) - lo).cast("bigint").alias("tf"))))

    return let(F.sort_array(terms), lambda ts: F.when(F.size(ts) > 0, runs(ts)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>")))
