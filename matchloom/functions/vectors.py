"""Vector columns: ARRAY<DOUBLE> in, ARRAY<DOUBLE> or DOUBLE out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.text import let
from matchloom.functions.tokens import words

HASH_WIDTH = 384


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v / |v|; a zero vector stays zero."""
    return let(l2_norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, which is their inner product."""
    return dot(a, b)


def hash_bucket(word: Column, width: int = HASH_WIDTH) -> Column:
    """Bucket of a word: first 32 bits of its md5, modulo the width."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % width


def bucket_words(text: Column, width: int = HASH_WIDTH) -> Column:
    """Bucket number of every word of the text, as strings, ready for a fixed-vocabulary counter."""
    return F.transform(words(text), lambda w: hash_bucket(w, width).cast("string"))
