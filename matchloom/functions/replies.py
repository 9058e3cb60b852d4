"""Reading a scored reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions.text import trim_u

# (?d): only \n ends a line. The lazy head makes the replacement hit the first such line only.
_SCORE_LINE = r"(?d)\A((?s:.*?))(?m:^.*" + V.SCORE.replace("(", "(?:") + r".*$)\n?"


def reply_score(raw: Column) -> Column:
    """First score in the reply, clamped to 0..100; null when there is none."""
    digits = F.regexp_extract(raw, V.SCORE, 1)
    return F.when(digits != "", F.least(F.lit(100), digits.cast("int")))


def reply_feedback(raw: Column) -> Column:
    """Reply without the first line that carries a score, stripped."""
    return trim_u(F.regexp_replace(raw, _SCORE_LINE, "$1"))


def score_band(score: Column) -> Column:
    band = F.lit(None).cast("string")
    for low, label in reversed(V.BANDS):
        band = F.lit(label) if low is None else F.when(score >= low, F.lit(label)).otherwise(band)
    return F.when(score.isNotNull(), band)
