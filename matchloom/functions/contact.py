"""Contact details: first match plus the text with every match taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as V


# The fixed e-mail pattern without recursion and without a second try inside a run that has failed: the local part is
# possessive, since no shorter one can be followed by an @, and a match starts where a run starts, or where the match
# before ended. A domain has 255 labels at most; names can not be longer.
_CLASS = rf"[{V.WORD}-]"
EMAIL_LINEAR = (
    rf"(?i)(?:\G|(?<=\G\.)|(?<!{_CLASS})(?<!{_CLASS}\.)){_CLASS}++(?:\.{_CLASS}++)*+@"
    rf"(?:{_CLASS}+\.){{0,255}}[{V.WORD}]{_CLASS}{{0,66}}\.[a-z]{{2,6}}(?:\.[a-z]{{2}})?"
)


def match_and_remove(s: Column, pattern: str, group: int = 0) -> tuple[Column, Column]:
    """(first match or '', text without any match)."""
    return F.regexp_extract(s, pattern, group), F.regexp_replace(s, pattern, "")


def email(s: Column) -> tuple[Column, Column]:
    # No address can match without an @, and the cheap test spares every other text the slow pattern.
    has_at = F.contains(s, F.lit("@"))
    first, rest = match_and_remove(s, EMAIL_LINEAR)
    return F.when(has_at, first).otherwise(F.lit("")), F.when(has_at, rest).otherwise(s)


def phone(s: Column) -> tuple[Column, Column]:
    return match_and_remove(s, V.PHONE)


def gpa(s: Column) -> tuple[Column, Column]:
    return match_and_remove(s, V.GPA, 1)


def linkedin(s: Column) -> tuple[Column, Column]:
    return match_and_remove(s, V.LINKEDIN)


def github(s: Column) -> tuple[Column, Column]:
    return match_and_remove(s, V.GITHUB)


def url(s: Column) -> tuple[Column, Column]:
    return match_and_remove(s, V.URL)


# The order is part of the rule: each step sees only what the earlier ones left.
DETAIL_STEPS = [("gpa", gpa), ("email", email), ("phone", phone), ("linkedin", linkedin)]


def with_details(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `details` (struct of gpa, email, phone, linkedin) and `rest` (the left-over text)."""
    rest = F.col(text)
    out = df
    for i, (name, step) in enumerate(DETAIL_STEPS):
        found, left = step(rest)
        # One projection per step, so that the text left over is computed once and not once per use.
        out = out.withColumns({f"_{name}": found, f"_rest{i}": left})
        rest = F.col(f"_rest{i}")
    details = F.struct(*[F.col(f"_{name}").alias(name) for name, _ in DETAIL_STEPS])
    made = [f"_{name}" for name, _ in DETAIL_STEPS] + [f"_rest{i}" for i in range(len(DETAIL_STEPS))]
    return out.withColumns({"details": details, "rest": rest}).drop(*made)
