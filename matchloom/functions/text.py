"""Cleaning, facts and small formats: builders that take a string column and return a column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed_values as V

# The look-behind keeps a long run of white space inside the text from being tried at each of its characters.
_EDGES = rf"^[{V.SPACE}]+|(?<![{V.SPACE}])[{V.SPACE}]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, however often `body` uses it.

    Expressions inside lambdas get no common-subexpression elimination, so a costly one that is named
    twice would run twice.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_u(s: Column) -> Column:
    """Strip all Unicode white space from both ends (trim() only strips blanks)."""
    return F.regexp_replace(s, _EDGES, "")


def squeeze(s: Column) -> Column:
    """Runs of white space become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(s, rf"[{V.SPACE}]+", " "))


def is_blank(s: Column) -> Column:
    return F.coalesce(trim_u(s), F.lit("")) == ""


def guard_label(s: Column, label: Column) -> Column:
    """`label`, or 'Unknown' where the text is blank."""
    return F.when(is_blank(s), F.lit(V.UNKNOWN_CATEGORY)).otherwise(label)


def clean_text(s: Column) -> Column:
    """Lower case, no web links, only word characters and single blanks. Null counts as empty."""
    t = F.lower(F.coalesce(s, F.lit("")))
    t = F.regexp_replace(t, rf"https?://[^{V.SPACE}]+", " ")
    t = F.regexp_replace(t, rf"[^{V.WORD}{V.SPACE}]", " ")
    return squeeze(t)


def transform_text(s: Column) -> Column:
    """Encoder input: lower case, nothing that starts with http, ASCII only, single blanks."""
    t = F.lower(F.coalesce(s, F.lit("")))
    t = F.regexp_replace(t, rf"http[^{V.SPACE}]+", " ")
    t = F.regexp_replace(t, r"[^\x00-\x7f]", " ")
    return squeeze(t)


def space_ratio(s: Column) -> Column:
    """Share of U+0020 among the characters; 0 for empty text."""
    n = F.length(s)
    blanks = n - F.length(F.replace(s, F.lit(" "), F.lit("")))
    return F.when(n > 0, blanks / n).otherwise(F.lit(0.0))


def years_experience(s: Column) -> Column:
    """First match of the first pattern that matches at all; null when none does."""

    def find(low: Column) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in V.YEARS_PATTERNS])

    return let(F.lower(s), find).try_cast("bigint")


def education_level(s: Column) -> Column:
    """Highest level one of whose keywords occurs anywhere in the text, even inside a word."""

    def find(low: Column) -> Column:
        level = F.lit(None).cast("string")
        for name, words in reversed(V.EDUCATION_LEVELS.items()):
            hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
            level = F.when(hit, F.lit(name)).otherwise(level)
        return level

    return let(F.lower(s), find)


def format_phone(s: Column) -> Column:
    """(AAA) BBB-CCCC for ten digits, with +1 in front for eleven that begin with 1, else unchanged."""
    d = F.regexp_replace(s, r"[^0-9]", "")

    def pretty(start: int) -> Column:
        return F.concat(
            F.lit("("), F.substring(d, start, 3), F.lit(") "),
            F.substring(d, start + 3, 3), F.lit("-"), F.substring(d, start + 6, 4),
        )

    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit(""))
        .when(F.length(d) == 10, pretty(1))
        .when((F.length(d) == 11) & F.startswith(d, F.lit("1")), F.concat(F.lit("+1 "), pretty(2)))
        .otherwise(s)
    )


def file_extension(path: Column) -> Column:
    """Lower-case text after the last dot of the last path part; leading dots do not count."""
    return F.lower(F.regexp_extract(path, r"(?:^|/)\.*[^./][^/]*\.([^./]*)$", 1))


def document_name(path: Column) -> Column:
    """Last path part with every '.pdf' removed."""
    return F.replace(F.substring_index(path, "/", -1), F.lit(".pdf"), F.lit(""))


def is_web_url(url: Column) -> Column:
    return F.rlike(trim_u(url), F.lit(V.URL_SCHEME))


def is_pdf_source(source: Column) -> Column:
    """Case-sensitive: only a trailing '.pdf' names a file, anything else is the text itself."""
    return F.endswith(source, F.lit(".pdf"))


def too_short(text: Column) -> Column:
    return F.length(text) < V.MIN_POSTING_CHARS


def truncate(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def percent(prob: Column, decimals: int = 1) -> Column:
    return F.round(prob * 100, decimals)


def fingerprint(path: Column, size: Column) -> Column:
    """File identity: name and size."""
    return F.concat(path, F.lit(":"), size.cast("string"))
