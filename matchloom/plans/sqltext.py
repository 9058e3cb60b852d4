"""Pieces of oracle SQL that several queries share (DuckDB dialect)."""

from __future__ import annotations

from matchloom import fixed_values as V
from matchloom.functions.tokens import TOKEN


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub_all(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"


def trim_u(x: str) -> str:
    return sub_all(x, rf"^[{V.SPACE}]+|[{V.SPACE}]+$", "")


def squeeze(x: str) -> str:
    return f"trim({sub_all(x, rf'[{V.SPACE}]+', ' ')})"


def clean(x: str) -> str:
    links_gone = sub_all(f"lower({x})", rf"http[s]?://[^{V.SPACE}]+", " ")
    return squeeze(sub_all(links_gone, rf"[^{V.WORD}{V.SPACE}]", " "))


def transform(x: str) -> str:
    links_gone = sub_all(f"lower({x})", rf"http[^{V.SPACE}]+", " ")
    return squeeze(sub_all(links_gone, r"[^\x00-\x7f]", " "))


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {quote(TOKEN)})"


def string_list(items) -> str:
    return "(" + ", ".join(quote(i) for i in items) + ")"


def stop_words() -> str:
    """The stop-word list inlined."""
    return string_list(V.ENGLISH_STOP_WORDS)
