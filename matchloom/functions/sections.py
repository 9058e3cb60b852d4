"""Sections of a document, computed inside the row: no window, no shuffle, usable on a stream.

Header lines are located first; the content of a section is the slice between its header and the next
one. That costs one pass over the lines whatever the number of sections.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions.text import is_blank, let, transform_text, trim_u


def section_title(line: Column) -> Column:
    """Title keyword when the line looks like a header, else ''."""
    words = F.filter(
        F.regexp_extract_all(F.lower(line), F.lit("[a-z]+"), F.lit(0)),
        lambda w: ~w.isin(*V.CONNECTORS),
    )

    def judge(ws: Column) -> Column:
        keyword = F.try_element_at(F.filter(ws, lambda w: w.isin(*V.SECTION_TITLES)), F.lit(1))
        return F.when(F.size(ws) <= V.MAX_TITLE_WORDS, keyword)

    return F.coalesce(let(words, judge), F.lit(""))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def segments(lines: Column) -> Column:
    """array<struct<section, at, lines>>: one entry per header line, in document order.

    `at` is the 1-based line number of the header; `lines` holds array<struct<pos, line>> of the
    non-empty lines up to the next header. Lines in front of the first header belong to nothing.
    """
    return let(lines, _segments)


def _segments(lines: Column) -> Column:
    titles = F.transform(lines, lambda l, i: F.struct((i + 1).alias("pos"), section_title(l).alias("section")))
    heads = F.filter(titles, lambda t: t["section"] != "")

    def bounded(hs: Column) -> Column:
        # A section ends where the next header stands; the last one ends behind the last line.
        after = F.transform(hs, lambda h, i: F.coalesce(F.get(hs, i + 1)["pos"], F.size(lines) + 1))
        return F.zip_with(hs, after, lambda h, e: F.struct(h["section"].alias("section"), h["pos"].alias("at"), e.alias("until")))

    def content(b: Column) -> Column:
        between = F.slice(lines, b["at"] + 1, b["until"] - b["at"] - 1)
        numbered = F.transform(between, lambda l, j: F.struct((b["at"] + 1 + j).alias("pos"), l.alias("line")))
        return F.struct(b["section"].alias("section"), b["at"].alias("at"), F.filter(numbered, lambda n: n["line"] != "").alias("lines"))

    return F.transform(let(heads, bounded), content)


def section_lines(segs: Column, name: Column) -> Column:
    """All content lines of one section, over all of its headers, in line order."""
    mine = F.filter(segs, lambda s: s["section"] == name)
    return F.flatten(F.transform(mine, lambda s: F.transform(s["lines"], lambda n: n["line"])))


def section_map(segs: Column) -> Column:
    """MAP<section, ARRAY<line>> over the sections that have content."""
    filled = F.filter(segs, lambda s: F.size(s["lines"]) > 0)
    names = F.array_distinct(F.transform(filled, lambda s: s["section"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, section_lines(segs, n))))


def relevant_text(text: Column, segs: Column, names: list[str]) -> Column:
    """Lines of the named sections in the order of `names`, or the whole text, made ready to encode."""
    parts = [F.array_join(section_lines(segs, F.lit(n)), " ") for n in names]
    joined = F.concat_ws(" ", *parts)
    return transform_text(let(joined, lambda j: F.when(is_blank(j), text).otherwise(trim_u(j))))
