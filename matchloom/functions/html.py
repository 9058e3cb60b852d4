"""Readable text of a posting page."""

from __future__ import annotations

from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.html_tree import text_nodes
from matchloom.functions.text import let, trim_u

# Line ends that split a text node into lines (more than \n, unlike sections and passages).
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}]"
#: Pages whose texts are held as Python strings at once.
SLICE_PAGES = 64


def decode_entities(s: Column) -> Column:
    """Named (HTML 4), decimal and hexadecimal character references; unknown names stay as they are."""
    names = {n: name2codepoint[n] for n in ("amp", "nbsp", "lt", "gt", "quot")} | {"apos": 39} | name2codepoint
    table = F.create_map(*[F.lit(x) for name, code in names.items() for x in (name, chr(code))])

    def numeric(ref: Column) -> Column:
        hexadecimal = F.conv(F.substr(ref, F.lit(3)), 16, 10)
        n = F.when(F.rlike(ref, F.lit("^#[xX]")), hexadecimal).otherwise(F.substr(ref, F.lit(2))).cast("bigint")
        valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def parts(p: Column, i: Column) -> Column:
        ref = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        return F.struct(p.alias("p"), F.when(i > 0, ref).otherwise(F.lit("")).alias("ref"), (i == 0).alias("first"))

    def char(x: Column) -> Column:
        c = F.when(F.startswith(x["ref"], F.lit("#")), numeric(x["ref"])).when(x["ref"] != "", F.try_element_at(table, x["ref"]))
        return F.struct(x["p"].alias("p"), x["first"].alias("first"), F.length(x["ref"]).alias("n"), c.alias("char"))

    def written(x: Column) -> Column:
        replaced = F.concat(x["char"], F.substr(x["p"], x["n"] + 2))
        return F.when(x["first"], x["p"]).otherwise(F.coalesce(replaced, F.concat(F.lit("&"), x["p"])))

    pieces = F.transform(F.transform(F.transform(F.split(s, "&"), parts), char), written)
    return F.when(F.contains(s, F.lit("&")), F.array_join(pieces, "")).otherwise(s)


def _text_nodes(pages: pa.Array) -> pa.Array:
    # Pages become Python strings one at a time, and their texts go back to Arrow some at a time.
    parts = [pa.array([None if (page := p.as_py()) is None else text_nodes(page) for p in pages.slice(lo, SLICE_PAGES)], pa.string()) for lo in range(0, len(pages), SLICE_PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def posting_text(html: Column) -> Column:
    """Body copy, one text node per line, blank lines dropped. Which nodes there are is decided in Arrow batches (html_tree); the rest is expressions."""
    nodes = F.arrow_udf(_text_nodes, "string")(html)
    lines = F.transform(F.split(let(nodes, decode_entities), LINE_END), trim_u)
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")
