"""Greedy packing of non-blank lines into short passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions.text import let, trim_u

#: Lines of a block. Appending copies an array, so a fold over all lines would take time by the square of their number.
BLOCK = 256


def passages(text: Column, max_chars: int = V.MAX_CHUNK_CHARS) -> Column:
    """ARRAY<STRING>. A line that does not fit closes the passage before it; a long line stands alone."""
    none = F.array().cast("array<string>")

    def step(acc: Column, line: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(line) + 1 > max_chars)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["open"] == ""), line).otherwise(F.concat(acc["open"], F.lit(" "), line)).alias("open"),
        )

    def block(acc: Column, lines: Column) -> Column:
        def gathered(x: Column) -> Column:
            return F.struct(F.array_append(acc["done"], x["done"]).alias("done"), x["open"].alias("open"))

        return F.aggregate(lines, F.struct(none.alias("done"), acc["open"].alias("open")), step, gathered)

    def finish(acc: Column) -> Column:
        done = F.flatten(acc["done"])
        return F.when(acc["open"] != "", F.array_append(done, acc["open"])).otherwise(done)

    def packed(lines: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lines) / BLOCK).cast("int")), lambda i: F.slice(lines, i * BLOCK + 1, BLOCK))
        start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.lit("").alias("open"))
        return F.aggregate(blocks, start, block, finish)

    lines = F.filter(F.transform(F.split(text, "\n"), trim_u), lambda l: l != "")
    return F.when(text.isNotNull(), let(lines, packed))
