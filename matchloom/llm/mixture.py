"""Mixing sources to target weights by hash thresholds that nested histograms find; nothing is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.tables import stored

WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times.
MOST = 3
#: The hash has LEVELS * BITS = 60 bits; each level looks at BITS more of them.
BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    """Runs of characters other than 20 and 09-0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def place(key: Column, text: Column) -> Column:
    """A document's place between 0 and 2^60, from its id alone, without one from its text: any smaller budget takes a subset of what a larger one takes."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("text "), F.md5(text.cast("string").cast("binary"))), F.lit(""))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight and target. One row a source: the windows here run over names, not documents.

    Weights repeat over sources in code point order, null last. A target stops at MOST times its source; the excess is
    shared anew by weight. With sources ordered by what they can give per unit of weight, those that stop are the first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("most", (MOST * F.col("source_size")).cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(every).cast("double"), F.sum("weight").over(every)
    given, passed = F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("full", (total - given) / (heavy - passed) * F.col("weight") > F.col("most"))
    unit = (total - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * unit).alias("target"))


def thresholds(slim: DataFrame) -> DataFrame:
    """(source, size, place) -> one row a source: source_size, target, copies of every document, and the place below which one more is taken.

    A histogram of BITS bits by source finds the bucket where the budget ends; only that bucket's rows go into the next
    level. The documents at the last place are taken if that comes nearer to the budget. Documents that share a place share a fate.
    """
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("copies", copies.cast("bigint")).withColumn("extra", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = stored(plan, "mix_plan")
    rows, state = slim, plan.select("source", F.col("extra").alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        bucket = F.shiftright("place", shift)
        sums = rows.groupBy(F.col("source").alias("name"), bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        up = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2^BITS rows a source
        ends = sums.withColumn("upto", F.sum("words").over(up)).join(
            state.select("source", "left"), F.col("name").eqNullSafe(F.col("source"))).where(F.col("upto") > F.col("left"))
        state = ends.groupBy("source").agg(F.min(F.struct("bucket", "words", "upto", "left")).alias("e")).select(
            "source", (F.col("e.left") - (F.col("e.upto") - F.col("e.words"))).alias("left"), F.col("e.bucket").alias("prefix"), F.col("e.words").alias("words"))
        state = stored(state, "mix_level")
        if level < LEVELS:
            edge = state.select(F.col("source").alias("edge"), "prefix")
            rows = stored(rows.join(edge, F.col("source").eqNullSafe(F.col("edge")) & (bucket == F.col("prefix"))).select("source", "size", "place"), "mix_edge")
    cut = state.select(F.col("source").alias("name"), (F.col("prefix") + (2 * F.col("left") >= F.col("words")).cast("bigint")).alias("cut"))
    return plan.join(cut, F.col("name").eqNullSafe(F.col("source")), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("cut", F.lit(0).cast("bigint")).alias("cut"))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text").cast("string")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place"))


def _taken(limits: DataFrame) -> tuple[DataFrame, Column]:
    renamed = limits.select(*[F.col(c).alias(f"_mix_{c}") for c in limits.columns])
    return renamed, F.col("_mix_copies") + (F.col("_mix_place") < F.col("_mix_cut")).cast("bigint")


def mixture(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, size, source_size, target, taken), one row per row.

    The sources' weights 1, 2, 3, repeating, share all words; a source gives at most three times its own. Every document
    of a source is taken `copies` times, those below its threshold once more. A null source is a source, the last; null
    or empty texts have size 0; a null doc_id is placed by its text; repeated rows share a fate. No rows, no rows.
    """
    slim = stored(_slim(docs), "mix_slim")
    limits, times = _taken(thresholds(slim))
    rows = slim.withColumnRenamed("place", "_mix_place")
    return rows.join(limits, F.col("source").eqNullSafe(F.col("_mix_source"))).select(
        "doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (times * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with all their columns and `copies`, how often each is taken (a column of that name is replaced)."""
    limits, times = _taken(thresholds(stored(_slim(docs), "mix_slim")))
    rows = docs.withColumn("_mix_place", place(F.col("doc_id"), F.col("text")))
    out = rows.join(limits, F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))).withColumn("copies", times)
    return out.where("copies > 0").drop("_mix_place", *limits.columns)
