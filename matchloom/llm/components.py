"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.tables import forget, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. large: every node links its larger neighbours to the least node around it; small: its smaller neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # Stored: AQE splits a hub's links in a join with a table, not in one with an aggregate.
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    near = both.join(least, "u").withColumn("m", F.least("m", "u"))
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.least("m", "u").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): component is the least node that it reaches.

    Each pass is aggregations with a map-side combine and equi-joins of stored tables, its result a table in the shared
    folder, so a hub's links are spread over tasks. Callers link a group's members to one another by spanning sets, not
    by all pairs. Ends when a pass changes nothing: then every node points to the least of its component. Null nodes and loops are left out; no links, no rows.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        new = stored(_stars(_stars(edges, True), False), "stars")
        mark = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        forget(edges)
        edges = new
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
