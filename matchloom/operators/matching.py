"""Resume x posting scores, retrieval of passages, best role, self-similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions.vectors import cosine
from matchloom.operators import cell_search
from matchloom.operators.pairwise import BLOCK_ROWS, PAIR_ROWS, group_scores, pair_scores
from matchloom.sources.tables import materialise


def last_of_name(jobs: DataFrame, job: str, order: str) -> DataFrame:
    """One row per job name: a repeated name keeps its last occurrence."""
    return jobs.groupBy(job).agg(F.max_by(F.struct(*jobs.columns), F.col(order)).alias("_row")).select("_row.*")


def score_matrix(resumes: DataFrame, jobs: DataFrame, resume: str, job: str, block_rows: int = PAIR_ROWS) -> DataFrame:
    """(resume, job, score): every pair, score rounded to 3 places. A resume without a vector has no rows."""
    return pair_scores(resumes, jobs, resume, job, decimals=3, block_rows=block_rows)


def score_map(resumes: DataFrame, matrix: DataFrame, resume: str, job: str) -> DataFrame:
    """(resume, scores MAP<job, score>); a resume that could not be scored keeps an empty map."""
    # One map per resume is as long as the list of jobs, which the result format itself asks for.
    maps = matrix.groupBy(resume).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(job, "score")))).alias("scores"))
    empty = F.create_map().cast(maps.schema["scores"].dataType)
    return resumes.select(resume).join(maps, resume, "left").withColumn("scores", F.coalesce("scores", empty))


def best_first(group: str, *ids: str) -> Window:
    """Score from high to low, then ids from low to high."""
    return Window.partitionBy(group).orderBy(F.desc("score"), *ids)


def best_job(resumes: DataFrame, jobs: DataFrame, resume: str, job: str, keep: int = 1, block_rows: int = PAIR_ROWS) -> DataFrame:
    """(resume, job, score, rank) of the `keep` best jobs; no cell emits more than it can contribute."""
    near = pair_scores(resumes, jobs, resume, job, decimals=3, top=keep, block_rows=block_rows)
    ranked = near.withColumn("rank", F.row_number().over(best_first(resume, job)))
    return ranked.where(F.col("rank") <= keep)


def retrieve(
    queries: DataFrame,
    passages: DataFrame,
    query: str,
    passage: str,
    k: int = V.RETRIEVE_K,
    role: str | None = None,
    query_role: str | None = None,
    block_rows: int = PAIR_ROWS,
    index: cell_search.CellIndex | None = None,
) -> DataFrame:
    """Exact top-k passages per query: (query, passage columns, score, rank).

    With an index of the passages (cell_search.build) only cells that can hold a hit are compared, without one every
    query meets every passage; the rows are the same. With a role, the 4k best of the WHOLE index are found first and filtered afterwards, so fewer than k may
    remain. `query_role` names the query's role column, `role` the passage's.
    """
    wide = max(k * V.OVERFETCH, k)
    if index is None:
        near = pair_scores(queries, passages, query, passage, top=wide, block_rows=block_rows)
    else:
        near = cell_search.search(queries, index, query, passage, wide, block_rows=block_rows).hits
    near = near.withColumn("at", F.row_number().over(best_first(query, passage))).where(F.col("at") <= wide)
    hits = near.join(passages.drop("vec"), passage)
    if role is not None:
        hits = hits.join(queries.select(query, F.col(query_role).alias("_role")), query).where(F.col(role) == F.col("_role")).drop("_role")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("at")))
    return hits.where(F.col("rank") <= k).drop("at")


def self_similarity(items: DataFrame, item: str, block_rows: int = PAIR_ROWS) -> DataFrame:
    """(a, b, score): the similarity of every item to every item, itself included."""
    left, right = items.select(F.col(item).alias("a"), "vec"), items.select(F.col(item).alias("b"), "vec")
    return pair_scores(left, right, "a", "b", block_rows=block_rows)


def first_row_similarity(items: DataFrame, group: str, position: str) -> DataFrame:
    """Similarity of each group's item 0 to all of its items; null where a group has fewer than two, or no item 0."""
    start = F.when(F.col(position) == 0, F.col("vec"))
    # A stored side lets AQE split the join where one group is large.
    first = materialise(items.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.max(start).alias("_first")), "first_items")
    score: Column = F.when(F.col("_n") >= 2, F.round(cosine(F.col("_first"), F.col("vec")), 6))
    return items.join(first, group).withColumn("score", score).drop("_first", "_n", "vec")


def evidence(pairs: DataFrame, passages: DataFrame, pair: str, posting: str, k: int = V.SCREEN_K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `matched`: the texts of the k passages of the pair's own posting that are closest to its vector; without any, an empty array.

    `pairs` has (pair, posting, vec), `passages` has (posting, chunk_no, text, vec). Pairs and passages of a posting
    meet in blocks, so neither a popular posting nor a long one is one task's; a block gives back at most k passages
    a pair, and only their texts are fetched.
    """
    near = group_scores(pairs, passages, posting, pair, "chunk_no", top=k, block_rows=block_rows)
    order = Window.partitionBy(pair).orderBy(F.desc("score"), "chunk_no")
    hits = near.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k)
    texts = hits.join(passages.select(posting, "chunk_no", F.col("text").alias("_passage")), [posting, "chunk_no"])
    matched = texts.groupBy(pair).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_passage"))), lambda h: h["_passage"]).alias("matched"))
    return pairs.join(matched, pair, "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
