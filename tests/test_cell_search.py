"""Search through cells against all pairs, and how many cells it visits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import cell_search, matching
from matchloom.operators.pairwise import TOP_PARTS


def table(spark, x, key):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], f"{key} bigint, vec array<double>")


def clustered(n, seed, unit=True):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(1).standard_normal((25, 12))
    x = middle[rng.integers(0, 25, n)] + 0.05 * rng.standard_normal((n, 12))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.1, 5, (n, 1))


@pytest.mark.parametrize(("unit", "cells", "block"), [(True, None, 1024), (False, None, 7), (True, 1, 50), (False, 60, 1024)])
def test_same_hits_as_all_pairs(spark, unit, cells, block):
    p, q = clustered(700, 2, unit), clustered(40, 3, unit)
    p[100:160] = p[:60]  # equal passages tie
    passages, queries = table(spark, [*p, None, np.zeros(12)], "pid"), table(spark, [*q, None, np.zeros(12)], "qid")
    want = matching.retrieve(queries, passages, "qid", "pid", k=3)
    got = matching.retrieve(queries, passages, "qid", "pid", k=3, block_rows=block, index=cell_search.build(passages, "pid", cells=cells, block_rows=block))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 41 * 3


def test_most_cells_are_never_visited(spark):
    passages, queries = table(spark, clustered(2500, 4), "pid"), table(spark, clustered(60, 5), "qid")
    index = cell_search.build(passages, "pid")
    visits = cell_search.search(queries, index, "qid", "pid", 12).visits.agg(F.count("*").alias("n"), F.sum("cells").alias("cells")).first()
    assert visits["n"] == 60 and visits["cells"] < 0.5 * 60 * len(index.centres)
    assert index.rows.count() == 2500


def test_few_passages_and_none(spark):
    queries = table(spark, clustered(3, 6), "qid")
    two = table(spark, clustered(2, 7), "pid")
    assert matching.retrieve(queries, two, "qid", "pid", k=5, index=cell_search.build(two, "pid")).count() == 6
    assert matching.retrieve(queries, two.limit(0), "qid", "pid", k=5, index=cell_search.build(two.limit(0), "pid")).count() == 0
    assert matching.retrieve(queries.limit(0), two, "qid", "pid", k=5, index=cell_search.build(two, "pid")).count() == 0


def test_vectors_do_not_travel_to_the_cells(spark):
    passages, queries = table(spark, clustered(2500, 4), "pid"), table(spark, clustered(300, 5), "qid")
    index = cell_search.build(passages, "pid", block_rows=20)
    found = cell_search.search(queries, index, "qid", "pid", 12, block_rows=20)
    plan = found.hits._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "CoGroup" not in plan
    assert 300 * 12 <= found.hits.count() <= 300 * 12 * TOP_PARTS
    cell = {r["r"]: r["cell"] for r in index.rows.collect()}
    pieces = index.blocks.collect()
    assert sorted(i for p in pieces for i in p["ids"]) == list(range(2500))
    assert all(len(p["ids"]) <= 20 and {cell[i] for i in p["ids"]} == {p["cell"]} for p in pieces)
