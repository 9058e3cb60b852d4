"""Vector codes and centroid clusters against plain loops over whole numbers, and how much their bounds spare."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import centroids, codebooks, integers

ODD = [
    (900, None, 1), (901, [float("nan")] * 16, 1), (902, [None] + [0.5] * 15, 1), (903, [float("inf")] + [0.0] * 15, 1), (904, [], 1),
]
SCHEMA = "vec_id bigint, embedding array<double>, label int, code int, cluster int, n int, x int, h int, sums int"


def vectors(seed=3, n=400, spread=0.4):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((9, 16))
    rows = [(int(i), [float(v) for v in middle[i % 9] + spread * rng.standard_normal(16)], [0, 1, None][i % 3]) for i in rng.permutation(n)]
    hot = [(1000 + i, rows[0][1], 1) for i in range(n // 2)]
    return rows + hot + [rows[5], rows[5], (None, rows[7][1], None), (2000, [0.0] * 16, 2), (2001, [-0.0001] * 16, 2)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in vectors() + ODD], SCHEMA)


def whole(rows):
    return [(i, [int(np.floor(1024 * c)) for c in v], label) for i, v, label in rows]


def nearest(x, entries):
    d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
    return d.index(min(d)), min(d)


def moved(entries, groups):
    return [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for e, g in zip(entries, groups, strict=True)]


def plain_codes(rows, parts, entries, rounds):
    rows = whole(rows)
    width = len(rows[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    ids = sorted({i for i, _, _ in rows if i is not None})[:entries]
    start = [min(v for i, v, _ in rows if i == j) for j in ids]
    books = [[cut(v)[p] for v in start] for p in range(parts)]
    for r in range(rounds + 1):
        told = [[nearest(c, books[p]) for p, c in enumerate(cut(v))] for _, v, _ in rows]
        if r < rounds:
            for p in range(parts):
                books[p] = moved(books[p], [[cut(v)[p] for (_, v, _), t in zip(rows, told, strict=True) if t[p][0] == e] for e in range(len(books[p]))])
    label = {}
    for (_, _, lab), t in zip(rows, told, strict=True):
        label[lab] = label.get(lab, 0) + sum(d for _, d in t)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e, _ in t), sum(d for _, d in t), label[lab], sha) for (i, _, lab), t in zip(rows, told, strict=True)), key=str)


@pytest.mark.parametrize(("parts", "entries"), [(4, 40), (2, 5), (4, 256)])
def test_codes(table, parts, entries):
    got = codebooks.compressed(table, parts, entries, 4)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(vectors(), parts, entries, 4)


def test_codes_of_odd_tables(spark, table):
    assert codebooks.compressed(table.limit(0)).count() == 0
    assert codebooks.compressed(spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in ODD], SCHEMA)).count() == 0
    few = spark.createDataFrame([(1, [1.0] * 5, 0), (2, [2.0] * 5, 0), (3, [3.0] * 3, 0), (4, [1e300, -1e300, 0.0, 0.0, 0.0], 0)], "vec_id bigint, embedding array<double>, label int")
    rows = {r["vec_id"]: r for r in codebooks.compressed(few).collect()}
    assert sorted(rows) == [1, 2, 4] and {r["error"] for r in rows.values()} == {0}
    assert [len(r["code"]) for r in rows.values()] == [8] * 3


def test_bounds_are_kept_with_their_rounds_and_spare_scans(spark, table):
    points = integers.whole(table, "vec_id", "label").where("size(x) = 16").withColumn("label", F.col("label").cast("bigint"))
    scans = []
    for rounds in (1, 4):
        state = codebooks.trained(points, 16, 4, 256, rounds).state
        scans.append(state.agg({"scanned": "sum"}).first()[0])
    assert scans[1] < 0.5 * scans[0]


def test_net_displacement_is_no_more_than_the_sum_of_moves():
    rng = np.random.default_rng(0)
    history = [rng.integers(-500, 500, (40, 4)) for _ in range(5)]
    net, groups = codebooks.displacements(history)
    steps = [np.sqrt(((a - b) ** 2).sum(axis=1)) for a, b in zip(history, history[1:], strict=False)]
    assert all((net[k] <= sum(steps[k:]) + 1e-6).all() for k in range(4)) and (net[4] == 0).all()
    assert groups.shape == (5, 3) and (groups[0] == [net[0][:16].max(), net[0][16:32].max(), net[0][32:].max()]).all()


def test_assignment_through_bounds_equals_a_full_scan():
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (500, 3))
    history, known = [rng.integers(-40, 40, (50, 3))], codebooks.unknown(500, 50)
    for _ in range(12):
        known, _ = codebooks.assign(x, history, known)
        assert (known.code == integers.squared(x, history[-1]).argmin(axis=1)).all()
        history.append(history[-1] + rng.integers(-2, 3, (50, 3)))


def test_squares_beyond_doubles_are_exact():
    x, c = np.array([[1 << 27, 1 - (1 << 27)]]), np.array([[-(1 << 27), 1 << 27], [1 << 27, 2 - (1 << 27)]])
    assert integers.squared(x, c).tolist() == [[(1 << 28) ** 2 + ((1 << 28) - 1) ** 2, 1]]


def plain_clusters(rows, clusters, rounds, seed):
    rows = whole(rows)
    key = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    ids = sorted({i for i, _, _ in rows}, key=key)[:clusters]
    c = [min(v for i, v, _ in rows if i == j) for j in ids]
    for r in range(rounds + 1):
        told = [nearest(v, c) for _, v, _ in rows]
        if r < rounds:
            c = moved(c, [[v for (_, v, _), t in zip(rows, told, strict=True) if t[0] == k] for k in range(len(c))])
    own = {}
    for k, d in told:
        own[k] = own.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i, k, d, own[k], sum(own.values()), sha[k]) for (i, _, _), (k, d) in zip(rows, told, strict=True)), key=str)


@pytest.mark.parametrize("clusters", [1, 8, 37])
def test_clusters(table, clusters):
    got = centroids.clustered(table, clusters, 5, 16, 3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(vectors(), clusters, 5, 3)


def test_clusters_of_odd_tables(spark, table):
    assert centroids.clustered(table.limit(0)).count() == 0
    assert centroids.clustered(table).count() == 0  # no vector of 64 components
    big = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id bigint, embedding array<float>")
    assert [r["distance"] for r in centroids.clustered(big, 1, 0).collect()].count(0) == 1
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(50)], "vec_id bigint, embedding array<double>")
    assert {(r["cluster"], r["distance"]) for r in centroids.clustered(same).collect()} == {(0, 0)}


def test_tree_search_is_exact_and_visits_few():
    rng = np.random.default_rng(6)
    middle = rng.integers(-3000, 3000, (40, 8))
    c = np.concatenate([m + rng.integers(-60, 60, (10, 8)) for m in middle])
    c = np.concatenate([c, c[::7], c[:3]])  # equal centroids tie
    x = np.concatenate([middle[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 8)), c, rng.integers(-9000, 9000, (500, 8))])
    nodes = centroids.vantage_tree(c)
    assert sorted(n.point for n in nodes) == list(range(len(c)))
    who, d2, seen = centroids.nearest(x, c, nodes)
    full = integers.squared(x, c)
    assert (who == full.argmin(axis=1)).all() and (d2 == full.min(axis=1)).all()
    assert seen < 0.4 * full.size
