"""Context-tree scores against a recursion over plain dictionaries."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchloom.llm import context_tree

RND = random.Random(11)
TEXTS = [" ".join(RND.choice(["the", "Thing", "other", "oth\tér", "a", "日本"]) for _ in range(RND.randint(0, 30))) for _ in range(40)]
TEXTS += [None, "", "   ", "x" * 300, "\x00\x00a", TEXTS[0], TEXTS[0]]


def is_held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def plain_scores(rows, depth):
    """{text: log10 probability}: counts of every (context, bits) by walking all training texts, weights by recursion from each node."""
    counts, children = {}, {}

    def walk(text):
        raw = b"\xff" * depth + "".join(c.lower() if c.isascii() else c for c in text or "").encode() + b"\xff"
        for t in range(depth, len(raw)):
            for i in range(8):
                yield raw[t - depth : t][::-1], (1 << i) | (raw[t] >> (8 - i)), raw[t] >> (7 - i) & 1

    for i, text in rows:
        if not is_held(i):
            for context, u, bit in walk(text):
                for d in range(depth + 1):
                    counts.setdefault((context[:d], u), [0, 0])[bit] += 1
                    if d:
                        children.setdefault((context[: d - 1], u), set()).add((context[:d], u))

    def kt(node):
        a, b = counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    known = {}

    def weighted(node):
        if node not in known:
            if len(node[0]) == depth:
                known[node] = kt(node)
            else:
                x, y = kt(node), sum(weighted(c) for c in children.get(node, ()))
                known[node] = math.log(0.5) + max(x, y) + math.log1p(math.exp(-abs(x - y)))
        return known[node]

    def chance(context, u, bit, d=0):
        node = (context[:d], u)
        pair = counts.get(node, (0, 0))
        own = (pair[bit] + 0.5) / (sum(pair) + 1)
        if d == depth:
            return own
        w = math.exp(math.log(0.5) + kt(node) - weighted(node))
        return w * own + (1 - w) * chance(context, u, bit, d + 1)

    return {text: sum(math.log10(chance(*step)) for step in walk(text)) for _, text in rows}


def plain_base(rows):
    words = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").encode().split() + [b" "]
    seen = Counter(w for i, t in rows if not is_held(i) for w in words(t))
    total, distinct = sum(seen.values()), len(seen)
    return {t: (len(words(t)), sum(w in seen for w in words(t)), total, sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words(t))) for _, t in rows}


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id, the Other thing")]


@pytest.mark.parametrize(("depth", "small"), [(1, False), (3, True), (4, False), (5, True)])
def test_scores(spark, rows, monkeypatch, depth, small):
    if small:  # many blocks, shards, buckets and pieces of a text
        for name, value in {"BLOCK": 200, "SHARD": 1000, "BUCKET": 300, "SLICE": 64, "CHUNK": 50}.items():
            monkeypatch.setattr(context_tree, name, value)
    table = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id bigint, text string, key int, kind string, shard int").repartition(3)
    got = context_tree.scored(table, depth).withColumn("n", F.lit(1)).collect()
    assert len(got) == len(rows)
    score, base = plain_scores(rows, depth), plain_base(rows)
    text_of = dict(rows)
    for r in got:
        text = text_of[r["doc_id"]]
        n, n_known, total, b = base[text]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (is_held(r["doc_id"]), n, n_known, total)
        assert r["base_score"] == pytest.approx(b, rel=1e-12) and r["score"] == pytest.approx(score[text], rel=1e-6)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / (r["n_bytes"] + 1))


def test_probabilities_of_all_next_bytes_add_up(spark):
    """Texts of one byte and of none: P(end at once) + sum over first bytes of P(byte) is at most 1, and near it when the edge is counted."""
    rows = [(i, chr(97 + i % 26)) for i in range(60)]
    all_bytes = context_tree.gram_table(spark.createDataFrame([(((0xFFFF << 8) | b), 5 if b == 97 else 0) for b in range(256)], "key bigint, n bigint"), 2)
    assert sum(10 ** r["value"] for r in all_bytes.collect()) == pytest.approx(1)
    assert context_tree.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 60


def test_scores_of_empty_and_unlearned_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert context_tree.scored(none).count() == 0
    held = spark.createDataFrame([(None, "ab"), (None, None)], "doc_id bigint, text string")
    got = {r["n_bytes"]: r for r in context_tree.scored(held).collect()}
    assert got[2]["score"] == pytest.approx(24 * math.log10(0.5)) and got[0]["train_tokens"] == 0 and got[0]["n_known"] == 0


def test_long_text_is_scored_whole(spark, monkeypatch):
    text = " ".join(RND.choice(["alpha", "beta", "gamma"]) for _ in range(60_000))
    table = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id bigint, text string")
    whole = {r["doc_id"]: r for r in context_tree.scored(table).collect()}
    monkeypatch.setattr(context_tree, "SLICE", 1000)
    cut = {r["doc_id"]: r for r in context_tree.scored(table).collect()}
    assert whole[1]["n_tokens"] == 60_001 and all(whole[i]["score"] == pytest.approx(cut[i]["score"], rel=1e-9) for i in whole)
    assert whole[1]["bits_per_byte"] < 0.4
