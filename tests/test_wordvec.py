"""Word vector look-up against a plain loop, and trained tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchloom.operators import wordvec

TABLE = [("spark", [1.0, 0.0]), ("data", [0.0, 2.0]), ("lost", None), ("short", [1.0]), ("data", [0.0, 2.0]), (None, [5.0, 5.0])]
DOCS = {1: "Spark data DATA unknown x", 2: "", 3: None, 4: "lost short", 5: "spark " * 2000, 6: "spark"}


def test_means(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "id long, text string").withColumn("vec", F.lit("clash")).withColumn("word", F.lit(1))
    table = spark.createDataFrame(TABLE, "word string, vec array<double>")
    got = {r["id"]: r for r in wordvec.document_means(docs, table, "id", "text", 2).collect()}
    known = {"spark": (1, 0), "data": (0, 2)}
    assert sorted(got) == sorted(DOCS)
    for i, t in DOCS.items():
        words = [w for w in (t or "").lower().split() if len(w) > 1]
        hit = [known[w] for w in words if w in known]
        assert (got[i]["n_words"], got[i]["n_known"]) == (len(words), len(hit))
        assert got[i]["vec"] == (pytest.approx([sum(c) / len(hit) for c in zip(*hit)]) if hit else None)
    assert wordvec.document_means(docs.limit(0), table, "id", "text", 2).count() == 0
    assert {r["vec"] for r in wordvec.document_means(docs, table.limit(0), "id", "text", 2).collect()} == {None}


def test_trained_table(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma " * 5) for i in range(20)], "id long, text string")
    table = wordvec.trained_table(docs, "text", width=4, partitions=1)
    assert {r["word"]: len(r["vec"]) for r in table.collect()} == {"alpha": 4, "beta": 4, "gamma": 4}
    assert wordvec.document_means(docs, table, "id", "text", 4).where("n_known = 15").count() == 20


@pytest.mark.parametrize("size", [1, 40, 10**6])
def test_a_block_asks_for_a_word_once(spark, monkeypatch, size):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(wordvec, "BLOCK_WORDS", size)
    texts = [["data", "lake"] * 10, [], ["data"] * 30, ["lake", "x1", "data"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts, pa.list_(pa.string()))], ["key", "words"])

    class Context:
        def partitionId(self):
            return 3

    monkeypatch.setattr(wordvec.TaskContext, "get", Context)
    made = [b.to_pylist()[0] for b in wordvec._block_words([batch])]
    assert [k for m in made for k in m["keys"]] == [0, 1, 2, 3]
    assert all(len(m["words"]) == len(set(m["words"])) for m in made) and len({m["block"] for m in made}) == len(made)
    assert sum(int(np.frombuffer(m["tfs"], np.int32).sum()) for m in made) == 53
    assert len(made) == {1: 4, 40: 2, 10**6: 1}[size]


def test_no_vector_travels_with_a_document(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma " * 5) for i in range(500)], "id long, text string").coalesce(1)
    table = spark.createDataFrame([(w, [1.0, 2.0]) for w in ("alpha", "beta", "gamma")], "word string, vec array<double>")
    made = wordvec.document_means(docs, table, "id", "text", 2)
    assert made.where("n_known = 15").count() == 500
    assert "Summarizer" not in made._jdf.queryExecution().toString() and "FlatMapCoGroupsInArrow" in made._jdf.queryExecution().toString()


def test_a_block_goes_on_over_batches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = [["data", "lake"], ["lake", "x1"], [], ["x1", "data", "data"]]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.list_(pa.string()))], ["key", "words"]) for i, t in enumerate(texts)]

    class Context:
        def partitionId(self):
            return 0

    monkeypatch.setattr(wordvec.TaskContext, "get", Context)
    (made,) = (b.to_pylist()[0] for b in wordvec._block_words(iter(batches)))
    assert made["keys"] == [0, 1, 2, 3] and sorted(made["words"]) == ["data", "lake", "x1"]
    lengths, places, tfs = (np.frombuffer(made[c], np.int32) for c in ("lengths", "places", "tfs"))
    entries = [(made["words"][p], int(n)) for p, n in zip(places, tfs)]
    assert lengths.tolist() == [2, 2, 0, 2]
    assert [sorted(entries[a:b]) for a, b in ((0, 2), (2, 4), (4, 6))] == [[("data", 1), ("lake", 1)], [("lake", 1), ("x1", 1)], [("data", 2), ("x1", 1)]]


def test_narrow_vectors_travel_narrow_and_only_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta")], "id long, text string")
    table = spark.createDataFrame([("alpha", [0.1, 2.0]), ("beta", [4.0, 5.0]), ("beta", [3.0, 9.0])], "word string, vec array<float>")
    made = wordvec.document_means(docs, table, "id", "text", 2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan and "Aggregate" not in plan and "word_table" not in plan
    x = float(table.first()["vec"][0])
    assert {r["id"]: r["vec"] for r in made.collect()} == {1: pytest.approx([(x + 6) / 3, 20 / 3], abs=1e-12), 2: [3.0, 9.0]}


def test_entries_are_squeezed_and_come_back():
    import numpy as np
    import pyarrow as pa

    for x in ([], [0], [1, -5, 2**31 - 1, -(2**31), 7], list(range(1000)) * 3):
        packed = wordvec._squeezed(np.array(x, np.int32))
        assert wordvec._numbers(pa.scalar(packed, pa.binary()), len(x)).tolist() == x
    assert len(packed) < 1500
