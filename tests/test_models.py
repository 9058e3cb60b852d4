"""Fitted models: a quality floor, calibration, persistence."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import calibrate, classify, metrics, stratify, svm

WORDS = {"tax": "audit ledger invoice revenue", "web": "browser script layout widget", "lab": "assay reagent pipette culture"}


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(90):
        cat = list(WORDS)[i % 3]
        rows.append((i, cat, " ".join(rnd.choices(WORDS[cat].split(), k=6) + rnd.choices("team work plan goal".split(), k=6))))
    return spark.createDataFrame(rows, "id long, cat string, text string").repartition(2)


@pytest.fixture(scope="module")
def trained(corpus):
    return classify.train_and_evaluate(corpus, "id", "text", "cat")


def test_quality_floor(trained):
    record = trained[0].first()
    assert (record["n_resumes"], record["n_categories"]) == (90, 3)
    assert record["holdout_top1_accuracy"] >= 0.9 and record["holdout_macro_f1"] >= 0.9 and record["holdout_top3_accuracy"] == 1.0


def test_predictions(spark, trained):
    docs = spark.createDataFrame([(1, "ledger audit invoice"), (2, "  "), (3, "browser widget")], "id long, text string")
    got = {r["id"]: r for r in classify.predict(trained[1], docs, "text").collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3)] == ["tax", "Unknown", "web"]
    for r in got.values():
        probs = [p["prob"] for p in r["probs"]]
        assert sum(probs) == pytest.approx(1.0) and probs == sorted(probs, reverse=True) and len(probs) == 3


def test_save_and_load(spark, trained, tmp_path):
    docs = spark.createDataFrame([(1, "ledger audit"), (2, "pipette")], "id long, text string")
    folder = str(tmp_path / "model")
    classify.save(trained[1], spark, folder)
    classify.save(trained[1], spark, folder)  # replaces what is there
    again = classify.load(spark, folder)
    assert again.classes == sorted(WORDS)
    before, after = (sorted(classify.predict(m, docs, "text").select("id", "probs").collect()) for m in (trained[1], again))
    assert before == after
    with pytest.raises(FileNotFoundError):
        classify.load(spark, str(tmp_path / "none"))


def test_two_classes_mirror(corpus):
    two = corpus.where(F.col("cat") != "lab")
    scored = classify.predict(classify.fit(two, "id", "text", "cat"), two, "text")
    assert metrics.accuracy(scored, "cat", "predicted").first()["top1"] >= 0.95


def sparse_rows(spark, n, classes, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        label = rnd.randrange(classes)
        terms = sorted({rnd.randrange(12) for _ in range(rnd.randint(0, 5))} | {12 + label} if rnd.random() < 0.9 else set())
        rows.append((rnd.randrange(3), label, terms, [rnd.uniform(0.1, 1) for _ in terms]))
    return rows, spark.createDataFrame(rows, "fold int, label int, indices array<int>, values array<double>").repartition(3)


def test_planes_sit_at_the_optimum(spark):
    """The objective is strictly convex: where its gradient vanishes is its only minimum."""
    rows, table = sparse_rows(spark, 300, 4, 2)
    planes = [(f, c) for f in range(3) for c in range(4)]
    weights, biases = svm.fit_planes(table, planes, 16)
    for (f, c), w, b in zip(planes, weights, biases, strict=True):
        gradient, start = np.append(w, b), np.zeros(17)
        for fold, label, terms, values in rows:
            if fold != f:
                x = np.zeros(17)
                x[terms], x[16] = values, 1
                y = 1 if label == c else -1
                gradient = gradient - 2 * y * max(0, 1 - y * (x @ np.append(w, b))) * x
                start = start - 2 * y * x
        assert np.linalg.norm(gradient) <= 2 * svm.TOLERANCE * np.linalg.norm(start)


def test_blocks_of_entries_do_not_matter(spark, monkeypatch):
    _, table = sparse_rows(spark, 80, 3, 4)
    planes = [(0, c) for c in range(3)]
    whole = svm.fit_planes(table, planes, 15)
    monkeypatch.setattr(svm, "SLICE", 10)
    monkeypatch.setattr(svm, "DIRECT", 0)
    cut = svm.fit_planes(table, planes, 15)
    assert np.allclose(whole[0], cut[0], atol=1e-9) and np.allclose(whole[1], cut[1], atol=1e-9)


def test_jobs_do_not_follow_the_planes(spark):
    def jobs(classes, folds):
        name = f"planes-{classes}-{folds}"
        spark.sparkContext.setJobGroup(name, name)
        svm.fit_planes(sparse_rows(spark, 200, classes, 3)[1], [(f, c) for f in range(folds) for c in range(classes)], 12 + classes)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs(12, 3) < 3 * jobs(2, 1)


def test_no_row_at_a_time_python(spark, trained):
    docs = spark.createDataFrame([(1, "ledger audit"), (2, None)], "id long, text string")
    scored = classify.predict(trained[1], docs, "text")
    plan = scored._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" in plan and scored.count() == 2


def test_held_out_part_is_the_ranked_one(spark, corpus):
    ranked = stratify.shuffled_rank(corpus, "cat", "id").where(stratify.held_out())
    train, test = classify.hold_out(corpus, "cat", "id")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(test) == ids(ranked) and ids(train.unionByName(test)) == list(range(90)) and test.columns == corpus.columns


def test_sigmoids_sit_at_the_optimum(spark):
    rnd = random.Random(5)
    rows = [(f, int(rnd.random() < 0.5)) for f in (0, 1) for _ in range(200)]
    data = [(f, y, [rnd.gauss(1 - 2 * y, 1.0), rnd.gauss(2 * y - 1, 0.3)]) for f, y in rows]
    got = calibrate.fit_sigmoids(spark.createDataFrame(data, "fold int, label int, margins array<double>"), 2)
    assert set(got) == {(f, c) for f in (0, 1) for c in (0, 1)}
    for (f, c), (a, b) in got.items():
        mine = [(m[c], y == c) for g, y, m in data if g == f]
        pos = sum(y for _, y in mine)
        hi, lo = (pos + 1) / (pos + 2), 1 / (len(mine) - pos + 2)

        def loss(a, b):
            total = 0.0
            for m, y in mine:
                z, t = a * m + b, hi if y else lo
                total += t * z + math.log1p(math.exp(-z)) if z >= 0 else (t - 1) * z + math.log1p(math.exp(z))
            return total

        best = loss(a, b)
        assert all(best <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_few_passes_over_terms_of_unlike_weight(spark):
    """The number of passes does not follow how unlike the terms' curvatures are."""
    rnd = random.Random(9)
    rows = []
    for i in range(400):
        terms = sorted(rnd.sample(range(30), 12))
        rows.append((i % 3, int(sum(terms) % 2 if rnd.random() < 0.2 else terms[0] % 2), terms, [3.0 * 1.2 ** -t for t in terms]))
    table = spark.createDataFrame(rows, "fold int, label int, indices array<int>, values array<double>").coalesce(1)
    svm.fit_planes(table, [(0, 1), (1, 1)], 30, max_passes=40)


def test_blocks_keep_every_row(spark, monkeypatch):
    rows, table = sparse_rows(spark, 70, 2, 8)
    made = svm.blocked(table).collect()
    assert sum(len(r["folds"]) // 4 for r in made) == 70
    assert sum(len(r["terms"]) // 4 for r in made) == sum(len(x[2]) for x in rows)
    total = np.zeros((14, 2))
    for r in made:
        import pyarrow as pa

        block = svm._Block([pa.scalar(bytes(c), pa.binary()) for c in r])
        factors = np.stack([block.fold + 1.0, np.zeros(len(block.fold))], axis=1)
        block.add_outer(factors, total)
    want = np.zeros(14)
    for fold, _, terms, values in rows:
        for t, v in zip(terms, values):
            want[t] += (fold + 1) * v
    assert np.allclose(total[:, 0], want) and not total[:, 1].any()


def test_both_vocabularies_come_from_one_pass(corpus, monkeypatch):
    calls = []
    count = classify.grams.term_stats
    monkeypatch.setattr(classify.grams, "term_stats", lambda *a, **b: calls.append(a) or count(*a, **b))
    record, model = classify.train_and_evaluate(corpus, "id", "text", "cat")
    assert len(calls) == 1
    train, _ = classify.hold_out(corpus, "cat", "id")
    marked = corpus.join(train.select("id", F.lit(True).alias("own")), "id", "left")
    for made, docs in zip(classify.fit_terms_of_part(marked.withColumn("own", F.coalesce("own", F.lit(False))), "text", "own", 20), (train, corpus)):
        counter, idf = classify.fit_terms(docs, "id", "text", 20)
        assert dict(zip(made.counter.vocabulary, made.idf)) == dict(zip(counter.vocabulary, idf)) and len(idf) == 20


def test_a_good_start_saves_passes_and_ends_at_the_same_planes(spark, monkeypatch):
    _, table = sparse_rows(spark, 300, 4, 6)
    planes = [(f, c) for f in range(3) for c in range(4)]
    passes = []
    count = svm._summed
    monkeypatch.setattr(svm, "_summed", lambda *a: passes.append(a) or count(*a))
    weights, biases = svm.fit_planes(table, planes, 16)
    cold = len(passes)
    blocks = svm.materialise(svm.blocked(table), "blocks")
    start = np.column_stack([weights, biases])
    for near in (start, start * 1.01):
        passes.clear()
        again = svm.fit_blocks(blocks, planes, 16, start=near)
        assert len(passes) < cold
        # A plane is as far from the optimum as its gradient is long, at most.
        assert np.allclose(again[0], weights, atol=2e-2) and np.allclose(again[1], biases, atol=2e-2)
    assert np.allclose(svm.fit_blocks(blocks, planes, 16, start=-start)[0], weights, atol=2e-2)


def test_a_block_has_one_fold_and_its_entries_by_term(spark):
    for r in svm.blocked(sparse_rows(spark, 70, 2, 8)[1]).collect():
        assert len(set(np.frombuffer(r["folds"], np.int32))) == 1 and (np.diff(np.frombuffer(r["terms"], np.int32)) >= 0).all()
