"""Operators on small fixtures, against plain brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import dedup, embedding, jaccard, keyphrases, matching, metrics, pages, pairwise, screening, stratify, tfidf
from matchloom.plans.screen_queries import chunk_key


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    left = rng.normal(size=(53, 8)).round(3)
    right = np.vstack([rng.normal(size=(30, 8)).round(3), left[:11], left[:11]])  # exact ties
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(left)], "q long, vec array<double>")
    b = spark.createDataFrame([(f"p{i:02d}", "ab"[i % 2], v.tolist()) for i, v in enumerate(right)], "p string, role string, vec array<double>")
    return left, right, a, b


@pytest.mark.parametrize("block_rows", [5, 16, 1024])
def test_every_pair_in_every_grid(vectors, block_rows):
    left, right, a, b = vectors
    got = {(r["q"], r["p"]): r["score"] for r in pairwise.pair_scores(a, b, "q", "p", block_rows=block_rows).collect()}
    assert len(got) == len(left) * len(right)
    for i, j in itertools.product(range(len(left)), range(len(right))):
        assert got[i, f"p{j:02d}"] == pytest.approx(left[i] @ right[j], abs=1e-6)


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_top_k_with_ties(vectors, block_rows):
    left, right, a, b = vectors
    hits = matching.retrieve(a, b, "q", "p", k=3, block_rows=block_rows).collect()
    got = {}
    for r in hits:
        got.setdefault(r["q"], {})[r["rank"]] = r["p"]
    for i in range(len(left)):
        order = sorted(range(len(right)), key=lambda j: (-round(float(left[i] @ right[j]), 6), f"p{j:02d}"))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [f"p{j:02d}" for j in order]


def test_role_filter_comes_after_the_cut(spark):
    q = spark.createDataFrame([(1, "x", [1.0, 0.0])], "q long, own string, vec array<double>")
    rows = [(i, "y", [1.0 - i / 10, 0.0]) for i in range(4)] + [(4, "x", [0.1, 0.0])]
    p = spark.createDataFrame(rows, "p long, role string, vec array<double>")
    assert matching.retrieve(q, p, "q", "p", k=1, role="role", query_role="own").count() == 0


def test_unscored_resume_keeps_an_empty_map(spark):
    r = spark.createDataFrame([("a", [1.0]), ("b", None)], "resume string, vec array<double>")
    j = matching.last_of_name(spark.createDataFrame([("j", 0, [0.0]), ("j", 1, [0.12345])], "job string, at int, vec array<double>"), "job", "at")
    maps = matching.score_map(r, matching.score_matrix(r, j, "resume", "job"), "resume", "job")
    assert {x["resume"]: x["scores"] for x in maps.collect()} == {"a": {"j": 0.123}, "b": {}}


def test_first_row_needs_two(spark):
    rows = [("g", 0, [1.0, 0.0]), ("g", 1, [0.6, 0.8]), ("h", 0, [1.0, 0.0])]
    got = matching.first_row_similarity(spark.createDataFrame(rows, "g string, at int, vec array<double>"), "g", "at").collect()
    assert {(r["g"], r["at"]): r["score"] for r in got} == {("g", 0): 1.0, ("g", 1): 0.6, ("h", 0): None}


def test_evidence_stays_in_the_posting(spark):
    pairs = spark.createDataFrame([("r1", "p1", [1.0, 0.0]), ("r2", "p9", [1.0, 0.0])], "pair string, posting string, vec array<double>")
    rows = [("p1", 1, "low", [0.1, 0.0]), ("p1", 2, "tie b", [0.9, 0.0]), ("p1", 3, "tie c", [0.9, 0.0]), ("p2", 1, "other", [1.0, 0.0])]
    passages = spark.createDataFrame(rows, "posting string, chunk_no int, text string, vec array<double>")
    got = {r["pair"]: r["matched"] for r in matching.evidence(pairs, passages, "pair", "posting", k=2).collect()}
    assert got == {"r1": ["tie b", "tie c"], "r2": []}


def test_user_encoder_is_normalised(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "")], "id int, text string")
    got = embedding.encoded(df, "text", lambda: lambda ts: np.array([[len(t), 0.0] for t in ts])).collect()
    assert {r["id"]: r["vec"] for r in got} == {1: [1.0, 0.0], 2: [0.0, 0.0]}


def test_vectors_from_a_table(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id int")
    table = spark.createDataFrame([(1, [3.0, 4.0])], "id int, vec array<double>")
    got = {r["id"]: r["vec"] for r in embedding.from_table(docs, table, "id").collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] is None


def test_hot_group_and_group_without_item_zero(spark):
    rows = [("hot", i, [1.0, 0.0]) for i in range(300)] + [("late", 1, [1.0, 0.0]), ("late", 2, [0.0, 1.0]), ("one", 0, [1.0, 0.0])]
    items = spark.createDataFrame(rows, "g string, at int, vec array<double>")
    got = {(r["g"], r["at"]): r["score"] for r in matching.first_row_similarity(items, "g", "at").collect()}
    assert len(got) == 303 and all(got["hot", i] == 1.0 for i in range(300))
    assert got["late", 1] is None and got["late", 2] is None and got["one", 0] is None


def test_passage_keys_of_long_postings_differ(spark):
    rows = spark.createDataFrame([(1, 100_000), (2, 0), (2, 100_001), (3, 1)], "item_id long, chunk_no long")
    keys = [r[0] for r in rows.orderBy("item_id", "chunk_no").select(chunk_key()).collect()]
    assert len(set(keys)) == 4 and keys == sorted(keys)


def test_keep_first(spark):
    rows = [(3, "a", "x"), (1, "a", "y"), (2, "b", "z"), (4, None, "w")]
    df = dedup.drop_incomplete(spark.createDataFrame(rows, "id long, text string, cat string"))
    got = dedup.keep_first(df, "text", "id").collect()
    assert {(r["id"], r["text"], r["cat"]) for r in got} == {(1, "a", "y"), (2, "b", "z")}


def test_shuffled_rank_is_a_permutation_per_category(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("cat"))
    got = stratify.shuffled_rank(df, "cat", "id").withColumns({"test": stratify.held_out(), "fold": stratify.fold()}).collect()
    for cat, n in (("hot", 900), ("cold", 100)):
        mine = [r for r in got if r["cat"] == cat]
        assert sorted(r["rank"] for r in mine) == list(range(1, n + 1))
        assert sum(r["test"] for r in mine) == n // 5
        assert {sum(r["fold"] == f for r in mine) for f in range(3)} <= {n // 3, n // 3 + 1}


def brute_tfidf(texts, max_features):
    from matchloom import fixed_values as V
    import re

    def grams(t):
        ws = [w for w in re.findall(r"\w{2,}", t.lower()) if w not in V.ENGLISH_STOP_WORDS]
        return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]

    docs = [grams(t) for t in texts]
    total = {}
    for d in docs:
        for g in d:
            total[g] = total.get(g, 0) + 1
    vocab = sorted(total, key=lambda g: (-total[g], g))[:max_features]
    out = []
    for d in docs:
        w = {g: (1 + math.log(d.count(g))) * (math.log((1 + len(docs)) / (1 + sum(g in e for e in docs))) + 1) for g in vocab if g in d}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({g: x / norm for g, x in w.items()})
    return out


def test_tfidf(spark):
    texts = ["red fox red dog", "blue fox", "the of and", "dog dog dog blue red fox"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in tfidf.fit_transform(df, "id", "text", max_features=7).collect():
        got.setdefault(r["id"], {})[r["term"]] = r["w"]
    for i, want in enumerate(brute_tfidf(texts, 7)):
        assert got.get(i, {}) == pytest.approx(want)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_similar_pairs_exactly(spark, threshold):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    make = lambda n: [" ".join(rnd.choices(words, weights=range(1, 26), k=rnd.randint(1, 9))) for _ in range(n)]
    left, right = make(60), make(40)
    left += left[:5] * 4  # a hot group of copies
    right += left[:3] + [""]
    a = spark.createDataFrame(list(enumerate(left)), "l long, text string")
    b = spark.createDataFrame(list(enumerate(right)), "r long, text string")
    got = {(x["l"], x["r"]): x["jaccard"] for x in jaccard.similar_pairs(a, b, "l", "r", threshold).collect()}
    want = {}
    for (i, s), (j, t) in itertools.product(enumerate(left), enumerate(right)):
        x, y = set(s.split()), set(t.split())
        if x and y and len(x & y) / len(x | y) >= threshold:
            want[i, j] = len(x & y) / len(x | y)
    assert got == pytest.approx(want)


def test_report_of_a_class_never_predicted(spark):
    rows = [("a", "a"), ("a", "a"), ("b", "a"), ("c", "c")]
    got = {r["category"]: r for r in metrics.class_report(spark.createDataFrame(rows, "y string, p string"), "y", "p").collect()}
    assert tuple(got["b"])[1:] == (0.0, 0.0, 0.0, 1)
    assert got["a"]["precision"] == pytest.approx(2 / 3) and got["a"]["f1"] == pytest.approx(0.8)
    assert got["accuracy"]["f1"] == 0.75 and got["macro avg"]["f1"] == pytest.approx(0.6) and got["weighted avg"]["support"] == 4


def test_page_choice(spark):
    rows = [
        (1, 1, 3, "a b"), (1, 1, 2, "a b c d"), (1, 2, 3, "ab"), (1, 2, 2, "abc"), (1, 2, 1, "abcd"), (1, 3, 3, "abcd"), (1, 3, 2, "ab cd"), (1, 3, 1, "a b c d"),
        (2, 1, 3, ""),
    ]
    picked = pages.pick_page_text(spark.createDataFrame(rows, "doc_id int, page_no int, x_tol int, text string"))
    assert {(r["doc_id"], r["page_no"]): r["text"] for r in picked.collect()} == {(1, 1): "a b", (1, 2): "ab", (1, 3): "a b c d", (2, 1): ""}
    assert {r["doc_id"]: r["text"] for r in pages.assemble_pages(picked).collect()} == {1: "a b\nab\na b c d\n", 2: ""}


def test_reply_states(spark):
    prompts = spark.createDataFrame([(i, ["m"] if i != 4 else [], "R") for i in range(6)], "id int, matched array<string>, role string")
    rows = [(0, "ok", "SCORE: 80\nfine", None), (1, "rejected", None, None), (2, "failed", None, "boom"), (4, "ok", "", None), (5, "rate_limited", None, "slow")]
    joined = screening.join_replies(prompts, spark.createDataFrame(rows, "id int, status string, raw string, problem string"), "id")
    got = {r["id"]: r for r in screening.screen_result(joined).collect()}
    assert (got[0]["score"], got[0]["feedback"], got[0]["band"], got[0]["needs_key"]) == (80, "fine", "Strong match", False)
    assert got[1]["needs_key"] and got[1]["show_matched"] and "rejected" in got[1]["feedback"]
    assert got[2]["feedback"].endswith("boom") and got[3]["feedback"].startswith("Set ")
    assert (got[4]["score"], got[4]["show_feedback"], got[4]["show_matched"]) == (None, False, False)
    fit = {r["id"]: r["analysis"] for r in screening.fit_result(joined).collect()}
    assert fit[4] == "No indexed job requirements found for R." and "Rate limited" in fit[5] and fit[0] == "SCORE: 80\nfine"
    tailored = {r["id"]: r["tailored"] for r in screening.tailor_result(joined).collect()}
    assert tailored[3].startswith("Set ") and tailored[2].endswith("boom")


def brute_phrases(text, stop):
    """The published scoring, word by word."""
    import re
    import statistics

    sentences = [s for s in re.split(r"[.!?]+\s+|\n+", text) if re.search(r"\w", s)]
    runs = []
    for si, s in enumerate(sentences):
        for bi, b in enumerate(x for x in re.split(r"[^\w\s]+", s) if re.search(r"\w", x)):
            runs.append((si, bi == 0, re.findall(r"\w+", b)))
    low = lambda w: None if re.search(r"\d", w) else w.lower()
    info, links = {}, {}
    for si, leads, ws in runs:
        for i, w in enumerate(ws):
            t = low(w)
            if t is None:
                continue
            d = info.setdefault(t, dict(tf=0, a=0, n=0, s=set(), l=[], r=[]))
            d["tf"] += 1
            d["s"].add(si)
            acronym = w.isupper() and w.isalpha()
            d["a"] += acronym
            d["n"] += w[0].isupper() and not acronym and not (leads and i == 0)
            if i > 0 and low(ws[i - 1]):
                d["l"].append(low(ws[i - 1]))
            if i + 1 < len(ws) and low(ws[i + 1]):
                d["r"].append(low(ws[i + 1]))
                links[t, low(ws[i + 1])] = links.get((t, low(ws[i + 1])), 0) + 1
    is_stop = lambda t: t in stop or len(t) < 3
    tfs = [d["tf"] for t, d in info.items() if not is_stop(t)]
    mean, sd, top = statistics.mean(tfs), statistics.pstdev(tfs), max(d["tf"] for d in info.values())
    score = {}
    for t, d in info.items():
        share = lambda x: len(set(x)) / len(x) if x else 0.0
        rel = 1 + (share(d["l"]) + share(d["r"])) * d["tf"] / top
        case = max(d["a"], d["n"]) / (1 + math.log(d["tf"]))
        pos = math.log(math.log(3 + statistics.median(d["s"])))
        score[t] = rel * pos / (case + d["tf"] / (mean + sd) / rel + len(d["s"]) / len(sentences) / rel)
    kf = {}
    for _, _, ws in runs:
        ts = [low(w) for w in ws]
        for n in (1, 2, 3):
            for i in range(len(ts) - n + 1):
                c = ts[i:i + n]
                if None not in c and not is_stop(c[0]) and not is_stop(c[-1]):
                    kf[tuple(c)] = kf.get(tuple(c), 0) + 1
    out = {}
    for c, n in kf.items():
        p, s = 1.0, 0.0
        for i, t in enumerate(c):
            if is_stop(t):
                loose = 1 - links[c[i - 1], t] / info[c[i - 1]]["tf"] * links[t, c[i + 1]] / info[c[i + 1]]["tf"]
                p, s = p * (1 + loose), s - loose
            else:
                p, s = p * score[t], s + score[t]
        out[" ".join(c)] = p / (n * (1 + s))
    return out


def test_key_phrases(spark):
    text = (
        "Supervised learning is the task of learning a function. It maps an input to an output, based on input output pairs of data. "
        "A learning function of NASA data 4x4 infers the Function from labeled training data!\nTraining data of Spark and Spark data."
    )
    stop = ["is", "the", "of", "and", "from", "based", "its", "that"]
    df = spark.createDataFrame([(1, text)], "id long, text string")
    scored = df.select(F.inline(keyphrases.candidates(F.col("text"), stop_words=stop)))
    want = brute_phrases(text, stop)
    assert {r["phrase"]: r["score"] for r in scored.collect()} == pytest.approx(want)
    best = [r["phrase"] for r in keyphrases.key_phrases(df, "id", "text", k=5, stop_words=stop).orderBy("rank").collect()]
    assert best[0] == min(want, key=lambda p: (round(want[p], 9), p)) and len(best) == 5


def test_vectors_of_a_grid_are_never_shuffled(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    a = spark.createDataFrame(rows, "q long, vec array<double>")
    b = a.withColumnRenamed("q", "p")
    for top in (None, 3):
        made = pairwise.pair_scores(a, b, "q", "p", top=top, block_rows=8)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() >= 60 * (top or 60)


def test_a_stored_matrix_takes_less_than_its_scores(spark, tmp_path):
    x = np.random.default_rng(11).normal(size=(1200, 64))
    x = np.round(x / np.linalg.norm(x, axis=1)[:, None], 4)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").coalesce(1)
    matching.self_similarity(items, "id", block_rows=1100).write.parquet(f"{tmp_path}/m")
    made = spark.read.parquet(f"{tmp_path}/m")
    got = made.toPandas().sort_values(["a", "b"])
    assert (got[["a", "b"]].to_numpy() == np.stack(np.divmod(np.arange(1200**2), 1200), axis=1)).all()
    assert np.abs(got["score"].to_numpy() - (x @ x.T).ravel()).max() < 1e-6
    assert sum(f.stat().st_size for f in (tmp_path / "m").glob("*.parquet")) < 7 * 1200**2


@pytest.mark.parametrize("scores", [[0.5, -0.25, 0.5, -0.0, 1.0], [1e18, 0.0, -1e18], [np.nan, 1.0, -np.inf, 1.0], []])
def test_places_by_score(scores):
    s = np.array(scores, np.float64)
    assert pairwise._by_score(s, 6).tolist() == np.argsort(s, kind="stable").tolist()


def test_hits_of_a_left_row_grow_with_the_partitions_of_the_right_side_alone(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "q long, vec array<double>")
    made = pairwise.pair_scores(a, a.withColumnRenamed("q", "p"), "q", "p", top=2, block_rows=5)
    assert made.groupBy("q").count().agg(F.max("count")).first()[0] <= 2 * pairwise.TOP_PARTS


@pytest.mark.parametrize("copies", [1, 40])
def test_best_of_many_cells_with_ties(copies):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4)).round(2)
    y = np.repeat(rng.normal(size=(50, 4)).round(2), copies, axis=0)
    import pyarrow as pa

    best = pairwise.Best(pa.array(range(30)), x, 3, 6)
    for lo in range(0, len(y), 11):
        best.meet(pa.array(range(lo, min(lo + 11, len(y)))), y[lo : lo + 11])
    ids, scores, other = best.hits()
    got = [list(other[np.array(ids.to_pylist()) == i]) for i in range(30)]
    assert got == [sorted(range(len(y)), key=lambda j: (-round(float(x[i] @ y[j]), 6), j))[:3] for i in range(30)]
    assert len(scores) == 90
