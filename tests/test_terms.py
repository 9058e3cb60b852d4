"""Counting inside rows, the vocabulary's cut, weights, key phrases by slices, and evidence by blocks, each against a plain loop."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import tokens
from matchloom.operators import grams as coded_grams
from matchloom.operators import jaccard, keyphrases, matching, tfidf

RND = random.Random(6)
WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]


@pytest.fixture(scope="module")
def texts():
    made = {i: " ".join(RND.choices(WORDS, weights=[60 - k for k in range(60)], k=RND.randint(0, 40))) for i in range(50)}
    return made | {100: "", 101: None, 102: "waa " * 3000}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def grams(text):
    w = (text or "").split()
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def test_terms_are_counted_in_the_row(spark, docs, texts):
    got = {(r["id"], r["term"]): r["tf"] for r in tfidf.term_counts(docs, "id", "text", stop_words=[]).collect()}
    assert got == {(i, t): n for i, text in texts.items() for t, n in grams(text).items()}
    assert "Exchange" not in tfidf.term_counts(docs, "id", "text")._jdf.queryExecution().toString()
    empty = spark.createDataFrame([([],), (None,)], "a array<string>").select(tokens.counted(F.col("a")).alias("c")).collect()
    assert [r["c"] for r in empty][0] == []


@pytest.mark.parametrize("features", [1, 5, 40, 200, 100_000])
def test_vocabulary_cut(docs, texts, features):
    n, df = Counter(), Counter()
    for text in texts.values():
        n.update(grams(text))
        df.update(set(grams(text)))
    want = sorted(n, key=lambda t: (-n[t], t))[:features]
    vocab = tfidf.vocabulary(tfidf.term_counts(docs, "id", "text", stop_words=[]), features)
    assert "TakeOrdered" not in vocab._jdf.queryExecution().toString()
    assert {r["term"]: (r["n"], r["df"]) for r in vocab.collect()} == {t: (n[t], df[t]) for t in want}


def test_both_ways_of_weighing(spark, docs, texts, monkeypatch):
    vocab = tfidf.vocabulary(tfidf.term_counts(docs, "id", "text", stop_words=[]), 70)
    known = {r["term"]: math.log((len(texts) + 1) / (r["df"] + 1)) + 1 for r in vocab.collect()}
    want = {}
    for i, text in texts.items():
        w = {t: (1 + math.log(n)) * known[t] for t, n in grams(text).items() if t in known}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, t): x / norm for t, x in w.items()}
    for most in (tfidf.BROADCAST_TERMS, 0):
        monkeypatch.setattr(tfidf, "BROADCAST_TERMS", most)
        got = {(r["id"], r["term"]): r["w"] for r in tfidf.row_weights(docs, "id", "text", vocab, len(texts), 70, []).collect()}
        assert got == pytest.approx(want)


def test_phrases_do_not_depend_on_the_slices(docs, monkeypatch):
    whole = sorted(map(tuple, keyphrases.key_phrases(docs, "id", "text").collect()))
    terms = sorted(map(tuple, keyphrases.term_scores(docs, "id", "text").collect()))
    monkeypatch.setattr(keyphrases, "SLICE_WORDS", 25)
    assert sorted(map(tuple, keyphrases.key_phrases(docs, "id", "text").collect())) == whole and whole
    assert sorted(map(tuple, keyphrases.term_scores(docs, "id", "text").collect())) == terms
    assert {r[0] for r in whole} >= set(range(1, 20)) - {100, 101} or len({r[0] for r in whole}) > 30


def test_phrases_of_odd_texts(spark):
    odd = ["", None, "the of and", "12 4x4 9", "...", "é", "Word", "A. B. C!", "NASA x 3 NASA"]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, text string")
    got = keyphrases.key_phrases(df, "id", "text").collect()
    assert {r["phrase"] for r in got if r["id"] == 6} == {"word"} and not [r for r in got if r["id"] in (0, 1, 2, 3, 4)]
    assert all(math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize("block", [3, 1024])
def test_evidence_by_blocks(spark, block):
    rng = np.random.default_rng(5)
    passages = [(f"p{i % 3}", i // 3, f"t{i}", rng.standard_normal(6).round(1).tolist()) for i in range(60)]
    pairs = [(f"r{i}", f"p{i % 4}", rng.standard_normal(6).round(1).tolist()) for i in range(24)]
    got = matching.evidence(
        spark.createDataFrame(pairs, "pair string, posting string, vec array<double>"),
        spark.createDataFrame(passages, "posting string, chunk_no int, text string, vec array<double>"), "pair", "posting", k=4, block_rows=block)
    for r in got.collect():
        _, posting, v = next(p for p in pairs if p[0] == r["pair"])
        own = sorted((-round(float(np.dot(v, x)), 6), c, t) for p, c, t, x in passages if p == posting)
        assert r["matched"] == [t for _, _, t in own[:4]]
    assert got.count() == len(pairs)


def test_low_thresholds_count_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 9)
    sets = {i: {RND.choice("abcdefghijklmnop") * 2 for _ in range(RND.randint(1, 9))} for i in range(40)}
    a = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items() if i < 25] + [(90, ""), (91, None)], "l long, text string")
    b = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items() if i >= 25] + [(92, "!!")], "r long, text string")
    got = {(x["l"], x["r"]): x["jaccard"] for x in jaccard.similar_pairs(a, b, "l", "r", 0.1).collect()}
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(25) for j in range(25, 40)}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.1})


@pytest.mark.parametrize("pairs", [True, False])
def test_stats_leave_the_batch_summed_up(docs, texts, pairs):
    n, df = Counter(), Counter()
    for text in texts.values():
        own = grams(text) if pairs else Counter({t: k for t, k in grams(text).items() if " " not in t})
        n.update(own)
        df.update(set(own))
    made = coded_grams.term_stats(docs.coalesce(1), "text", pairs, [])
    assert {r["term"]: (r["n"], r["df"]) for r in made.collect()} == {t: (n[t], df[t]) for t in n}
    assert "MapInArrow" in made._jdf.queryExecution().toString()


@pytest.mark.parametrize("size", [1, 30, 10_000])
def test_slices_of_rows_do_not_matter(texts, monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(coded_grams, "SLICE_WORDS", size)
    rows = [[w for w in (text or "").split()] for text in texts.values()]
    terms = ["waa", "wab", "waa waa", "waa wab", "nowhere", "wab nowhere"]
    row, term, tf = coded_grams.Vocabulary(terms).counts(pa.array(rows, pa.list_(pa.string())), coded_grams.stop_array(["wac"]))
    want = {}
    for i, words in enumerate(rows):
        words = [w for w in words if w != "wac"]
        for t, k in Counter(words + [" ".join(p) for p in zip(words, words[1:])]).items():
            if t in terms:
                want[i, terms.index(t)] = k
    assert {(i, t): k for i, t, k in zip(row.tolist(), term.tolist(), tf.tolist(), strict=True)} == want and len(want) > 3


def test_slices_of_phrases_stay_small():
    import pyarrow as pa

    word = pa.struct([("term", pa.string()), ("shape", pa.int8())])
    docs = pa.array([[[[{"term": "word", "shape": 0}] * 1000]]] * 150, pa.list_(pa.list_(pa.list_(word))))
    seen = []

    def work(part):
        seen.append(1000 * len(part))
        return pa.array([None] * len(part), pa.string())

    assert len(keyphrases._by_slices(docs, work)) == 150 and max(seen) <= 100_000 and sum(seen) == 150_000


def plain_distance(a, b):
    above = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(above[j - 1] + (c != d), above[j] + 1, row[-1] + 1))
        above = row
    return above[-1]


def test_edit_distances_and_how_many_edits_are_alike():
    made = ["".join(RND.choices("ab c", k=RND.randint(1, 30))) for _ in range(40)]
    made += ["".join(c if RND.random() < 0.93 else RND.choice(["", "x", c + "y"]) for c in m) for m in made]
    for a in made:
        for b in made:
            d = plain_distance(a, b)
            assert [keyphrases._within(a, b, m) for m in range(-1, 5)] == [d <= m for m in range(-1, 5)]
    for limit in (0.9, 0.5, 0.0, 1.0, -0.5):
        most = keyphrases._edits(limit)
        for n in range(1, 80):
            assert most(n) == max((m for m in range(n + 1) if 1 - m / n > limit), default=-1)


@pytest.mark.parametrize(("k", "limit"), [(20, 0.9), (3, 0.5), (200, 0.7)])
def test_best_phrases_are_the_fold_of_all_candidates(spark, k, limit):
    near = [f"{a}{b}" for a in ("network", "networks", "netwerk", "planning", "plannings", "Signal", "signals", "SIGNAL") for b in ("", "ed", "s")]
    texts = {i: " ".join(w + RND.choice(["", "", "", ",", ". ", "! ", "\n"]) for w in RND.choices(near + ["the", "of", "x1"], k=RND.randint(0, 120))) for i in range(30)}
    df = spark.createDataFrame([*texts.items(), (90, None), (91, "...")], "id long, text string").coalesce(2)
    rounded = F.transform(keyphrases.candidates(F.col("text")), lambda c: F.struct(F.round(c["score"], 9).alias("score"), c["phrase"].alias("phrase")))
    want = set()
    for r in df.select("id", F.sort_array(rounded).alias("c")).collect():
        kept = []
        for score, phrase in r["c"]:
            if len(kept) < k and all(not 1 - plain_distance(phrase, o) / max(len(phrase), len(o)) > limit for _, o in kept):
                kept.append((score, phrase))
        want |= {(r["id"], i + 1, p, s) for i, (s, p) in enumerate(kept)}
    found = keyphrases.key_phrases(df, "id", "text", k=k, limit=limit)
    assert set(map(tuple, found.collect())) == want and want
    # Candidates do not come back from Python to be compared one by one.
    plan = found._jdf.queryExecution().toString()
    assert "levenshtein" not in plan and "aggregate(" not in plan


def test_words_are_spelled_as_spark_spells_them(spark):
    odd = "é É ÉÉ Éa ǅ ǅa ß İ Σ ΑΣ ΑΣΑ ʰ ª Ⅷ ⅷ ² a² ٣ _ _A A_ A_B aB Ab AB ab 中 中A A中 𝐀 𝐀𝐁 𝟘 1 A1 ﬁ Ⓐ ŉ".split()
    w = F.col("w")
    kinds = F.when(F.rlike(w, F.lit(keyphrases.ACRONYM)), 2).when(F.rlike(w, F.lit(keyphrases.CAPITAL)), 1).otherwise(0)
    rows = spark.createDataFrame([(w,) for w in odd], "w string").where(F.rlike(w, F.lit(rf"^{keyphrases.WORD}$")))
    for r in rows.select("w", F.when(~F.rlike(w, F.lit(keyphrases.HAS_DIGIT)), F.lower(w)).alias("term"), kinds.alias("kind")).collect():
        assert keyphrases._spelling(r["w"]) == (r["term"], r["kind"]), r["w"]
    values = [0.0, 5e-10, 1.5e-9, 2.5e-9, -5e-10, 0.1234567885, 0.12345678949999999, 1 / 3, 1e15 + 0.3, 1e300, float("inf"), -float("inf")] + [RND.random() * 10.0**-e for e in range(12)]
    want = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 9)).collect()
    assert keyphrases._rounded(np.array(values)).tolist() == [r[0] for r in want]


def test_sentences_and_runs():
    import pyarrow as pa

    # as _tokens() cuts 'One two, three.  Two "x1" B\n\n... last'
    tokens = ["One", "two", "", "three", ".  ", "Two", "", "x1", "", "B", "\n\n", "... ", "last"]
    x = keyphrases._words(pa.array([[], tokens, ["", ". "], ["One"]], pa.list_(pa.string())), frozenset())
    assert x.doc.tolist() == [1, 1, 1, 1, 1, 1, 1, 3] and x.sentences.tolist() == [0, 3, 0, 1]
    assert x.sentence.tolist() == [0, 0, 0, 1, 1, 1, 2, 0] and x.opens.tolist() == [True, False, False, True, False, False, True, True]
    assert [int(r) for r in np.diff(x.run)] == [0, 1, 1, 1, 1, 1, 1]
    assert [x.terms[t].as_py() if t >= 0 else None for t in x.term.tolist()] == ["one", "two", "three", "two", None, "b", "last", "one"]


def test_cut_of_texts(spark):
    text = 'One two, three.  Two "x1" B\n\n... last?!'
    got = spark.createDataFrame([(text,), (None,)], "t string").select(keyphrases._tokens(F.col("t"))).collect()
    assert got[0][0] == ["One", "two", "", "three", ".  ", "Two", "", "x1", "", "B", "\n\n", "... ", "last", "", ""] and got[1][0] == []


def test_counts_of_a_part(spark):
    from matchloom.operators import grams

    rows = [(i, "alpha beta " * (i % 3) + "gamma delta", [True, False, None][i % 3]) for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, text string, own boolean")
    got = {r["term"]: tuple(r)[1:] for r in grams.term_stats(docs, "text", part="own").collect()}
    every = {r["term"]: tuple(r)[1:] for r in grams.term_stats(docs, "text").collect()}
    part = {r["term"]: tuple(r)[1:] for r in grams.term_stats(docs.where("own"), "text").collect()}
    assert got == {t: x + part.get(t, (0, 0)) for t, x in every.items()}
