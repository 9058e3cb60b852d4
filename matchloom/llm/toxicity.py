"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.tables import stored

#: Labelled rows that the trees and the calibration learn from, at most: the fit's bounded sample, chosen by hash.
FIT_ROWS = 40_000
#: Labelled texts whose words make up the learned lexicon, at most.
LEXICON_ROWS = 20_000
#: Words of the learned lexicon, at most, and in how many toxic texts of the sample a word must stand.
LEXICON_WORDS, LEXICON_TEXTS = 1000, 12
#: Beginnings of words, of so many letters, are entries too, with a caret before them: insults are inflected.
STEMS = (3, 4, 5)
#: A word enters the lexicon when its share of toxic texts is so many times its share of others.
LEXICON_RATIO = 8.0

#: Fixed lists: common English insults and second-person words, also of German, French and Spanish.
INSULTS = (
    "asshole bastard bitch bloody bullshit clown coward crap creep cretin damn dickhead disgusting douchebag dumb dumbass "
    "fool freak fuck fucking garbage hate idiot ignorant imbecile jackass jerk kill liar loser lunatic moron moronic "
    "nasty pathetic pig prick retard scum scumbag shit shut sick slut stupid suck sucks trash ugly useless vermin vile whore worthless "
    "arschloch dumm idiotin schlampe scheisse scheiße connard débile imbécile merde salope cabron cabrón estúpido idiota imbécil mierda puta"
).split()
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()

#: Digits and signs that stand for letters in disguised words.
_PLAIN = str.maketrans("013457@$!€", "oieastasie")
_TOKEN = re.compile(r"[^\W_]+(?:[@$!*€#_.\-][^\W_]+)*|[^\w\s]+")
_DISGUISED = re.compile(r"[a-z]+[013457@$!*#€]+[a-z]+", re.I)
_SPELLED = re.compile(r"\b(?:[a-z][ .\-_*]){3,}[a-z]\b", re.I)
_LONG_RUN = re.compile(r"(.)\1{2,}")

FEATURES = [
    "insults", "insult_density", "insult_kinds", "learned", "learned_density", "learned_weight", "disguised_insults", "near_second",
    "second_density", "capital_share", "capital_words", "exclaims", "questions", "punctuation", "disguised_rate", "spelled", "runs", "log_words", "word_length",
]


def heads(learned: dict[str, float]) -> frozenset[str]:
    """What a word must begin with for a stem of the lexicon to fit."""
    return frozenset(x[1 : 1 + STEMS[0]] for x in learned if x[0] == "^")


def weight(word: str, learned: dict[str, float], stems: frozenset[str]) -> float:
    """The greatest log ratio of a word and its beginnings in the learned lexicon, or 0."""
    own = learned.get(word, 0.0)
    return max([own, *(learned.get("^" + word[:k], 0.0) for k in STEMS)]) if word[: STEMS[0]] in stems else own


def features(text: str, learned: dict[str, float], stems: frozenset[str]) -> list[float]:
    """The dense features of one text, FEATURES in order; all 0 for an empty one."""
    tokens = _TOKEN.findall(text)
    words = [t for t in tokens if t[0].isalnum()]
    lower = [w.lower() for w in words]
    n = max(1, len(words))
    hits = [i for i, w in enumerate(lower) if w in _INSULTS]
    told = [x for w in lower if (x := weight(w, learned, stems)) > 0]
    second = [i for i, w in enumerate(lower) if w in _SECOND]
    disguised, hidden = 0, 0
    for i, w in enumerate(lower):
        if not w.isalpha() and _DISGUISED.search(w):
            disguised += 1
            bare = re.sub(r"[^\w]|_", "", w.translate(_PLAIN))
            if bare in _INSULTS or learned.get(bare, 0) > 0 or bare.replace("*", "") in _INSULTS:
                hidden += 1
                hits.append(i)
    spelled = _SPELLED.findall(text)
    for m in _SPELLED.finditer(text) if spelled else ():
        bare = re.sub(r"[^a-z]", "", m.group().lower())
        if bare in _INSULTS or bare in learned:
            hidden += 1
    near = 0
    if hits and second:
        at, places = np.array(second), np.array(hits)
        after = np.searchsorted(at, places)
        gap = np.minimum(np.abs(at[np.minimum(after, len(at) - 1)] - places), np.abs(at[np.maximum(after - 1, 0)] - places))
        near = int((gap <= 5).sum())
    marks = "".join(t for t in tokens if not t[0].isalnum())
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, text)) if letters else 0
    return [
        float(len(hits)), 100.0 * len(hits) / n, float(len({lower[i] for i in hits})), float(len(told)), 100.0 * len(told) / n, sum(told), float(hidden), float(near),
        100.0 * len(second) / n, upper / max(1, letters), sum(w.isupper() and len(w) > 1 for w in words) / n, 100.0 * marks.count("!") / n, 100.0 * marks.count("?") / n,
        len(marks) / max(1, len(text)), 100.0 * disguised / n, float(len(spelled)), float(len(_LONG_RUN.findall(text)) / n), float(np.log1p(len(words))), letters / n,
    ]


_INSULTS, _SECOND = frozenset(INSULTS), frozenset(SECOND_PERSON)


def held_out(key: Column) -> Column:
    """Documents that teach nothing: a fifth, by crc32 of the id as text. A null id is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _some(labelled: DataFrame, rows: int) -> DataFrame:
    """About `rows` labelled documents at most, chosen by a hash of the id, so that reruns agree."""
    n = labelled.count()
    return labelled if n <= rows else labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def learn_lexicon(docs: DataFrame, labelled: DataFrame) -> dict[str, float]:
    """docs(doc_id, text), labelled(doc_id, toxic) -> word -> log ratio, from at most LEXICON_ROWS texts.

    The sample of labels is bounded, so it is broadcast and no text is shuffled.
    """
    some = F.broadcast(_some(labelled, LEXICON_ROWS))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,30})"), F.lit(1)))
    stems = [F.transform(F.filter("words", lambda w, k=k: F.length(w) >= k), lambda w, k=k: F.concat(F.lit("^"), F.substring(w, 1, k))) for k in STEMS]
    words = docs.join(some, "doc_id").select("toxic", found.alias("words"))
    words = words.select("toxic", F.explode(F.array_distinct(F.concat("words", *stems))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    total = some.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    if not total["bad"] or not total["good"]:
        return {}
    ratio = (F.col("bad") / float(total["bad"])) / ((F.col("good") + 0.5) / float(total["good"]))
    found = counts.where(F.col("bad") >= LEXICON_TEXTS).withColumn("ratio", ratio).where(F.col("ratio") >= LEXICON_RATIO)
    top = found.orderBy(F.desc(F.col("bad") * F.log("ratio")), "word").limit(LEXICON_WORDS).collect()
    return {r["word"]: float(np.log(r["ratio"])) for r in top}


def feature_table(docs: DataFrame, learned: dict[str, float]) -> DataFrame:
    """docs(doc_id, text) -> stored (doc_id, one column a feature), one row per row, from whole texts, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = shared.value, heads(shared.value)
        for batch in batches:
            x = np.array([features(t.as_py() or "", words, stems) for t in batch.column(1)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["doc_id", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES)), "toxic_features")


def fit(table: DataFrame, labelled: DataFrame) -> tuple[GBTClassificationModel, IsotonicRegressionModel] | None:
    """Trees on three quarters of a bounded sample of labelled rows, calibration on the last quarter. None without both classes."""
    rows = stored(_vectors(table.join(F.broadcast(_some(labelled, FIT_ROWS)), "doc_id")).select("doc_id", "features", F.col("toxic").cast("double").alias("label")), "toxic_fit")
    part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4))
    train, check = rows.where(part > 0), rows.where(part == 0)
    if train.select("label").distinct().count() < 2 or not check.limit(1).count():
        return None
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=3, cacheNodeIds=False).fit(train)
    # Most clean texts have the same probability: equal ones become one weighted row before the fit deals rows out by it.
    scored = _probability(trees, check).groupBy("p").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    return trees, IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(scored)


def _vectors(table: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)


def _probability(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> (doc_id, held_out, score, predicted), one row per row of docs.

    Labels of held-out ids (crc32 of the id as text, mod 5 = 0) teach nothing; null labels and labels without a document
    neither; an id labelled several times counts by its greatest label. Scores come from the text alone. A null or
    empty text has the score of a text without any sign. Without labels of both classes all scores are the share of toxic labels, or 0.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = stored(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "toxic_labels")
    table = feature_table(rows, learn_lexicon(rows, known))
    model = fit(table, known)
    if model is None:
        share = known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        out = table.withColumn("score", F.lit(float(share)))
    else:
        trees, calibration = model
        out = calibration.transform(_probability(trees, _vectors(table))).withColumn("score", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
