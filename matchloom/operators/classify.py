"""TF-IDF and calibrated one-vs-rest linear SVM."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions import tokens
from matchloom.functions.text import guard_label, let
from matchloom.operators import grams, metrics, stratify, svm, tfidf
from matchloom.operators.calibrate import fit_sigmoids
from matchloom.sources.tables import materialise


@dataclass
class TextClassifier:
    """A fitted classifier: vocabulary with idf, one SVM per fold and class, one sigmoid for each of them."""

    counter: CountVectorizerModel
    idf: np.ndarray  # (terms,), in the order of the counter's vocabulary
    classes: list[str]
    coefficients: np.ndarray  # (folds, classes, terms)
    intercepts: np.ndarray  # (folds, classes)
    sigmoids: np.ndarray  # (folds, classes, 2)


def _lists(rows: np.ndarray) -> pa.Array:
    """(rows, width) as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def term_features(df: DataFrame, text: str, counter: CountVectorizerModel, idf: np.ndarray) -> DataFrame:
    """Adds the TF-IDF row of the text as `indices` and `values`. Words are cut by the JVM, counted and weighed as numbers, a batch at a time."""
    shared = df.sparkSession.sparkContext.broadcast((grams.Vocabulary(counter.vocabulary), idf))
    stop = grams.stop_array(None)

    def weigh(words: pa.Array) -> pa.Array:
        known, idf_of = shared.value
        ends, term, w = known.weights(words, stop, idf_of)
        offsets = pa.array(ends.astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(w))]
        return pa.StructArray.from_arrays(lists, ["indices", "values"])

    made = F.arrow_udf(weigh, "struct<indices:array<int>,values:array<double>>")(tokens.words(F.col(text)))
    return df.withColumn("_w", made).select(*df.columns, "_w.indices", "_w.values")


@dataclass
class Terms:
    """The vocabulary of a classifier."""

    counter: CountVectorizerModel
    idf: np.ndarray  # (terms,), in the order of the counter's vocabulary


def _terms(vocab: DataFrame, n_docs: int, max_features: int) -> Terms:
    vocab = materialise(vocab.select("term", tfidf.idf(F.lit(n_docs), F.col("df")).alias("idf")), "terms")
    # Fitted on the chosen terms alone, the counter knows exactly these; handing them over one by one is slow.
    counter = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=max_features).fit(vocab.select(F.array("term").alias("_grams")))
    idf = {r["term"]: r["idf"] for r in vocab.collect()}
    return Terms(counter, np.array([idf[t] for t in counter.vocabulary]))


def fit_terms(docs: DataFrame, key: str, text: str, max_features: int) -> tuple[CountVectorizerModel, np.ndarray]:
    """Vocabulary and idf; at most `max_features` rows reach the driver."""
    made = _terms(tfidf.largest_terms(grams.term_stats(docs, text), max_features), docs.count(), max_features)
    return made.counter, made.idf


def fit_terms_of_part(docs: DataFrame, text: str, part: str, max_features: int) -> tuple[Terms, Terms]:
    """The terms of the documents where `part` is true and of all, counted in one pass."""
    n_docs, n_part = docs.agg(F.count(F.lit(1)), F.count_if(part)).first()
    stats = materialise(grams.term_stats(docs, text, part=part), "term_stats")
    own = stats.where("n_part > 0").select("term", F.col("n_part").alias("n"), F.col("df_part").alias("df"))
    return _terms(tfidf.stored_largest_terms(own, max_features), n_part, max_features), _terms(tfidf.stored_largest_terms(stats, max_features), n_docs, max_features)


def fit(
    docs: DataFrame, key: str, text: str, category: str,
    max_features: int = V.MAX_FEATURES, n_folds: int = V.CALIBRATION_FOLDS, max_passes: int = svm.MAX_PASSES,
    terms: Terms | None = None, near: TextClassifier | None = None,
) -> TextClassifier:
    """Fits on all rows of `docs`: the vocabulary once, then the SVMs of all folds and classes together, then their sigmoids.

    `terms` is the vocabulary, if it is known. From the planes of `near`, a model of much the same rows, fewer passes lead
    to the planes, which are the same up to the fit's tolerance. The driver and each task hold folds x classes x terms numbers, a small multiple of them on the driver.
    """
    classes = [r[0] for r in docs.select(category).distinct().orderBy(category).collect()]
    if len(classes) < 2:
        raise ValueError("a classifier needs at least two categories")
    counter, idf = fit_terms(docs, key, text, max_features) if terms is None else (terms.counter, terms.idf)
    label = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(category)) - 1).cast("int")
    rows = term_features(docs.select(key, text, category), text, counter, idf).select(key, category, "indices", "values")
    ranked = stratify.shuffled_rank(rows, category, key)
    # Every pass is a job, and its tasks carry the lineage of their input: a written table has none.
    rows = ranked.select(stratify.fold(n_folds).alias("fold"), label.alias("label"), "indices", "values")
    blocks = materialise(svm.blocked(rows), "features")
    # Two classes are told apart by one hyperplane; its mirror image serves the other class.
    fitted = range(len(classes)) if len(classes) > 2 else [1]
    planes = [(f, c) for f in range(n_folds) for c in fitted]
    start = None if near is None or near.classes != classes or len(near.intercepts) != n_folds else np.stack([_carried(near, f, c, counter.vocabulary) for f, c in planes])
    weights, biases = svm.fit_blocks(blocks, planes, len(idf), max_passes, start)
    coefficients = np.zeros((n_folds, len(classes), len(idf)))
    intercepts = np.zeros((n_folds, len(classes)))
    for (f, c), w, b in zip(planes, weights, biases, strict=True):
        coefficients[f, c], intercepts[f, c] = w, b
    if len(classes) == 2:
        coefficients[:, 0], intercepts[:, 0] = -coefficients[:, 1], -intercepts[:, 1]

    margins = svm.held_out_margins(blocks, coefficients.reshape(-1, len(idf)), intercepts.ravel(), n_folds)
    ab = fit_sigmoids(margins, len(classes))
    sigmoids = np.array([[ab.get((f, c), (0.0, 0.0)) for c in range(len(classes))] for f in range(n_folds)])
    return TextClassifier(counter, idf, classes, coefficients, intercepts, sigmoids)


def _carried(model: TextClassifier, fold: int, c: int, vocabulary: list[str]) -> np.ndarray:
    """A plane of the model over another vocabulary, the bias last; terms that it does not know weigh nothing."""
    at = {t: i for i, t in enumerate(model.counter.vocabulary)}
    places = np.array([at.get(t, -1) for t in vocabulary])
    return np.append(np.where(places < 0, 0.0, model.coefficients[fold, c][places]), model.intercepts[fold, c])


def _by_term(coefficients: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, folds x classes) and (folds x classes,)."""
    return np.ascontiguousarray(coefficients.reshape(-1, coefficients.shape[-1]).T), intercepts.ravel()


def _probabilities(margins: Column, sigmoids: np.ndarray) -> Column:
    """Sigmoid of every margin, divided by their sum; equal shares where all of them vanish."""
    a, b = (F.array(*[F.lit(float(x)) for x in sigmoids[:, i]]) for i in (0, 1))
    z = F.transform(margins, lambda m, i: F.get(a, i) * m + F.get(b, i))
    raw = F.transform(z, lambda x: F.when(x > 700, F.lit(0.0)).otherwise(1 / (1 + F.exp(x))))

    def shares(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0.0), lambda s, x: s + x)
        return let(total, lambda t: F.transform(r, lambda x: F.when(t > 0, x / t).otherwise(F.lit(1 / len(sigmoids)))))

    return let(raw, shares)


def predict(model: TextClassifier, df: DataFrame, text: str) -> DataFrame:
    """Adds `probs` (array<struct<category, prob>>, high to low) and `predicted` ('Unknown' for blank text).

    The probabilities are those of the folds, averaged. The broadcast is folds x classes x terms numbers.
    """
    n_folds, n = model.intercepts.shape
    shared = df.sparkSession.sparkContext.broadcast((grams.Vocabulary(model.counter.vocabulary), model.idf, *_by_term(model.coefficients, model.intercepts)))
    stop = grams.stop_array(None)

    def margins(words: pa.Array) -> pa.Array:
        known, idf, weights, biases = shared.value
        ends, term, w = known.weights(words, stop, idf)
        offsets = pa.array(ends.astype(np.int32))
        return _lists(svm.margins(svm.Sparse(pa.ListArray.from_arrays(offsets, pa.array(term)), pa.ListArray.from_arrays(offsets, pa.array(w))), weights, biases))

    out = df.withColumn("_margins", F.arrow_udf(margins, "array<double>")(tokens.words(F.col(text))))
    out = out.withColumns({f"_p{f}": _probabilities(F.slice("_margins", f * n + 1, n), model.sigmoids[f]) for f in range(n_folds)})
    classes = F.array(*[F.lit(c) for c in model.classes])

    def mean(i: Column) -> Column:
        return reduce(lambda x, y: x + y, [F.get(F.col(f"_p{f}"), i) for f in range(n_folds)]) / n_folds

    entries = F.transform(classes, lambda c, i: F.struct(c.alias("category"), mean(i).alias("prob")))
    out = out.withColumn("probs", metrics.sorted_probs(entries)).drop("_margins", *[f"_p{f}" for f in range(n_folds)])
    best = F.get("probs", F.lit(0))["category"].cast("string")
    return out.withColumn("predicted", guard_label(F.col(text), best))


def _marked(docs: DataFrame, category: str, key: str) -> tuple[DataFrame, Column]:
    """The documents and whether one is held out. Only keys are ranked; texts stay where they are."""
    is_test = stratify.held_out_flag(docs, category, key)
    return docs.join(F.broadcast(is_test.bounds), docs[category].eqNullSafe(is_test.bounds["_category"]), "left"), is_test.flag


def hold_out(docs: DataFrame, category: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): the stratified split, exact per category."""
    marked, is_test = _marked(docs, category, key)
    return marked.where(~is_test).select(*docs.columns), marked.where(is_test).select(*docs.columns)


def train_and_evaluate(docs: DataFrame, key: str, text: str, category: str, max_features: int = V.MAX_FEATURES, **options) -> tuple[DataFrame, TextClassifier]:
    """(metrics record, model): held-out metrics of a model fitted on the train part, and one fitted on everything.

    Both vocabularies are counted in one pass, and the second fit begins at the planes of the first.
    """
    marked, is_test = _marked(docs, category, key)
    marked = marked.select(*docs.columns, (~is_test).alias("_train"))
    train, test = (marked.where(c).select(*docs.columns) for c in ("_train", "NOT _train"))
    of_train, of_all = fit_terms_of_part(marked, text, "_train", max_features)
    model = fit(train, key, text, category, max_features, terms=of_train, **options)
    # Stored, since each rate would predict the rows again.
    scored = materialise(predict(model, test, text).select(category, "predicted", "probs"), "scored")
    record = metrics.metrics_record(docs, category, scored, category, "predicted", "probs")
    return record, fit(docs, key, text, category, max_features, terms=of_all, near=model, **options)


def save(model: TextClassifier, spark: SparkSession, folder: str) -> None:
    """The counter as a Spark ML model, and one row per fold and class; what was there is replaced."""
    folder = folder.rstrip("/")
    model.counter.write().overwrite().save(f"{folder}/counter")
    spark.createDataFrame([(model.idf.tolist(),)], "idf array<double>").write.mode("overwrite").parquet(f"{folder}/idf")
    rows = [
        (f, c, str(name), float(model.intercepts[f, c]), *map(float, model.sigmoids[f, c]), model.coefficients[f, c].tolist())
        for f in range(len(model.intercepts)) for c, name in enumerate(model.classes)
    ]
    schema = "fold int, c int, category string, intercept double, a double, b double, coefficients array<double>"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/planes")


def load(spark: SparkSession, folder: str) -> TextClassifier:
    folder = folder.rstrip("/")
    try:
        rows = spark.read.parquet(f"{folder}/planes").orderBy("fold", "c").collect()
    except AnalysisException as e:
        raise FileNotFoundError(f"no trained model in {folder}: train one first") from e
    counter = CountVectorizerModel.load(f"{folder}/counter")
    idf = np.array(spark.read.parquet(f"{folder}/idf").first()["idf"])
    classes = [r["category"] for r in rows if r["fold"] == 0]
    shape = (len(rows) // len(classes), len(classes))
    return TextClassifier(
        counter, idf, classes,
        np.array([r["coefficients"] for r in rows]).reshape(*shape, len(idf)),
        np.array([r["intercept"] for r in rows]).reshape(shape),
        np.array([(r["a"], r["b"]) for r in rows]).reshape(*shape, 2),
    )
