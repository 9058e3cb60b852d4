"""Fitted models. SQL cannot fit them, but it can say what must hold for them: sizes, a quality floor, shape and persistence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.operators import classify
from matchloom.plans import views
from matchloom.plans.corpus_queries import DEDUP_SQL, SPLIT_SQL, corpus
from matchloom.plans.registry import query
from matchloom.sources import tables


#: What a language classifier of the corpus must reach on held-out documents.
FLOOR = 0.9


def _held_out_predictions(spark, sf_dir):
    train, test = classify.hold_out(corpus(spark, sf_dir), "lang", "doc_id")
    return classify.predict(classify.fit(train, "doc_id", "text", "lang"), test, "text").select("doc_id", "lang", "predicted")


@query("svm_predict")
def svm_predict(spark, sf_dir):
    """Language of the held-out documents, by a model that has not seen them."""
    return _held_out_predictions(spark, sf_dir)


@query(
    "svm_predict_floor",
    f"SELECT lang, count(*) AS n_test, true AS all_known, true AS floor_reached FROM ({SPLIT_SQL}) WHERE is_test GROUP BY lang",
)
def svm_predict_floor(spark, sf_dir):
    """svm_predict by language: all held-out documents are there, each with one of the languages, and of all of them nearly all with their own."""
    known = [r[0] for r in corpus(spark, sf_dir).select("lang").distinct().collect()]
    hit = F.count_if(F.col("lang") == F.col("predicted"))
    by_language = _held_out_predictions(spark, sf_dir).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_test"), F.bool_and(F.col("predicted").isin(known)).alias("all_known"), hit.alias("hits"))
    every = Window.partitionBy()
    return by_language.withColumn("floor_reached", F.sum("hits").over(every) >= FLOOR * F.sum("n_test").over(every)).drop("hits")


@query("svm_probs")
def svm_probs(spark, sf_dir):
    """Probability of either quality class for every labelled document."""
    labels = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
    scored = classify.predict(classify.fit(docs, "doc_id", "text", "quality"), docs, "text")
    long = scored.select("doc_id", "quality", F.posexplode("probs").alias("at", "p"))
    return long.select("doc_id", "quality", (F.col("at") + 1).alias("rank"), "p.category", F.round("p.prob", 6).alias("prob"))


@query("model_roundtrip", f"SELECT doc_id, true AS same FROM ({DEDUP_SQL})")
def model_roundtrip(spark, sf_dir):
    """Whether a saved and reloaded model predicts the same, with the same probabilities, for each document."""
    docs = corpus(spark, sf_dir)
    folder = tables.scratch_folder(spark, "model")
    model = classify.fit(docs, "doc_id", "text", "lang")
    classify.save(model, spark, folder)
    before = classify.predict(model, docs, "text").withColumnsRenamed({"probs": "old_probs", "predicted": "old"})
    after = classify.predict(classify.load(spark, folder), before, "text")
    return after.select("doc_id", (F.col("probs").eqNullSafe(F.col("old_probs")) & F.col("predicted").eqNullSafe(F.col("old"))).alias("same"))


@query(
    "train_record",
    f"SELECT count(*) AS n_resumes, count(DISTINCT lang) AS n_categories, true AS top1_reached, true AS top3_reached, true AS f1_reached FROM ({DEDUP_SQL})",
)
def train_record(spark, sf_dir):
    """The training run: split, fit, held-out rates, refit on everything."""
    record, _ = classify.train_and_evaluate(corpus(spark, sf_dir), "doc_id", "text", "lang")
    rates = {"top1_reached": "holdout_top1_accuracy", "top3_reached": "holdout_top3_accuracy", "f1_reached": "holdout_macro_f1"}
    return record.select("n_resumes", "n_categories", *[(F.col(c) >= FLOOR).alias(a) for a, c in rates.items()])


@query(
    "predict_shape",
    f"""SELECT doc_id, blank, cast(2 AS bigint) AS n_classes, true AS sums_to_one, true AS falling, CASE WHEN blank THEN '{V.UNKNOWN_CATEGORY}' END AS label_of_blank
    FROM (SELECT d.doc_id, d.doc_id % 10 = 0 AS blank FROM documents d JOIN labels l ON l.doc_id = d.doc_id)""",
)
def predict_shape(spark, sf_dir):
    """For every labelled document, one in ten with its text blanked: classes, sum and order of the probabilities, and the label of a blank text."""
    labels = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
    model = classify.fit(docs, "doc_id", "text", "quality")
    blank = F.col("doc_id") % 10 == 0
    scored = classify.predict(model, docs.withColumn("text", F.when(blank, "  ").otherwise(F.col("text"))), "text")
    prob = F.transform("probs", lambda p: p["prob"])
    total = F.aggregate(prob, F.lit(0.0), lambda s, x: s + x)
    return scored.select(
        "doc_id", blank.alias("blank"), F.size("probs").cast("bigint").alias("n_classes"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        prob.eqNullSafe(F.sort_array(prob, asc=False)).alias("falling"), F.when(blank, F.col("predicted")).alias("label_of_blank"))
