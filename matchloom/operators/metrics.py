"""Classification metrics. All of them start from one partially aggregated count per (label, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as V


def sorted_probs(entries: Column) -> Column:
    """array<struct<category, prob>> from high to low; equal probabilities keep class order."""
    keyed = F.transform(entries, lambda e: F.struct((-e["prob"]).alias("n"), e["category"].alias("category")))
    return F.transform(F.array_sort(keyed), lambda k: F.struct(k["category"].alias("category"), (-k["n"]).alias("prob")))


def top_categories(probs: Column, k: int = V.TOP_CATEGORIES) -> Column:
    return F.slice(probs, 1, k)


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    hit = (F.col(label) == F.col(predicted)).cast("double")
    return df.agg(F.avg(hit).alias("top1"))


def top_k_accuracy(df: DataFrame, label: str, probs: str, k: int = V.METRICS_K) -> DataFrame:
    """`probs` is sorted from high to low; the label has to be among its first k."""
    hit = F.exists(F.slice(probs, 1, k), lambda p: p["category"] == F.col(label))
    return df.agg(F.avg(hit.cast("double")).alias("topk"))


def per_class(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(category, precision, recall, f1, support) over every class that is a label or a prediction."""
    cells = df.groupBy(F.col(label).alias("_t"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    same = F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_t").alias("category"), same.alias("tp"), F.col("_n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("_p").alias("category"), zero.alias("tp"), zero.alias("support"), F.col("_n").alias("predicted")),
    )
    sums = cells.select(F.inline(sides)).groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])

    def ratio(a, b) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp, support, made = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        "category", ratio(tp, made).alias("precision"), ratio(tp, support).alias("recall"),
        ratio(tp * 2, support + made).alias("f1"), "support",
    )


def macro_f1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return per_class(df, label, predicted).agg(F.avg("f1").alias("macro_f1"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row per class, then accuracy, macro average and weighted average."""
    classes = per_class(df, label, predicted).withColumn("category", F.col("category").cast("string"))
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / n

    nothing = F.lit(None).cast("double")
    names = ("precision", "recall", "f1")
    # Recall weighted by support is the share of hits, that is the accuracy.
    summary = classes.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("category"), nothing.alias("precision"), nothing.alias("recall"), weighted("recall").alias("f1"), n.alias("support")),
            F.struct(F.lit("macro avg").alias("category"), *[F.avg(c).alias(c) for c in names], n.alias("support")),
            F.struct(F.lit("weighted avg").alias("category"), *[weighted(c).alias(c) for c in names], n.alias("support")),
        ).alias("rows")
    )
    return classes.unionByName(summary.select(F.inline("rows")))


def corpus_counts(df: DataFrame, category: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_resumes"), F.countDistinct(category).alias("n_categories"))


def categories(df: DataFrame, category: str) -> DataFrame:
    return df.select(category).distinct().orderBy(category)


def metrics_record(corpus: DataFrame, category: str, scored: DataFrame, label: str, predicted: str, probs: str) -> DataFrame:
    """The one-row training record: sizes, three rates rounded to 4 places, and the day."""
    return corpus_counts(corpus, category).select(
        "n_resumes", "n_categories",
        F.round(accuracy(scored, label, predicted).scalar(), 4).alias("holdout_top1_accuracy"),
        F.round(top_k_accuracy(scored, label, probs).scalar(), 4).alias("holdout_top3_accuracy"),
        F.round(macro_f1(scored, label, predicted).scalar(), 4).alias("holdout_macro_f1"),
        F.date_format(F.current_date(), "yyyy-MM-dd").alias("trained_at"),
    )
