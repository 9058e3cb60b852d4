"""Corpus preparation, term weights, key terms, set similarity and metrics on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions import text
from matchloom.operators import dedup, grams, jaccard, keyterms, metrics, stratify, tfidf
from matchloom.plans import sqltext as S
from matchloom.plans import views
from matchloom.plans.registry import query

PRED = views.oracle(views.PREDICTION_ORACLE)


# ---------------------------------------------------------------- dedup and split
DEDUP_SQL = "SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"


def corpus(spark, sf_dir):
    """The labelled corpus: complete rows, first of each text, language as category."""
    df = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return dedup.keep_first(dedup.drop_incomplete(df), "text", "doc_id")


@query("dedup_keep_first", f"SELECT doc_id, lang, md5(text) AS text_md5 FROM ({DEDUP_SQL})")
def dedup_keep_first(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "lang", F.md5("text").alias("text_md5"))


SPLIT_SQL = f"""SELECT doc_id, lang, rank, rank <= round({V.TEST_SHARE} * category_size) AS is_test, cast((rank - 1) % {V.CALIBRATION_FOLDS} AS int) AS fold FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id, ':{V.RANDOM_STATE}')), doc_id) AS rank,
  count(*) OVER (PARTITION BY lang) AS category_size FROM ({DEDUP_SQL}))"""


@query("stratified_split", SPLIT_SQL)
def stratified_split(spark, sf_dir):
    ranked = stratify.shuffled_rank(corpus(spark, sf_dir), "lang", "doc_id")
    return ranked.select("doc_id", "lang", "rank", stratify.held_out().alias("is_test"), stratify.fold().alias("fold"))


# ---------------------------------------------------------------- terms
def _stopped(x: str) -> str:
    return f"list_filter({S.words(x)}, lambda w: w NOT IN {S.stop_words()})"


def counts_sql(source: str, key: str, grams: bool = True) -> str:
    terms = "list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda p: concat(p[1], ' ', p[2])))" if grams else "w"
    if grams:
        terms = f"CASE WHEN len(w) > 1 THEN {terms} ELSE w END"
    return f"SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({terms}) AS term FROM (SELECT {key}, {_stopped('text')} AS w FROM {source})) GROUP BY ALL"


def weights_sql(source: str, key: str, vocab: str, n_docs: str) -> str:
    raw = f"SELECT {key}, c.term, (1 + ln(c.tf)) * (ln((1 + {n_docs}) / (1.0 + v.df)) + 1) AS w FROM ({counts_sql(source, key)}) c JOIN ({vocab}) v ON c.term = v.term"
    return f"SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM ({raw})"


_STATS = f"SELECT term, cast(sum(tf) AS bigint) AS n, count(*) AS df FROM ({counts_sql('documents', 'doc_id')}) GROUP BY term"
VOCAB_SQL = f"SELECT * FROM ({_STATS}) ORDER BY n DESC, term LIMIT {V.MAX_FEATURES}"
_N = "(SELECT count(*) FROM documents)"
TFIDF_SQL = weights_sql("documents", "doc_id", VOCAB_SQL, _N)


def documents(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", "text")


@query("term_stats", _STATS)
def term_stats(spark, sf_dir):
    return grams.term_stats(documents(spark, sf_dir), "text")


@query("tfidf", f"SELECT doc_id, term, round(w, 6) AS w FROM ({TFIDF_SQL})")
def tfidf_weights(spark, sf_dir):
    w = tfidf.fit_transform(documents(spark, sf_dir), "doc_id", "text")
    return w.select("doc_id", "term", F.round("w", 6).alias("w"))


@query(
    "tfidf_cosine",
    f"""SELECT doc_id, item_id, round(sum(d.w * b.w), 6) AS score FROM ({TFIDF_SQL}) d
    JOIN ({weights_sql('benchmark', 'item_id', VOCAB_SQL, _N)}) b ON d.term = b.term GROUP BY ALL""",
)
def tfidf_cosine(spark, sf_dir):
    docs, posts = documents(spark, sf_dir), views.table(spark, sf_dir, "benchmark")
    vocab, n_docs = tfidf.largest_terms(grams.term_stats(docs, "text")), docs.count()
    left, right = tfidf.row_weights(docs, "doc_id", "text", vocab, n_docs), tfidf.row_weights(posts, "item_id", "text", vocab, n_docs)
    return tfidf.cosine_pairs(left, right, "doc_id", "item_id").select("doc_id", "item_id", F.round("score", 6).alias("score"))


@query(
    "keyterms_freq",
    f"""SELECT * FROM (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank
    FROM ({counts_sql('documents', 'doc_id', grams=False)})) WHERE rank <= {keyterms.TOP_TERMS}""",
)
def keyterms_freq(spark, sf_dir):
    counts = tfidf.term_counts(documents(spark, sf_dir), "doc_id", "text", grams=False)
    return keyterms.top_terms(counts, "doc_id", "tf").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "keyterms_tfidf",
    f"""SELECT * FROM (SELECT doc_id, term, w, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank
    FROM (SELECT doc_id, term, round(w, 6) AS w FROM ({TFIDF_SQL}))) WHERE rank <= {keyterms.TOP_TERMS}""",
)
def keyterms_tfidf(spark, sf_dir):
    w = tfidf.fit_transform(documents(spark, sf_dir), "doc_id", "text").withColumn("w", F.round("w", 6))
    return keyterms.top_terms(w, "doc_id", "w").withColumn("rank", F.col("rank").cast("bigint"))


# ---------------------------------------------------------------- set similarity
def _set_sql(x: str) -> str:
    return f"list_filter(list_distinct(string_split({S.clean(x)}, ' ')), lambda w: w <> '')"


_JACCARD = """CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0
  ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END"""


@query(
    "jaccard_turns",
    f"""SELECT conv_id, turn, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE {_JACCARD} END, 6) AS jaccard FROM (
      SELECT conv_id, turn, CASE WHEN text <> '' THEN {_set_sql('text')} END AS a, CASE WHEN earlier <> '' THEN {_set_sql('earlier')} END AS b FROM (
        SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM conversations))""",
)
def jaccard_turns(spark, sf_dir):
    df = views.table(spark, sf_dir, "conversations")
    earlier = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    df = df.withColumn("earlier", earlier)
    return df.select("conv_id", "turn", F.round(jaccard.text_jaccard(F.col("text"), F.col("earlier")), 6).alias("jaccard"))


JACCARD_THRESHOLD = 0.1


@query(
    "jaccard_pairs",
    f"""SELECT doc_id, item_id, round(j, 6) AS jaccard FROM (SELECT doc_id, item_id, {_JACCARD} AS j
      FROM (SELECT doc_id, {_set_sql('text')} AS a FROM documents), (SELECT item_id, {_set_sql('text')} AS b FROM benchmark)) WHERE j >= {JACCARD_THRESHOLD}""",
)
def jaccard_pairs(spark, sf_dir):
    docs, posts = documents(spark, sf_dir), views.table(spark, sf_dir, "benchmark")
    near = jaccard.similar_pairs(docs, posts, "doc_id", "item_id", JACCARD_THRESHOLD)
    return near.select("doc_id", "item_id", F.round("jaccard", 6).alias("jaccard"))


# ---------------------------------------------------------------- predictions and metrics
_PROB = f"SELECT vec_id, label, cast(c AS int) AS c, s / sum(s) OVER (PARTITION BY vec_id) AS prob FROM {PRED}"
_ORDERED = f"SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, c) AS rank FROM ({_PROB})"
_TOP1 = f"(SELECT vec_id, label, c AS pred FROM ({_ORDERED}) WHERE rank = 1)"


def predictions(spark, sf_dir):
    """(vec_id, label, probs, pred): one row per item, probabilities from high to low."""
    long = views.view(spark, sf_dir, views.PREDICTION_SPARK)
    scores = long.groupBy("vec_id", "label").agg(F.collect_list(F.struct(F.col("c").alias("category"), "s")).alias("e"), F.sum("s").alias("total"))
    entries = F.transform("e", lambda e: F.struct(e["category"].alias("category"), (e["s"] / F.col("total")).alias("prob")))
    out = scores.withColumn("probs", metrics.sorted_probs(entries))
    return out.select("vec_id", "label", "probs", F.get("probs", F.lit(0))["category"].alias("pred"))


@query("class_probs_sorted", f"SELECT vec_id, c, round(prob, 6) AS prob, rank, round(prob * 100, 1) AS pct FROM ({_ORDERED})")
def class_probs_sorted(spark, sf_dir):
    df = predictions(spark, sf_dir).select("vec_id", F.posexplode("probs").alias("at", "p"))
    return df.select(
        "vec_id", F.col("p.category").alias("c"), F.round("p.prob", 6).alias("prob"), (F.col("at") + 1).cast("bigint").alias("rank"),
        text.percent(F.col("p.prob")).alias("pct"),
    )


@query("top5_categories", f"SELECT vec_id, c, round(prob * 100, 1) AS pct, rank FROM ({_ORDERED}) WHERE rank <= {V.TOP_CATEGORIES}")
def top5_categories(spark, sf_dir):
    df = predictions(spark, sf_dir).select("vec_id", F.posexplode(metrics.top_categories(F.col("probs"))).alias("at", "p"))
    return df.select("vec_id", F.col("p.category").alias("c"), text.percent(F.col("p.prob")).alias("pct"), (F.col("at") + 1).cast("bigint").alias("rank"))


@query("top1_accuracy", f"SELECT round(avg(cast(label = pred AS int)), 6) AS top1 FROM {_TOP1}")
def top1_accuracy(spark, sf_dir):
    return metrics.accuracy(predictions(spark, sf_dir), "label", "pred").select(F.round("top1", 6).alias("top1"))


@query("top3_accuracy", f"SELECT round(avg(hit), 6) AS topk FROM (SELECT vec_id, max(cast(c = label AND rank <= 3 AS int)) AS hit FROM ({_ORDERED}) GROUP BY vec_id)")
def top3_accuracy(spark, sf_dir):
    return metrics.top_k_accuracy(predictions(spark, sf_dir), "label", "probs").select(F.round("topk", 6).alias("topk"))


_CLASSES = f"""SELECT k.c AS category, coalesce(tp / nullif(made, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2 * tp / nullif(support + made, 0), 0) AS f1, support FROM (
    SELECT c, (SELECT count(*) FROM {_TOP1} WHERE label = c AND pred = c) AS tp, (SELECT count(*) FROM {_TOP1} WHERE label = c) AS support,
    (SELECT count(*) FROM {_TOP1} WHERE pred = c) AS made FROM (SELECT label AS c FROM {_TOP1} UNION SELECT pred FROM {_TOP1})) k"""


@query("macro_f1", f"SELECT round(avg(f1), 6) AS macro_f1 FROM ({_CLASSES})")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(predictions(spark, sf_dir), "label", "pred").select(F.round("macro_f1", 6).alias("macro_f1"))


@query(
    "class_report",
    f"""WITH k AS ({_CLASSES}) SELECT cast(category AS varchar) AS category, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM k
    UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT round(avg(cast(label = pred AS int)), 6) FROM {_TOP1}), (SELECT count(*) FROM {_TOP1})
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) AS bigint) FROM k
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), cast(sum(support) AS bigint) FROM k""",
)
def class_report(spark, sf_dir):
    df = metrics.class_report(predictions(spark, sf_dir), "label", "pred")
    return df.select("category", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("class_list", "SELECT DISTINCT lang FROM documents")
def class_list(spark, sf_dir):
    return metrics.categories(views.table(spark, sf_dir, "documents"), "lang")


@query("corpus_counts", f"SELECT count(*) AS n_resumes, count(DISTINCT lang) AS n_categories FROM ({DEDUP_SQL})")
def corpus_counts(spark, sf_dir):
    return metrics.corpus_counts(corpus(spark, sf_dir), "lang")


@query(
    "metrics_record",
    f"""SELECT (SELECT count(*) FROM ({DEDUP_SQL})) AS n_resumes, (SELECT count(DISTINCT lang) FROM ({DEDUP_SQL})) AS n_categories,
    (SELECT round(avg(cast(label = pred AS int)), 4) FROM {_TOP1}) AS holdout_top1_accuracy,
    (SELECT round(avg(hit), 4) FROM (SELECT max(cast(c = label AND rank <= 3 AS int)) AS hit FROM ({_ORDERED}) GROUP BY vec_id)) AS holdout_top3_accuracy,
    (SELECT round(avg(f1), 4) FROM ({_CLASSES})) AS holdout_macro_f1, strftime(current_date, '%Y-%m-%d') AS trained_at""",
)
def metrics_record(spark, sf_dir):
    return metrics.metrics_record(corpus(spark, sf_dir), "lang", predictions(spark, sf_dir), "label", "pred", "probs")
