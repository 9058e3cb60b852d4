"""Key phrases and word vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import keyphrases, wordvec
from matchloom.plans import sqltext as S
from matchloom.plans import views
from matchloom.plans.corpus_queries import documents
from matchloom.plans.registry import query

_HAS = f"lambda s: regexp_matches(s, {S.quote(keyphrases.WORD)})"
_SENT = f"list_filter(string_split_regex(text, {S.quote(keyphrases.SENTENCE_END)}), {_HAS})"
_BLOCK = f"list_filter(string_split_regex(st, {S.quote(keyphrases.BLOCK_END)}), {_HAS})"


def _clean(x: str) -> str:
    return f"CASE WHEN NOT regexp_matches({x}, {S.quote(keyphrases.HAS_DIGIT)}) THEN lower({x}) END"


_WORDS = f"""SELECT doc_id, sentence, bno, i, w[i] AS raw, leads AND i = 1 AS opens, {_clean('w[i]')} AS term,
    CASE WHEN i > 1 THEN {_clean('w[i - 1]')} END AS lt, CASE WHEN i < len(w) THEN {_clean('w[i + 1]')} END AS rt FROM (
      SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (
        SELECT doc_id, sentence, bno, bno = 0 AS leads, regexp_extract_all(bt, {S.quote(keyphrases.WORD)}) AS w FROM (
          SELECT doc_id, sentence, unnest({_BLOCK}) AS bt, generate_subscripts({_BLOCK}, 1) - 1 AS bno FROM (
            SELECT doc_id, unnest({_SENT}) AS st, generate_subscripts({_SENT}, 1) - 1 AS sentence FROM documents))))"""
_TERMS = f"""SELECT doc_id, term, count(*) AS tf, term IN {S.stop_words()} OR length(term) < {keyphrases.MIN_TERM_CHARS} AS stop,
    greatest(count(*) FILTER (WHERE regexp_matches(raw, {S.quote(keyphrases.ACRONYM)})),
      count(*) FILTER (WHERE regexp_matches(raw, {S.quote(keyphrases.CAPITAL)}) AND NOT opens AND NOT regexp_matches(raw, {S.quote(keyphrases.ACRONYM)}))) AS cased,
    median(DISTINCT sentence) AS mid, count(DISTINCT sentence) AS ns,
    coalesce(count(DISTINCT lt) / nullif(count(lt), 0), 0) AS dl, coalesce(count(DISTINCT rt) / nullif(count(rt), 0), 0) AS dr
  FROM ({_WORDS}) WHERE term IS NOT NULL GROUP BY doc_id, term"""
_FEATURES = f"""SELECT t.doc_id, term, tf, stop, 1 + (dl + dr) * tf / max(tf) OVER (PARTITION BY t.doc_id) AS rel, ln(ln(3 + mid)) AS pos, cased / (1 + ln(tf)) AS cs,
    tf / (avg(CASE WHEN NOT stop THEN tf END) OVER (PARTITION BY t.doc_id) + stddev_pop(CASE WHEN NOT stop THEN tf END) OVER (PARTITION BY t.doc_id)) AS freq, ns / n AS sent
  FROM ({_TERMS}) t JOIN (SELECT doc_id, max(sentence) + 1 AS n FROM ({_WORDS}) GROUP BY doc_id) d ON d.doc_id = t.doc_id"""


@query("keyterms_yake_terms", f"SELECT doc_id, term, round(rel * pos / (cs + freq / rel + sent / rel), 6) AS score FROM ({_FEATURES}) WHERE NOT stop")
def keyterms_yake_terms(spark, sf_dir):
    return keyphrases.term_scores(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "term", F.round("score", 6).alias("score"))


def _run_sql(n: int) -> str:
    """Runs of n words that begin and end with no stop word; one inside counts by how firmly it is tied to its neighbours."""
    loose = lambda j: f"(1 - links{j - 1} / tf{j - 1} * links{j} / tf{j + 1})"
    inner = range(1, n - 1)
    p = " * ".join(f"CASE WHEN stop{j} THEN 1 + {loose(j)} ELSE score{j} END" if j in inner else f"score{j}" for j in range(n))
    s = " + ".join(f"CASE WHEN stop{j} THEN -{loose(j)} ELSE score{j} END" if j in inner else f"score{j}" for j in range(n))
    phrase = " || ' ' || ".join(f"term{j}" for j in range(n))
    return f"SELECT doc_id, {phrase} AS phrase, {p} AS p, {s} AS s FROM ahead WHERE NOT stop0 AND NOT stop{n - 1} AND i{n - 1} - i0 = {n - 1}"


#: The oracle's edit distance goes by bytes: the letters of the test texts that have two are swapped for capitals, which lower case leaves free.
_BYTES = "translate(%s, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
_CARRIED = ", ".join(f"lead({c}, {j}) OVER b AS {c}{j}" for j in range(keyphrases.MAX_WORDS) for c in ("i", "term", "tf", "stop", "score", "links"))
_ALIKE = f"1 - levenshtein({_BYTES % 'o.phrase'}, {_BYTES % 'b[1].phrase'}) / greatest(length(o.phrase), length(b[1].phrase)) > {keyphrases.DEDUP_LIMIT}"
YAKE_SQL = f"""WITH scored AS (SELECT doc_id, term, tf, stop, rel * pos / (cs + freq / rel + sent / rel) AS score FROM ({_FEATURES})),
tied AS (SELECT doc_id, sentence, bno, i, term, count(*) OVER (PARTITION BY doc_id, term, rt) AS links FROM ({_WORDS}) WHERE term IS NOT NULL),
ahead AS (SELECT doc_id, {_CARRIED} FROM tied JOIN scored USING (doc_id, term) WINDOW b AS (PARTITION BY doc_id, sentence, bno ORDER BY i)),
found AS (SELECT doc_id, phrase, round(max(p) / (count(*) * (1 + max(s))), 9) AS score FROM ({' UNION ALL '.join(_run_sql(n + 1) for n in range(keyphrases.MAX_WORDS))}) GROUP BY doc_id, phrase),
folded AS (SELECT doc_id, list_reduce(list_prepend(cast([] AS STRUCT(score DOUBLE, phrase VARCHAR)[]), list([{{'score': score, 'phrase': phrase}}] ORDER BY score, phrase)),
  lambda a, b: CASE WHEN len(a) >= {keyphrases.TOP} OR len(list_filter(a, lambda o: {_ALIKE})) > 0 THEN a ELSE list_append(a, b[1]) END) AS kept FROM found GROUP BY doc_id)
SELECT doc_id, cast(rank AS bigint) AS rank, k.phrase AS phrase, round(k.score, 6) AS score
FROM (SELECT doc_id, unnest(range(1, len(kept) + 1)) AS rank, unnest(kept) AS k FROM folded)"""


@query("keyterms_yake", YAKE_SQL)
def keyterms_yake(spark, sf_dir):
    best = keyphrases.key_phrases(documents(spark, sf_dir), "doc_id", "text")
    return best.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "phrase", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- word vectors
WIDTH = 64
#: The corpus' words that occur twice or more, each with the vector of some embedding: a stand-in for a table of trained word vectors.
_SLOT = "cast(concat('0x', substr(md5(word), 1, 8)) AS bigint) % (SELECT count(*) FROM embeddings)"
_COUNTED = f"SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({S.words('text')}) AS word FROM documents) GROUP BY ALL"
_TABLE = f"""SELECT w.word, e.embedding AS vec FROM (SELECT word, {_SLOT} AS slot FROM ({_COUNTED}) GROUP BY word HAVING sum(tf) >= 2) w JOIN embeddings e ON e.vec_id = w.slot"""


@query(
    "word_vectors",
    f"""SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_known, 0) AS n_known, pos, value FROM documents d LEFT JOIN (
      SELECT doc_id, cast(sum(tf) AS bigint) AS n_words, cast(coalesce(sum(tf) FILTER (WHERE vec IS NOT NULL), 0) AS bigint) AS n_known
      FROM ({_COUNTED}) LEFT JOIN ({_TABLE}) USING (word) GROUP BY doc_id) n ON n.doc_id = d.doc_id LEFT JOIN (
      SELECT doc_id, cast(pos AS int) AS pos, round(sum(tf * x) / sum(tf), 4) AS value FROM (
        SELECT doc_id, tf, cast(unnest(vec) AS double) AS x, unnest(range({WIDTH})) AS pos FROM ({_COUNTED}) JOIN ({_TABLE}) USING (word)) GROUP BY doc_id, pos) v ON v.doc_id = d.doc_id""",
)
def word_vectors(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counted = wordvec.word_counts(docs, "doc_id", "text")
    frequent = counted.groupBy("word").agg(F.sum("tf").alias("n")).where("n >= 2")
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    slot = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % e.agg(F.count(F.lit(1))).scalar()
    table = frequent.select("word", slot.alias("slot")).join(e, F.col("slot") == F.col("vec_id")).select("word", "vec")
    made = wordvec.document_means(docs, table, "doc_id", "text", WIDTH)
    return made.select("doc_id", "n_words", "n_known", F.posexplode_outer("vec").alias("pos", "value")).withColumn("value", F.round("value", 4))
