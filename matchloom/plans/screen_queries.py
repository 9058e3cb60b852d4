"""Prompts for every resume and its best posting, and the results once replies are joined."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.operators import embedding, matching, pages, screening
from matchloom.plans import sqltext as S
from matchloom.plans import views
from matchloom.plans.match_queries import BEST_POSTING_SQL, hashed_sql, posting_vectors, resume_vectors
from matchloom.plans.registry import query
from matchloom.plans.text_queries import FEEDBACK_SQL, POSTING, REPLY, RESUME, SCORE_SQL, chunk_rows, chunk_sql
from matchloom.sources import tables


# ---------------------------------------------------------------- pieces
def pairs(spark, sf_dir):
    """(doc_id, item_id): every resume with its best posting. Stored: the grid that counts its rows below must not run this one again."""
    best = matching.best_job(resume_vectors(spark, sf_dir), posting_vectors(spark, sf_dir), "doc_id", "item_id")
    return tables.materialise(best.select("doc_id", "item_id"), "best_postings")


def query_vectors(spark, sf_dir):
    """Retrieval encodes the raw text of the resume."""
    return embedding.hashed(views.view(spark, sf_dir, views.RESUME).select("doc_id", "text"), "text")


def passages(spark, sf_dir):
    posts = views.view(spark, sf_dir, views.POSTING)
    return embedding.hashed(chunk_rows(posts, "item_id"), "text")


def chunk_key():
    """Names one passage of one posting, in the order of (item_id, chunk_no); no count of passages makes two alike."""
    return F.concat_ws("/", F.lpad(F.col("item_id").cast("string"), 19, "0"), F.lpad(F.col("chunk_no").cast("string"), 10, "0"))


def screen_inputs(spark, sf_dir):
    """(doc_id, item_id, resume, job, matched)."""
    resumes = query_vectors(spark, sf_dir)
    wanted = pairs(spark, sf_dir).join(resumes.withColumnRenamed("text", "resume"), "doc_id")
    found = matching.evidence(wanted, passages(spark, sf_dir), "doc_id", "item_id")
    jobs = views.view(spark, sf_dir, views.POSTING).select("item_id", F.col("text").alias("job"))
    return found.join(jobs, "item_id").select("doc_id", "item_id", "resume", "job", "matched")


_CHUNKS = f"(SELECT concat(lpad(cast(item_id AS varchar), 19, '0'), '/', lpad(cast(chunk_no AS varchar), 10, '0')) AS chunk_id, item_id, chunk_no, text FROM ({chunk_sql(POSTING, 'item_id')}))"
_CHUNK_VEC = hashed_sql(_CHUNKS, "chunk_id", "text")
_QUERY_VEC = hashed_sql(RESUME, "doc_id", "text")
_MATCHED = f"""SELECT doc_id, list(text ORDER BY rn) AS matched FROM (
    SELECT b.doc_id, c.text, row_number() OVER (PARTITION BY b.doc_id ORDER BY round(coalesce(n.s, 0), 6) DESC, c.chunk_no) AS rn
    FROM ({BEST_POSTING_SQL}) b JOIN {_CHUNKS} c ON c.item_id = b.item_id
    LEFT JOIN (SELECT q.doc_id, v.chunk_id, sum(q.w * v.w) AS s FROM ({_QUERY_VEC}) q JOIN ({_CHUNK_VEC}) v USING (bucket) GROUP BY ALL) n
      ON n.doc_id = b.doc_id AND n.chunk_id = c.chunk_id) WHERE rn <= {V.SCREEN_K} GROUP BY doc_id"""
_INPUTS = f"""SELECT b.doc_id, b.item_id, r.text AS resume, p.text AS job, m.matched,
    array_to_string(list_transform(m.matched, lambda x: concat('- ', x)), chr(10)) AS evidence
  FROM ({BEST_POSTING_SQL}) b JOIN {RESUME} r ON r.doc_id = b.doc_id JOIN {POSTING} p ON p.item_id = b.item_id JOIN ({_MATCHED}) m ON m.doc_id = b.doc_id"""


def _prompt_sql(resume_head: str, resume_chars: int, task: str) -> str:
    return f"""concat({S.quote('JOB POSTING:' + chr(10))}, job[1:{V.SCREEN_JOB_CHARS}],
      {S.quote(chr(10) * 2 + 'REQUIREMENTS THIS RESUME LOOKS CLOSE TO (retrieved):' + chr(10))}, evidence,
      {S.quote(chr(10) * 2 + resume_head + chr(10))}, resume[1:{resume_chars}], {S.quote(chr(10) * 2 + task)})"""


# ---------------------------------------------------------------- prompts
@query(
    "prompts_screen",
    f"SELECT doc_id, item_id, len(matched) AS n_matched, md5({_prompt_sql('RESUME:', V.SCREEN_RESUME_CHARS, V.SCREEN_TASK)}) AS prompt_md5, {S.quote(V.SCREEN_SYSTEM)} AS system FROM ({_INPUTS})",
)
def prompts_screen(spark, sf_dir):
    prompt = screening.screen_prompt(F.col("resume"), F.col("job"), F.col("matched"))
    return screen_inputs(spark, sf_dir).select("doc_id", "item_id", F.size("matched").cast("bigint").alias("n_matched"), F.md5(prompt).alias("prompt_md5"), screening.system(prompt, V.SCREEN_SYSTEM))


@query(
    "prompts_tailor",
    f"SELECT doc_id, item_id, len(matched) AS n_matched, md5({_prompt_sql('CURRENT RESUME:', V.TAILOR_RESUME_CHARS, V.TAILOR_TASK)}) AS prompt_md5, {S.quote(V.TAILOR_SYSTEM)} AS system FROM ({_INPUTS})",
)
def prompts_tailor(spark, sf_dir):
    prompt = screening.tailor_prompt(F.col("resume"), F.col("job"), F.col("matched"))
    return screen_inputs(spark, sf_dir).select("doc_id", "item_id", F.size("matched").cast("bigint").alias("n_matched"), F.md5(prompt).alias("prompt_md5"), screening.system(prompt, V.TAILOR_SYSTEM))


def fit_inputs(spark, sf_dir):
    """(doc_id, role, resume, matched): passages of all postings, cut to the resume's own best role."""
    posts = views.view(spark, sf_dir, views.POSTING).select("item_id", "role")
    roles = pairs(spark, sf_dir).join(posts, "item_id").select("doc_id", F.col("role").alias("own_role"))
    resumes = query_vectors(spark, sf_dir).join(roles, "doc_id")
    index = passages(spark, sf_dir).join(posts, "item_id").withColumn("chunk_id", chunk_key())
    hits = matching.retrieve(
        resumes.select("doc_id", "own_role", "vec"), index.select("chunk_id", "role", F.col("text").alias("passage"), "vec"),
        "doc_id", "chunk_id", k=V.FIT_K, role="role", query_role="own_role",
    )
    # At most k passages per resume are gathered.
    matched = hits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda h: h["passage"]).alias("matched"))
    none = F.array().cast("array<string>")
    return resumes.select("doc_id", F.col("own_role").alias("role"), F.col("text").alias("resume")).join(matched, "doc_id", "left").withColumn(
        "matched", F.coalesce("matched", none)
    )


_FIT_HITS = f"""SELECT q.doc_id, c.text, p.role, row_number() OVER (PARTITION BY q.doc_id ORDER BY round_even(round(coalesce(n.s, 0), 12), 6) DESC, c.chunk_id) AS place
    FROM documents q CROSS JOIN {_CHUNKS} c JOIN {POSTING} p ON p.item_id = c.item_id
    LEFT JOIN (SELECT q.doc_id, v.chunk_id, sum(q.w * v.w) AS s FROM ({_QUERY_VEC}) q JOIN ({_CHUNK_VEC}) v USING (bucket) GROUP BY ALL) n
      ON n.doc_id = q.doc_id AND n.chunk_id = c.chunk_id"""
_FIT_INPUTS = f"""SELECT b.doc_id, p.role, r.text AS resume, m.matched,
    array_to_string(list_transform(m.matched, lambda x: concat('- ', x)), chr(10)) AS evidence
  FROM ({BEST_POSTING_SQL}) b JOIN {POSTING} p ON p.item_id = b.item_id JOIN {RESUME} r ON r.doc_id = b.doc_id
  LEFT JOIN (SELECT doc_id, list(text ORDER BY place) AS matched FROM (
      SELECT h.doc_id, h.text, h.place, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.place) AS rn FROM ({_FIT_HITS}) h
      JOIN ({BEST_POSTING_SQL}) b ON b.doc_id = h.doc_id JOIN {POSTING} p ON p.item_id = b.item_id
      WHERE h.place <= {V.FIT_K * V.OVERFETCH} AND h.role = p.role) WHERE rn <= {V.FIT_K} GROUP BY doc_id) m ON m.doc_id = b.doc_id"""


@query(
    "prompts_fit",
    f"""SELECT doc_id, role, coalesce(len(matched), 0) AS n_matched, CASE WHEN len(matched) > 0 THEN md5(concat('ROLE: ', role,
      {S.quote(chr(10) * 2 + 'RETRIEVED JOB REQUIREMENTS:' + chr(10))}, evidence, {S.quote(chr(10) * 2 + 'RESUME:' + chr(10))},
      resume[1:{V.FIT_RESUME_CHARS}], {S.quote(chr(10) * 2 + V.FIT_TASK)})) END AS prompt_md5,
      CASE WHEN len(matched) > 0 THEN {S.quote(V.FIT_SYSTEM)} END AS system FROM ({_FIT_INPUTS})""",
)
def prompts_fit(spark, sf_dir):
    prompt = screening.fit_prompt(F.col("role"), F.col("resume"), F.col("matched"))
    return fit_inputs(spark, sf_dir).select("doc_id", "role", F.size("matched").cast("bigint").alias("n_matched"), F.md5(prompt).alias("prompt_md5"), screening.system(prompt, V.FIT_SYSTEM))


# ---------------------------------------------------------------- results
# A reply for some prompts, in every state a service can leave behind.
_STATUS = "CASE (conv_id + turn) % 7 WHEN 3 THEN 'rejected' WHEN 4 THEN 'failed' WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'no_key' ELSE 'ok' END"
_REPLIES = "SELECT conv_id * (SELECT max(turn) + 1 FROM {reply}) + turn AS doc_id, {status} AS status, raw, CASE WHEN (conv_id + turn) % 7 IN (4, 5) THEN 'timed out' END AS problem FROM {reply}"
REPLIES_SQL = _REPLIES.format(status=_STATUS, reply=REPLY)


def replies(spark, sf_dir):
    return spark.sql(_REPLIES.format(status=_STATUS, reply="{reply}"), reply=views.view(spark, sf_dir, views.REPLY))


_RESULT = f"""SELECT doc_id, item_id, coalesce(status, 'no_key') AS status, raw, problem, matched,
    CASE WHEN status = 'ok' THEN {SCORE_SQL} END AS score FROM (SELECT i.*, r.status, r.raw, r.problem FROM ({_INPUTS}) i LEFT JOIN ({REPLIES_SQL}) r ON r.doc_id = i.doc_id)"""


@query(
    "screen_result",
    f"""SELECT *, feedback <> '' AS show_feedback FROM (SELECT doc_id, item_id, score, status <> 'ok' AS needs_key,
      CASE status WHEN 'ok' THEN {FEEDBACK_SQL} WHEN 'no_key' THEN {S.quote(V.MSG_SCREEN_NO_KEY)} WHEN 'rejected' THEN {S.quote(V.MSG_REJECTED)}
        ELSE concat({S.quote(V.MSG_SCREEN_FAILED)}, problem) END AS feedback,
      CASE WHEN score >= 70 THEN 'Strong match' WHEN score >= 45 THEN 'Moderate match' WHEN score IS NOT NULL THEN 'Weak match' END AS band,
      score IS NOT NULL AS show_score, status <> 'ok' AND len(matched) > 0 AS show_matched FROM ({_RESULT}))""",
)
def screen_result(spark, sf_dir):
    joined = screening.join_replies(screen_inputs(spark, sf_dir), replies(spark, sf_dir), "doc_id")
    return screening.screen_result(joined).select(
        "doc_id", "item_id", "score", "needs_key", "feedback", "band", "show_score", "show_feedback", "show_matched"
    )


@query(
    "tailor_result",
    f"""SELECT doc_id, item_id, CASE status WHEN 'no_key' THEN {S.quote(V.MSG_TAILOR_NO_KEY)} WHEN 'ok' THEN {S.trim_u('raw')}
      WHEN 'rejected' THEN {S.quote(V.MSG_REJECTED)} ELSE concat({S.quote(V.MSG_TAILOR_FAILED)}, problem) END AS tailored FROM ({_RESULT})""",
)
def tailor_result(spark, sf_dir):
    joined = screening.join_replies(screen_inputs(spark, sf_dir), replies(spark, sf_dir), "doc_id")
    return screening.tailor_result(joined).select("doc_id", "item_id", "tailored")


@query(
    "fit_result",
    f"""SELECT i.doc_id, i.role, CASE WHEN coalesce(len(matched), 0) = 0 THEN concat({S.quote(V.MSG_FIT_NO_PASSAGES)}, i.role, '.')
      WHEN r.status IS NULL OR r.status = 'no_key' THEN {S.quote(V.MSG_FIT_NO_KEY)} WHEN r.status = 'ok' THEN r.raw
      WHEN r.status = 'rejected' THEN {S.quote(V.MSG_FIT_REJECTED)} WHEN r.status = 'rate_limited' THEN {S.quote(V.MSG_FIT_RATE_LIMITED)}
      ELSE concat({S.quote(V.MSG_FIT_FAILED)}, r.problem) END AS analysis FROM ({_FIT_INPUTS}) i LEFT JOIN ({REPLIES_SQL}) r ON r.doc_id = i.doc_id""",
)
def fit_result(spark, sf_dir):
    joined = screening.join_replies(fit_inputs(spark, sf_dir), replies(spark, sf_dir), "doc_id")
    return screening.fit_result(joined).select("doc_id", "role", "analysis")


# ---------------------------------------------------------------- roles on offer, from their sources to retrieval
# The descriptions that the roles' sources name are the first postings, one for each role.
_ROLE_LIST = ", ".join(f"({k}, {S.quote(role)}, {S.quote(source)})" for k, (role, source) in enumerate(V.ROLES))
_ROLE_TEXT = f"(SELECT r.k AS item_id, r.role, p.text FROM (VALUES {_ROLE_LIST}) r(k, role, source) JOIN {POSTING} p ON p.item_id = r.k)"
_ROLE_CHUNKS = f"(SELECT concat(r.role, '/', lpad(cast(c.chunk_no AS varchar), 10, '0')) AS chunk_id, r.role, c.chunk_no, c.text FROM ({chunk_sql(_ROLE_TEXT, 'item_id')}) c JOIN {_ROLE_TEXT} r USING (item_id))"


@query(
    "role_passages",
    f"""SELECT doc_id, role, chunk_no, score, cast(place AS int) AS rank FROM (
      SELECT q.doc_id, c.role, c.chunk_no, round_even(round(coalesce(n.s, 0), 12), 6) AS score,
        row_number() OVER (PARTITION BY q.doc_id ORDER BY round_even(round(coalesce(n.s, 0), 12), 6) DESC, c.chunk_id) AS place
      FROM documents q CROSS JOIN {_ROLE_CHUNKS} c
      LEFT JOIN (SELECT q.doc_id, v.chunk_id, sum(q.w * v.w) AS s FROM ({_QUERY_VEC}) q JOIN ({hashed_sql(_ROLE_CHUNKS, 'chunk_id', 'text')}) v USING (bucket) GROUP BY ALL) n
        ON n.doc_id = q.doc_id AND n.chunk_id = c.chunk_id) WHERE place <= {V.RETRIEVE_K}""",
)
def role_passages(spark, sf_dir):
    """The passages of the roles on offer that are closest to each resume: role dimension, its files, passages, vectors, retrieval."""
    roles = tables.role_dimension(spark)
    numbers = spark.createDataFrame([(k, source) for k, (_, source) in enumerate(V.ROLES)], "item_id bigint, path string")
    files = views.view(spark, sf_dir, views.POSTING).join(F.broadcast(numbers), "item_id").select("path", "text")
    described = pages.dispatch_sources(roles, files, "role")
    chunked = chunk_rows(described.select("role", "text"), "role")
    key = F.concat_ws("/", "role", F.lpad(F.col("chunk_no").cast("string"), 10, "0"))
    index = embedding.hashed(chunked, "text").select(key.alias("chunk_id"), "role", "chunk_no", "vec")
    hits = matching.retrieve(query_vectors(spark, sf_dir).select("doc_id", "vec"), index, "doc_id", "chunk_id")
    return hits.select("doc_id", "role", "chunk_no", "score", "rank")


@query("last_of_name", f"SELECT max(item_id) AS item_id, role, any_value(n) AS n_named FROM (SELECT item_id, role, count(*) OVER (PARTITION BY role) AS n FROM {POSTING}) GROUP BY role")
def last_of_name(spark, sf_dir):
    """Postings that share a name: the last one stands for it."""
    posts = views.view(spark, sf_dir, views.POSTING).select("item_id", "role")
    counts = posts.groupBy("role").agg(F.count(F.lit(1)).alias("n_named"))
    return matching.last_of_name(posts, "role", "item_id").join(counts, "role").select("item_id", "role", "n_named")
