"""Inputs with resume-like traits, derived from whole tables and whole texts.

The test tables hold prose without section headers, grades, links, years or scores. These views put such
traits around the texts. The SQL is portable: Spark and the oracle engine run the same string, so a view
can never be the reason for a difference. `{name}` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.sources.tables import read_table

_HALF = "cast(floor(length(text) / 2) AS int)"
_FIRST = f"substr(text, 1, {_HALF})"
_SECOND = f"substr(text, {_HALF} + 1)"
_THIRD = "cast(floor(length(text) / 3) AS int)"

RESUME = f"""
SELECT doc_id, lang, concat('Candidate ', cast(doc_id AS string), chr(10),
  CASE doc_id % 5 WHEN 0 THEN ''
    WHEN 1 THEN concat('User.', cast(doc_id AS string), '@mail', cast(doc_id % 7 AS string), '.example.com')
    WHEN 2 THEN concat('(734) 555-', lpad(cast(doc_id % 10000 AS string), 4, '0'), ' linkedin.com/in/user-', cast(doc_id AS string))
    WHEN 3 THEN concat('1', lpad(cast(7345550000 + doc_id AS string), 10, '0'), ' LinkedIn.com/profile/view?id=', cast(doc_id AS string))
    ELSE concat('734.555.', lpad(cast(doc_id % 10000 AS string), 4, '0'), ' a', cast(doc_id AS string), '@x.co.uk github.com/u', cast(doc_id AS string)) END, chr(10),
  CASE doc_id % 3 WHEN 0 THEN concat('GPA: ', cast(1 + doc_id % 4 AS string), '.', cast(doc_id % 10 AS string), '/4.0')
    WHEN 1 THEN concat('gpa ', cast(doc_id % 6 AS string)) ELSE '' END, chr(10),
  CASE doc_id % 7 WHEN 0 THEN concat(cast(doc_id % 15 AS string), '+ years of experience') WHEN 1 THEN '7 yrs experience'
    WHEN 2 THEN 'Experience of 12 years' WHEN 3 THEN '3 years in finance' ELSE '' END, chr(10),
  CASE doc_id % 4 WHEN 0 THEN 'PhD' WHEN 1 THEN 'MBA' WHEN 2 THEN 'B.S.' ELSE 'GED' END, chr(10),
  CASE doc_id % 6 WHEN 0 THEN text
    WHEN 1 THEN concat('EDUCATION', chr(10), 'State school', chr(10), 'WORK EXPERIENCE', chr(10), {_FIRST}, chr(10), ' ', chr(10),
      'Technical Skills:', chr(10), 'sql, python https://ex.org/a?b=1 httpd', chr(10), {_SECOND})
    WHEN 2 THEN concat('Experience and the Projects', chr(10), {_FIRST}, chr(10), chr(10), 'PROJECTS', chr(10), {_SECOND})
    WHEN 3 THEN concat('Skills', chr(10), {_FIRST}, chr(10), 'Experience', chr(10), {_SECOND}, chr(10), 'SKILLS', chr(10), 'spark')
    WHEN 4 THEN concat('Summary', chr(10), 'Experience', chr(10), text, chr(10), 'Projects')
    ELSE concat('Research Assistant', chr(10), {_FIRST}, chr(10), 'skills in many other areas', chr(10), {_SECOND}) END) AS text
FROM {{documents}}"""

POSTING = f"""
SELECT item_id, concat('role_', cast(item_id % 4 AS string)) AS role, concat(
  CASE WHEN item_id % 3 = 0 THEN '' ELSE concat('Job Description', chr(10)) END, substr(text, 1, {_THIRD}), chr(10),
  CASE WHEN item_id % 3 = 1 THEN 'Key Responsibilities' ELSE '' END, chr(10), '  ', substr(text, {_THIRD} + 1, {_THIRD}), '  ', chr(10),
  CASE WHEN item_id % 3 = 2 THEN 'Requirements:' ELSE 'Team' END, chr(10), substr(text, 2 * {_THIRD} + 1)) AS text
FROM {{benchmark}}"""

REPLY = """
SELECT conv_id, turn, CASE (conv_id + turn) % 6
  WHEN 0 THEN concat('SCORE: ', cast((conv_id * 37 + turn) % 130 AS string), chr(10), text)
  WHEN 1 THEN concat('Here you go', chr(10), '`SCORE: ', cast(conv_id % 101 AS string), '` done', chr(10), text, chr(10), 'SCORE: 1')
  WHEN 2 THEN text
  WHEN 3 THEN concat('score: 50', chr(10), text)
  WHEN 4 THEN concat('SCORE:', cast(1000 + conv_id AS string), chr(10), text)
  ELSE concat('Note', chr(10), 'SCORE:', chr(10), cast(conv_id % 101 AS string), ' ', text) END AS raw
FROM {conversations}"""

# Row generators are spelled differently in the two engines, the rest is shared.
_PREDICTION = """
SELECT vec_id, label, c, (vec_id * 7919 + c * 104729) %% 1000 + CASE WHEN c = label AND vec_id %% 4 <> 0 THEN 600 ELSE 0 END AS s
FROM (SELECT vec_id, label, %s AS c FROM {embeddings})"""
PREDICTION_SPARK = _PREDICTION % "explode(sequence(0, 9))"
PREDICTION_ORACLE = _PREDICTION % "unnest(range(0, 10))"

_PAGE_CHARS = 800
_PAGE_BODY = f"substr(text, 1 + {_PAGE_CHARS} * page_no, {_PAGE_CHARS})"
_PAGE = f"""
SELECT doc_id, page_no, x_tol, CASE WHEN doc_id %% 9 = 8 AND page_no = 1 THEN ''
  WHEN (doc_id + page_no) %% 4 = 0 AND x_tol = 3 THEN replace({_PAGE_BODY}, ' ', '')
  WHEN (doc_id + page_no) %% 4 = 0 AND x_tol = 2 AND doc_id %% 8 = 0 THEN replace({_PAGE_BODY}, 'e ', 'e')
  ELSE {_PAGE_BODY} END AS text
FROM (SELECT doc_id, text, x_tol, %s AS page_no FROM (SELECT doc_id, text, %s AS x_tol FROM {{documents}}))"""
_LAST_PAGE = f"cast(floor(length(text) / {_PAGE_CHARS}) AS int)"
PAGE_SPARK = _PAGE % (f"explode(sequence(0, {_LAST_PAGE}))", "explode(array(3, 2, 1))")
PAGE_ORACLE = _PAGE % (f"unnest(range(0, {_LAST_PAGE} + 1))", "unnest([3, 2, 1])")

TABLES = ["documents", "benchmark", "pages", "embeddings", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """The view as a sub-query for an oracle."""
    return "(" + sql.format(**{t: t for t in TABLES}).strip() + ")"
