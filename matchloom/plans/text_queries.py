"""Row-wise text operators on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions import chunks, contact, html, replies, sections, text
from matchloom.operators import pages as P
from matchloom.plans import sqltext as S
from matchloom.plans import views
from matchloom.plans.registry import query

RESUME = views.oracle(views.RESUME)
POSTING = views.oracle(views.POSTING)
REPLY = views.oracle(views.REPLY)
PAGE = views.oracle(views.PAGE_ORACLE)


# ---------------------------------------------------------------- contact details
def _details_sql() -> str:
    sql = f"SELECT doc_id, text AS r0 FROM {RESUME}"
    steps = [("gpa", V.GPA, 1), ("email", V.EMAIL, 0), ("phone", V.PHONE, 0), ("linkedin", V.LINKEDIN, 0)]
    kept = ""
    for i, (name, pattern, group) in enumerate(steps):
        sql = (
            f"SELECT doc_id{kept}, regexp_extract(r{i}, {S.quote(pattern)}, {group}) AS {name}, "
            f"{S.sub_all(f'r{i}', pattern, '')} AS r{i + 1} FROM ({sql})"
        )
        kept += f", {name}"
    return f"SELECT doc_id, gpa, email, phone, linkedin, r4 AS rest FROM ({sql})"


@query("resume_details", _details_sql())
def resume_details(spark, sf_dir):
    df = contact.with_details(views.view(spark, sf_dir, views.RESUME))
    return df.select("doc_id", "details.*", "rest")


@query(
    "link_patterns",
    f"""SELECT doc_id, regexp_extract(text, {S.quote(V.GITHUB)}, 0) AS github, md5({S.sub_all('text', V.GITHUB, '')}) AS github_rest,
    regexp_extract(text, {S.quote(V.URL)}, 0) AS url, md5({S.sub_all('text', V.URL, '')}) AS url_rest FROM {RESUME}""",
)
def link_patterns(spark, sf_dir):
    df = views.view(spark, sf_dir, views.RESUME)
    git, git_rest = contact.github(F.col("text"))
    url, url_rest = contact.url(F.col("text"))
    return df.select(
        "doc_id", git.alias("github"), F.md5(git_rest).alias("github_rest"), url.alias("url"), F.md5(url_rest).alias("url_rest")
    )


# ---------------------------------------------------------------- cleaning
@query("text_clean", f"SELECT doc_id, length(text) AS n_in, {S.clean('text')} AS cleaned FROM documents")
def text_clean(spark, sf_dir):
    df = views.table(spark, sf_dir, "documents")
    return df.select("doc_id", F.length("text").alias("n_in"), text.clean_text(F.col("text")).alias("cleaned"))


@query("text_transform", f"SELECT doc_id, length(text) AS n_in, {S.transform('text')} AS transformed FROM {RESUME}")
def text_transform(spark, sf_dir):
    df = views.view(spark, sf_dir, views.RESUME)
    return df.select("doc_id", F.length("text").alias("n_in"), text.transform_text(F.col("text")).alias("transformed"))


# ---------------------------------------------------------------- facts
_YEARS = ", ".join(f"nullif(regexp_extract(lower(text), {S.quote(p)}, 1), '')" for p in V.YEARS_PATTERNS)
_LEVELS = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), {S.quote(w)})" for w in ws) + f" THEN {S.quote(level)}"
    for level, ws in V.EDUCATION_LEVELS.items()
)


@query("years_experience", f"SELECT doc_id, try_cast(coalesce({_YEARS}) AS bigint) AS years FROM {RESUME}")
def years_experience(spark, sf_dir):
    df = views.view(spark, sf_dir, views.RESUME)
    return df.select("doc_id", text.years_experience(F.col("text")).alias("years"))


@query("education_level", f"SELECT doc_id, CASE {_LEVELS} END AS level FROM {RESUME}")
def education_level(spark, sf_dir):
    df = views.view(spark, sf_dir, views.RESUME)
    return df.select("doc_id", text.education_level(F.col("text")).alias("level"))


_FOUND_PHONE = f"SELECT doc_id, regexp_extract(text, {S.quote('1?' + V.PHONE[4:])}, 0) AS raw FROM {RESUME}"


@query(
    "phone_format",
    f"""SELECT doc_id, raw, CASE WHEN raw = '' THEN '' WHEN length(d) = 10 THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:]
    WHEN length(d) = 11 AND d[1] = '1' THEN '+1 (' || d[2:4] || ') ' || d[5:7] || '-' || d[8:] ELSE raw END AS phone
    FROM (SELECT doc_id, raw, {S.sub_all('raw', '[^0-9]', '')} AS d FROM ({_FOUND_PHONE}))""",
)
def phone_format(spark, sf_dir):
    df = views.view(spark, sf_dir, views.RESUME)
    df = df.withColumn("raw", F.regexp_extract("text", "1?" + V.PHONE[4:], 0))
    return df.select("doc_id", "raw", text.format_phone(F.col("raw")).alias("phone"))


@query(
    "path_names",
    """SELECT page_id, lower(regexp_extract(url, '(?:^|/)\\.*[^./][^/]*\\.([^./]*)$', 1)) AS extension,
    replace(list_last(string_split(url || '.pdf', '/')), '.pdf', '') AS name FROM pages""",
)
def path_names(spark, sf_dir):
    df = views.table(spark, sf_dir, "pages")
    name = text.document_name(F.concat("url", F.lit(".pdf")))
    return df.select("page_id", text.file_extension(F.col("url")).alias("extension"), name.alias("name"))


# ---------------------------------------------------------------- sections
_TITLES = S.string_list(V.SECTION_TITLES)
_CONNECTORS = S.string_list(V.CONNECTORS)


def section_sql(view: str, key: str) -> str:
    """Carry-forward by a window: another road to the same rows than the one the operator takes."""
    return f"""SELECT {key}, section, pos, line FROM (
      SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM (
        SELECT *, CASE WHEN len(w) BETWEEN 1 AND {V.MAX_TITLE_WORDS} THEN list_filter(w, lambda x: x IN {_TITLES})[1] END AS title FROM (
          SELECT *, list_filter(regexp_extract_all(lower(line), '[a-z]+'), lambda x: x NOT IN {_CONNECTORS}) AS w FROM (
            SELECT {key}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {view}))))
    WHERE title IS NULL AND section IS NOT NULL AND line <> ''"""


def relevant_sql(view: str, key: str, names: list[str]) -> str:
    order = "list_position([" + ", ".join(S.quote(n) for n in names) + "], section)"
    picked = f"""SELECT {key}, string_agg(line, ' ' ORDER BY {order}, pos) AS joined FROM ({section_sql(view, key)})
      WHERE section IN {S.string_list(names)} GROUP BY {key}"""
    return f"""SELECT v.{key}, {S.transform(f"CASE WHEN {S.trim_u('coalesce(p.joined, chr(32))')} = '' THEN v.text ELSE p.joined END")} AS relevant
      FROM {view} v LEFT JOIN ({picked}) p ON v.{key} = p.{key}"""


@query("section_lines", section_sql(RESUME, "doc_id"))
def section_lines(spark, sf_dir):
    df = views.view(spark, sf_dir, views.RESUME)
    segs = df.select("doc_id", F.explode(sections.segments(sections.split_lines(F.col("text")))).alias("s"))
    lines = segs.select("doc_id", "s.section", F.explode("s.lines").alias("l"))
    return lines.select("doc_id", "section", F.col("l.pos").cast("bigint").alias("pos"), "l.line")


@query(
    "section_map",
    f"""SELECT doc_id, section, count(*) AS n_lines, string_agg(line, '|' ORDER BY pos) AS content
    FROM ({section_sql(RESUME, 'doc_id')}) GROUP BY doc_id, section""",
)
def section_map(spark, sf_dir):
    df = views.view(spark, sf_dir, views.RESUME)
    df = df.withColumn("segs", sections.segments(sections.split_lines(F.col("text"))))
    df = df.select("doc_id", F.explode(sections.section_map(F.col("segs"))).alias("section", "lines"))
    return df.select("doc_id", "section", F.size("lines").cast("bigint").alias("n_lines"), F.array_join("lines", "|").alias("content"))


def relevant(df, names):
    """Adds `relevant`: the text an encoder gets."""
    df = df.withColumn("_segs", sections.segments(sections.split_lines(F.col("text"))))
    return df.withColumn("relevant", sections.relevant_text(F.col("text"), F.col("_segs"), names)).drop("_segs")


@query("relevant_text_resume", relevant_sql(RESUME, "doc_id", V.RESUME_SECTIONS))
def relevant_text_resume(spark, sf_dir):
    return relevant(views.view(spark, sf_dir, views.RESUME), V.RESUME_SECTIONS).select("doc_id", "relevant")


@query("relevant_text_posting", relevant_sql(POSTING, "item_id", V.JOB_SECTIONS))
def relevant_text_posting(spark, sf_dir):
    return relevant(views.view(spark, sf_dir, views.POSTING), V.JOB_SECTIONS).select("item_id", "relevant")


# ---------------------------------------------------------------- pages
_RATIO = "CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, ' ', ''))) / length(text) ELSE 0 END"
_PICKED = f"""SELECT doc_id, page_no, arg_max(text, pick) AS text, arg_max(ratio, pick) AS ratio FROM (
    SELECT *, CASE WHEN x_tol = 3 AND ratio >= {V.MIN_SPACE_RATIO} THEN 100 ELSE ratio + x_tol * 1e-9 END AS pick
    FROM (SELECT *, {_RATIO} AS ratio FROM {PAGE})) GROUP BY doc_id, page_no"""


@query("page_pick", f"SELECT doc_id, cast(page_no AS bigint) AS page_no, text, round(ratio, 6) AS ratio FROM ({_PICKED})")
def page_pick(spark, sf_dir):
    df = P.pick_page_text(views.view(spark, sf_dir, views.PAGE_SPARK))
    return df.select("doc_id", F.col("page_no").cast("bigint").alias("page_no"), "text", F.round("ratio", 6).alias("ratio"))


@query(
    "page_assemble",
    f"""SELECT doc_id, coalesce(string_agg(text || chr(10), '' ORDER BY page_no) FILTER (WHERE text <> ''), '') AS text
    FROM ({_PICKED}) GROUP BY doc_id""",
)
def page_assemble(spark, sf_dir):
    return P.assemble_pages(P.pick_page_text(views.view(spark, sf_dir, views.PAGE_SPARK)))


@query(
    "blank_guard",
    f"""SELECT p.doc_id, cast(p.page_no AS bigint) AS page_no, CASE WHEN {S.trim_u('p.text')} = '' THEN '{V.UNKNOWN_CATEGORY}' ELSE d.lang END AS label
    FROM ({_PICKED}) p JOIN documents d ON d.doc_id = p.doc_id""",
)
def blank_guard(spark, sf_dir):
    picked = P.pick_page_text(views.view(spark, sf_dir, views.PAGE_SPARK))
    rows = picked.join(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", F.col("page_no").cast("bigint").alias("page_no"), text.guard_label(F.col("text"), F.col("lang")).alias("label"))


# ---------------------------------------------------------------- posting pages
def html_sql() -> str:
    """The oracle leaves nesting and quoted ">" aside: no page of the data has any, and its pattern dialect has no possessive repeats."""
    def opening(tag: str) -> str:
        return rf"<{tag}(?:[\s/][^>]*)?>"

    x = S.sub_all("html", r"(?s)<!--.*?-->", "\n")
    flat = "(?is)" + "|".join(rf"{opening(t)}.*?</{t}\s*>" for t in V.DROPPED_TAGS)
    x = S.sub_all(x, flat, "\n")
    root = " ".join(
        f"WHEN regexp_matches(b, {S.quote('(?i)' + opening(t))}) THEN regexp_extract(b, {S.quote('(?is)' + opening(t) + '(.*?)</' + t)}, 1)" for t in [*V.ROOT_TAGS, "body"]
    )
    text_sql = S.sub_all(f"(CASE {root} ELSE b END)", r"(?s)<[!/a-zA-Z?][^>]*>", "\n")
    for name, char in {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&amp;": "&"}.items():
        text_sql = f"replace({text_sql}, '{name}', '{char}')"
    lines = f"list_transform(regexp_split_to_array({text_sql}, {S.quote(html.LINE_END)}), lambda l: {S.trim_u('l')})"
    return f"""SELECT page_id, url, array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10)) AS text
      FROM (SELECT page_id, url, {x} AS b FROM pages)"""


@query("html_text", html_sql())
def html_text(spark, sf_dir):
    df = views.table(spark, sf_dir, "pages")
    return df.select("page_id", "url", html.posting_text(F.col("html")).alias("text"))


@query(
    "html_reject",
    f"""SELECT page_id, status, CASE status WHEN 'bad_url' THEN {S.quote(V.MSG_BAD_URL)} WHEN 'too_short' THEN {S.quote(V.MSG_SHORT_POSTING)} END AS error,
    CASE WHEN status = 'ok' THEN length(text) END AS n_chars FROM (SELECT *, CASE WHEN NOT regexp_matches({S.trim_u('url')}, {S.quote(V.URL_SCHEME)}) THEN 'bad_url'
    WHEN length(text) < {V.MIN_POSTING_CHARS} THEN 'too_short' ELSE 'ok' END AS status FROM ({html_sql()}))""",
)
def html_reject(spark, sf_dir):
    df = P.read_postings(views.table(spark, sf_dir, "pages"))
    return df.select("page_id", "status", "error", F.length("text").cast("bigint").alias("n_chars"))


# Sources: every third posting names a file, whose text is that of the page with the same number.
_SOURCES = f"SELECT item_id, role, CASE WHEN item_id % 3 = 0 THEN concat('jobs/', cast(item_id AS string), '.pdf') ELSE text END AS source FROM {POSTING}"


@query(
    "source_dispatch",
    f"""SELECT s.item_id, s.role, CASE WHEN s.source LIKE '%.pdf' THEN f.text ELSE s.source END AS text
    FROM ({_SOURCES}) s LEFT JOIN (SELECT concat('jobs/', cast(page_id * 2 AS string), '.pdf') AS path, text FROM ({html_sql()})) f ON s.source = f.path
    WHERE s.source NOT LIKE '%.pdf' OR f.text IS NOT NULL""",
)
def source_dispatch(spark, sf_dir):
    posts = views.view(spark, sf_dir, views.POSTING)
    path = F.concat(F.lit("jobs/"), F.col("item_id").cast("string"), F.lit(".pdf"))
    sources = posts.select("item_id", "role", F.when(F.col("item_id") % 3 == 0, path).otherwise(F.col("text")).alias("source"))
    files = views.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("jobs/"), (F.col("page_id") * 2).cast("string"), F.lit(".pdf")).alias("path"),
        html.posting_text(F.col("html")).alias("text"),
    )
    return P.dispatch_sources(sources, files, "item_id").select("item_id", "role", "text")


@query(
    "posting_resolve",
    f"""SELECT page_id, md5(t) AS text_md5, CASE WHEN t IS NULL THEN CASE WHEN {S.trim_u('u')} = '' THEN {S.quote(V.MSG_NO_POSTING)} ELSE {S.quote(V.MSG_SHORT_POSTING)} END END AS error
    FROM (SELECT page_id, u, CASE WHEN {S.trim_u('pasted')} <> '' THEN {S.trim_u('pasted')} WHEN {S.trim_u('u')} <> '' AND length(text) >= {V.MIN_POSTING_CHARS} THEN text END AS t
      FROM (SELECT page_id, text, CASE page_id % 5 WHEN 0 THEN '  ' ELSE url END AS u, CASE page_id % 4 WHEN 0 THEN concat(chr(10), ' ', url, ' ') WHEN 1 THEN ' ' ELSE '' END AS pasted FROM ({html_sql()})))""",
)
def posting_resolve(spark, sf_dir):
    df = P.read_postings(views.table(spark, sf_dir, "pages"))
    pasted = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("\n "), F.col("url"), F.lit(" ")))
        .when(F.col("page_id") % 4 == 1, F.lit(" ")).otherwise(F.lit(""))
    )
    url = F.when(F.col("page_id") % 5 == 0, F.lit("  ")).otherwise(F.col("url"))
    got = P.resolve_posting(pasted, url, F.col("text"), F.col("error"))
    return df.withColumn("got", got).select("page_id", F.md5("got.text").alias("text_md5"), "got.error")


# ---------------------------------------------------------------- passages
def chunk_sql(view: str, key: str) -> str:
    """Greedy packing as a list fold over lines that were first mapped to the fold's state."""
    lines = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {S.trim_u('l')}), lambda l: l <> '')"
    start = "{'done': cast([] AS varchar[]), 'open': ''}"
    state = f"list_prepend({start}, list_transform({lines}, lambda l: {{'done': cast([] AS varchar[]), 'open': l}}))"
    full = f"(a.open <> '' AND length(a.open) + length(b.open) + 1 > {V.MAX_CHUNK_CHARS})"
    fold = f"""list_reduce({state}, lambda a, b: {{'done': CASE WHEN {full} THEN list_append(a.done, a.open) ELSE a.done END,
      'open': CASE WHEN {full} OR a.open = '' THEN b.open ELSE a.open || ' ' || b.open END}})"""
    return f"""SELECT {key}, unnest(list_transform(all_chunks, lambda c, i: {{'chunk_no': i, 'text': c}}), recursive := true) FROM (
      SELECT {key}, CASE WHEN f.open <> '' THEN list_append(f.done, f.open) ELSE f.done END AS all_chunks FROM (SELECT {key}, {fold} AS f FROM {view}))"""


def chunk_rows(df, key):
    """(key, chunk_no, text), numbered from 1 in document order."""
    packed = df.select(key, F.posexplode(chunks.passages(F.col("text"))).alias("at", "text"))
    return packed.select(key, (F.col("at") + 1).cast("bigint").alias("chunk_no"), "text")


@query("chunks_posting", chunk_sql(POSTING, "item_id"))
def chunks_posting(spark, sf_dir):
    return chunk_rows(views.view(spark, sf_dir, views.POSTING), "item_id")


@query("chunks_resume", chunk_sql(RESUME, "doc_id"))
def chunks_resume(spark, sf_dir):
    return chunk_rows(views.view(spark, sf_dir, views.RESUME), "doc_id")


# ---------------------------------------------------------------- replies
_SQL_SCORE = f"least(100, greatest(0, cast(nullif(regexp_extract(raw, {S.quote(V.SCORE)}, 1), '') AS int)))"
_SQL_LINE = r"(?m)^.*" + V.SCORE.replace("(", "(?:") + r".*$\n?"
SCORE_SQL = f"""CASE WHEN regexp_matches(raw, {S.quote(V.SCORE)}) THEN {_SQL_SCORE} END"""
FEEDBACK_SQL = S.trim_u(f"regexp_replace(raw, {S.quote(_SQL_LINE)}, '')")


@query("split_score", f"SELECT conv_id, turn, {SCORE_SQL} AS score, {FEEDBACK_SQL} AS feedback FROM {REPLY}")
def split_score(spark, sf_dir):
    df = views.view(spark, sf_dir, views.REPLY)
    return df.select(
        "conv_id", "turn", replies.reply_score(F.col("raw")).alias("score"), replies.reply_feedback(F.col("raw")).alias("feedback")
    )


@query(
    "score_band",
    f"""SELECT conv_id, turn, score, CASE WHEN score >= 70 THEN 'Strong match' WHEN score >= 45 THEN 'Moderate match' WHEN score IS NOT NULL THEN 'Weak match' END AS band
    FROM (SELECT conv_id, turn, {SCORE_SQL} AS score FROM {REPLY})""",
)
def score_band(spark, sf_dir):
    df = views.view(spark, sf_dir, views.REPLY).withColumn("score", replies.reply_score(F.col("raw")))
    return df.select("conv_id", "turn", "score", replies.score_band(F.col("score")).alias("band"))
