"""Edge cases of the column builders."""

import pytest
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions import chunks, contact, html, replies, sections, text, tokens, vectors
from matchloom.operators.jaccard import text_jaccard


def value(spark, build, *args):
    names = [f"a{i}" for i in range(len(args))]
    types = ", ".join(f"{n} {'string' if isinstance(a, (str, type(None))) else 'double'}" for n, a in zip(names, args))
    df = spark.createDataFrame([tuple(args)], types)
    return df.select(build(*[F.col(n) for n in names]).alias("v")).first()["v"]


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert sorted(StopWordsRemover.loadDefaultStopWords("english")) == sorted(V.ENGLISH_STOP_WORDS)


@pytest.mark.parametrize("given, want", [
    ("café-x", "café x"), (None, ""), ("", ""), ("See HTTPS://a.b/c?d now", "see now"), ("a  b\tc", "a b c"),
    ("under_score!", "under_score"), ("https://x.y z", "z"),
])
def test_clean_text(spark, given, want):
    assert value(spark, text.clean_text, given) == want


@pytest.mark.parametrize("given, want", [
    ("Café httpd x", "caf x"), ("A  B\nC", "a b c"), (None, ""), ("see http://a.b c", "see c"),
])
def test_transform_text(spark, given, want):
    assert value(spark, text.transform_text, given) == want


@pytest.mark.parametrize("given, want", [("a/b.tar.GZ", "gz"), (".bashrc", ""), ("a.pdf", "pdf"), ("d.x/f", ""), ("a.", ""), ("..a.b", "b")])
def test_file_extension(spark, given, want):
    assert value(spark, text.file_extension, given) == want


@pytest.mark.parametrize("given, want", [
    ("734.555.0123", "(734) 555-0123"), ("17345550123", "+1 (734) 555-0123"), ("12345", "12345"), ("", ""), (None, ""), ("27345550123", "27345550123"),
])
def test_format_phone(spark, given, want):
    assert value(spark, text.format_phone, given) == want


@pytest.mark.parametrize("given, want", [("a/b/x.pdf.pdf", "x"), ("x.PDF", "x.PDF"), ("x", "x")])
def test_document_name(spark, given, want):
    assert value(spark, text.document_name, given) == want


@pytest.mark.parametrize("given, want", [
    ("5+ years of experience", 5), ("3 yrs experience", 3), ("Experience of 12 years", 12), ("4 years in finance", 4), ("years", None),
    ("4 years in finance, 9 years experience", 9), ("99999999999999999999 years experience", None),
])
def test_years(spark, given, want):
    assert value(spark, text.years_experience, given) == want


@pytest.mark.parametrize("given, want", [("manager", "masters"), ("Ph.D", "phd"), ("b.s", "bachelors"), ("GED", "high_school"), ("xyz", None), ("has", "associates")])
def test_education(spark, given, want):
    assert value(spark, text.education_level, given) == want


def test_gpa_group_and_rest(spark):
    first, rest = contact.gpa(F.col("t"))
    row = spark.createDataFrame([("my Gpa: 3.85/4.0 ok",)], "t string").select(first.alias("f"), rest.alias("r")).first()
    assert tuple(row) == ("3.85/4.0", "my  ok")


def test_details_in_order(spark):
    t = "GPA 3.5 a.b@c.org 734-555-0123 linkedin.com/in/me end"
    row = contact.with_details(spark.createDataFrame([(t,)], "text string")).first()
    assert row["details"].asDict() == {"gpa": "3.5", "email": "a.b@c.org", "phone": "734-555-0123", "linkedin": "linkedin.com/in/me"}
    assert row["rest"].split() == ["end"]
    assert contact.with_details(spark.createDataFrame([("none",)], "text string")).first()["details"].email == ""


@pytest.mark.parametrize("given, want", [
    ("WORK EXPERIENCE", "experience"), ("Technical Skills:", "skills"), ("managed a team of skills here", ""), ("Research Assistant", "research"),
    ("5+ years of experience", "experience"), ("", ""), ("•••", ""), ("Relevant Coursework and the Projects", "coursework"),
])
def test_section_title(spark, given, want):
    assert value(spark, sections.section_title, given) == want


def test_sections_append_and_drop(spark):
    t = "lost\nSkills\nfoo\n \n\nProjects\nSKILLS\nbar"
    got = value(spark, lambda c: sections.section_map(sections.segments(sections.split_lines(c))), t)
    assert got == {"skills": ["foo", " ", "bar"]}


def test_relevant_text_order_and_fallback(spark):
    def build(c):
        return sections.relevant_text(c, sections.segments(sections.split_lines(c)), V.RESUME_SECTIONS)

    assert value(spark, build, "Skills\nsql\nExperience\nA\nB") == "a b sql"
    assert value(spark, build, "Plain Text only") == "plain text only"
    assert value(spark, build, "Skills\n  \nEducation\nX") == "skills education x"


def test_passages(spark):
    t = "aaaa\n  bbbb \n\ncccccccccccccccccccc\ndd\nee"
    assert value(spark, lambda c: chunks.passages(c, 12), t) == ["aaaa bbbb", "c" * 20, "dd ee"]
    assert value(spark, chunks.passages, " \n ") == []


@pytest.mark.parametrize("given, score, rest", [
    ("intro\nSCORE: 135/100 x\nrest\nSCORE: 2", 100, "intro\nrest\nSCORE: 2"), ("SCORE:\n85", 85, ""), ("score: 5", None, "score: 5"), (" x ", None, "x"),
    ("SCORE: 7", 7, ""),
])
def test_reply(spark, given, score, rest):
    assert value(spark, replies.reply_score, given) == score
    assert value(spark, replies.reply_feedback, given) == rest


@pytest.mark.parametrize("score, band", [(70.0, "Strong match"), (69.0, "Moderate match"), (45.0, "Moderate match"), (44.0, "Weak match")])
def test_band(spark, score, band):
    assert value(spark, replies.score_band, score) == band


@pytest.mark.parametrize("given, want", [
    ("<body><nav>n</nav><article><p>a &amp; b<br>c</p></article>x</body>", "a & b\nc"),
    ("<main>m</main><article>a</article>", "m"),
    ("<p>&lt;b&gt; &#233;&#xe9;&nbsp;&bogus; & x</p>", "<b> éé\xa0&bogus; & x"),
    ("a<!-- <b>no</b> -->b", "a\nb"),
    ("<script>if (a<b) {}</script><STYLE>x</STYLE>t", "t"),
    ("<article>one<article>two</article>three</article>four", "one\ntwo\nthree"),
    ("<svg><svg>x</svg>y</svg>z", "z"),
    ("<header>h</header><navigator>kept</navigator>", "kept"),
    ("<body>open <form>gone</form> end", "open\nend"),
])
def test_html(spark, given, want):
    assert value(spark, html.posting_text, given) == want


@pytest.mark.parametrize("a, b, want", [("", "x", 0.0), ("!!", "??", 0.0), ("A b", "b c", 1 / 3), (None, "x", 0.0), ("same", "same", 1.0)])
def test_jaccard(spark, a, b, want):
    assert value(spark, text_jaccard, a, b) == pytest.approx(want)


def test_grams_after_stop_words(spark):
    assert value(spark, lambda c: tokens.one_two_grams(tokens.content_words(c)), "The quick brown of fox") == [
        "quick", "brown", "fox", "quick brown", "brown fox",
    ]
    assert value(spark, lambda c: tokens.one_two_grams(tokens.content_words(c)), "a") == []


def test_unit_and_dot(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    row = df.select(vectors.unit(F.col("a")).alias("u"), vectors.unit(F.col("z")).alias("z"), vectors.dot(F.col("a"), F.col("a")).alias("d")).first()
    assert row["u"] == pytest.approx([0.6, 0.8]) and row["z"] == [0.0, 0.0] and row["d"] == 25.0


def test_long_link_and_long_blank_run(spark):
    link = "http://a.b/" + "x%20y" * 20000
    first, rest = contact.url(F.col("t"))
    row = spark.createDataFrame([(f"see {link} now",)], "t string").select(first.alias("f"), rest.alias("r")).first()
    assert row["f"] == link and row["r"] == "see  now"
    assert value(spark, text.trim_u, " a" + " " * 200000 + "b \n") == "a" + " " * 200000 + "b"


def test_page_candidates_are_grouped_once(spark):
    from matchloom.operators import pages

    rows = [(1, 0, 3, "ab"), (1, 0, 2, "a b"), (1, 0, 1, "a b"), (2, 0, 3, "a b c"), (2, 0, 2, "a  b  c"), (3, 1, 2, ""), (3, 1, 1, "")]
    made = pages.pick_page_text(spark.createDataFrame(rows, "doc_id long, page_no int, x_tol int, text string"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Join "), plan.count("Aggregate ")) == (1, 1)
    assert sorted((r["doc_id"], r["text"], round(r["ratio"], 6)) for r in made.collect()) == [(1, "a b", 0.333333), (2, "a b c", 0.4), (3, "", 0.0)]


def test_pages_become_strings_one_at_a_time():
    import pyarrow as pa

    from matchloom.functions import html

    class Pages:
        """A list of pages that no one may take as a whole."""

        def __init__(self, pages):
            self.pages = pages

        def __len__(self):
            return len(self.pages)

        def slice(self, lo, n):
            assert n <= 64
            return self.pages.slice(lo, n)

    made = html._text_nodes(Pages(pa.array([None if i == 70 else f"<body><p>page {i}</p></body>" for i in range(150)], pa.string())))
    assert [None if t is None else t.strip() for t in made.to_pylist()] == [None if i == 70 else f"page {i}" for i in range(150)]
    assert len(html._text_nodes(Pages(pa.array([], pa.string())))) == 0


def test_a_word_is_hashed_once_a_slice(spark, monkeypatch):
    import hashlib

    import pyarrow as pa

    from matchloom.functions import vectors
    from matchloom.operators import embedding

    texts = ["Data lake data ä é lake", "", None, "lake " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["vec"] for r in embedding.hashed(df, "text").collect()}
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([("data",), ("lake",)], "w string").select("w", vectors.hash_bucket(F.col("w")).alias("b")).collect()}
    assert got[0][bucket["data"]] == got[0][bucket["lake"]] == pytest.approx(0.5**0.5) and got[3][bucket["lake"]] == 1.0
    assert [len(got[i]) for i in range(4)] == [vectors.HASH_WIDTH] * 4 and not any(got[1]) and not any(got[2])
    hashed = []
    md5 = hashlib.md5
    monkeypatch.setattr(embedding.hashlib, "md5", lambda w: hashed.append(w) or md5(w))
    assert len(embedding._hashed_rows(pa.array([["data", "lake"] * 50, [], ["data"]], pa.list_(pa.string())), 384)) == 3
    assert sorted(hashed) == [b"data", b"lake"]
