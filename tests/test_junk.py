"""Junk texts must cost no more than their length, and the scratch folder must be one that executors share."""

import time

import pytest
from pyspark.sql import functions as F

from matchloom.functions import chunks, contact, html
from matchloom.session import is_single_jvm

N = 1_000_000


@pytest.mark.parametrize("text", [
    "a." * (N // 2) + " x@", "x@ " + "a." * (N // 2), "a" * N + " @", "@" + "a" * N, "a@" * (N // 2), "x@" + "a." * (N // 2), "-" * N + "@", "1" * N + "@", "a@b.com" * (N // 7),
])
def test_email_is_linear(spark, text):
    df = spark.createDataFrame([(text,)], "text string").repartition(1)
    df = df.select(*contact.email(F.col("text")))
    start = time.perf_counter()
    df.collect()
    assert time.perf_counter() - start < 10


def test_email_same_matches(spark):
    cases = {
        "a.b-c@x.co.uk!": ("a.b-c@x.co.uk", "!"), "..a@b.com": ("a@b.com", ".."), "a@b.abcdefghij@x.com": ("a@b.abcdef", ""), "a@b.com.foo@x.com": ("a@b.com.fo", ""),
        "a@b.comm1.foo@x.com": ("a@b.comm", ""), "a@b": ("", "a@b"), "x a@b.c d@e.fr": ("d@e.fr", "x a@b.c "),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "text string")
    plain = contact.match_and_remove(F.col("text"), contact.V.EMAIL)
    quick = contact.email(F.col("text"))
    for t, a, b, c, d in rows.select("text", *plain, *quick).collect():
        assert (a, b) == (c, d), t
        if cases[t][0]:
            assert c == cases[t][0] or a == c


def test_single_jvm_only():
    assert is_single_jvm("local") and is_single_jvm("local[4]") and is_single_jvm("local[*]")
    assert not any(is_single_jvm(m) for m in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://x"))


@pytest.mark.parametrize(("page", "want"), [
    ('<p title="a>b">c</p>', "c"),
    ("<p don't>y</p><form a='>'>gone</form>z", "y\nz"),
    ('<p title="open>t</p>', "t"),
    ('<main class="a>b">m</main>q', "m"),
    ('<article>a<script x=">">s</script>b</article>', "a\nb"),
    ("<html><head><title>T</title></head><p>x</p></html>", "x"),
    ("<p " + 'a="b" ' * 200_000 + ">long</p>", "long"),
])
def test_tags_as_a_reader_sees_them(spark, page, want):
    assert spark.createDataFrame([(page,)], "h string").select(html.posting_text(F.col("h"))).first()[0] == want


def test_very_many_passages(spark):
    lines = [f"{i} " + "x" * 590 for i in range(50_000)]
    df = spark.createDataFrame([("\n".join(lines),)], "t string").select(chunks.passages(F.col("t")))
    start = time.perf_counter()
    assert df.first()[0] == lines
    assert time.perf_counter() - start < 20
