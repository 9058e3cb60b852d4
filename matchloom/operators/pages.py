"""From page candidates to document text, and from sources to posting text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions import html as H
from matchloom.functions import text as T


def pick_page_text(candidates: DataFrame) -> DataFrame:
    """(doc_id, page_no, x_tol, text) -> (doc_id, page_no, text, ratio).

    The default tolerance stays when it is spaced well enough; else the best space ratio wins, and of
    equal ones the larger tolerance. Only numbers are grouped; the chosen texts are fetched by their key, one row for each (doc_id, page_no, x_tol).
    """
    ratio = T.space_ratio(F.col("text"))
    good_default = (F.col("x_tol") == V.DEFAULT_TOLERANCE) & (ratio >= V.MIN_SPACE_RATIO)
    # Good defaults first, then the ratio, then the tolerance: three numbers, so that texts take no part in the grouping, which is done once.
    keys = ["doc_id", "page_no"]
    place = F.struct(F.when(good_default, 2.0).otherwise(ratio).alias("rank"), "x_tol", ratio.alias("ratio"))
    chosen = candidates.groupBy(*keys).agg(F.max(place).alias("_best")).select(*keys, "_best.x_tol", "_best.ratio")
    return candidates.select(*keys, "x_tol", "text").join(chosen, [*keys, "x_tol"]).select(*keys, "text", "ratio")


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) -> (doc_id, text): pages in order, each non-empty one closed by a line end."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    filled = F.filter(ordered, lambda p: p["text"] != "")
    body = F.array_join(F.transform(filled, lambda p: F.concat(p["text"], F.lit("\n"))), "")
    return pages.groupBy("doc_id").agg(body.alias("text"))


def dispatch_sources(sources: DataFrame, files: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Sources that name a file take its text from `files(path, text)`; others are the text themselves.

    A named file that is not there drops out, as a document would that cannot be found. `key` tells sources
    apart that name the same file.
    """
    s = F.col(source)
    texts = files.select(F.col("path").alias(source), F.col("text"))
    named = sources.where(T.is_pdf_source(s)).join(texts, source)
    raw = sources.where(~T.is_pdf_source(s)).withColumn("text", s)
    return raw.unionByName(named.select(raw.columns))


def read_postings(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds `text`, `status` and `error`; the text of a rejected page is null."""
    out = pages.withColumn("_text", H.posting_text(F.col(html)))
    status = (
        F.when(~T.is_web_url(F.col(url)), F.lit("bad_url"))
        .when(F.col("_text").isNull() | T.too_short(F.col("_text")), F.lit("too_short"))
        .otherwise(F.lit("ok"))
    )
    out = out.withColumn("status", status)
    error = F.when(F.col("status") == "bad_url", F.lit(V.MSG_BAD_URL)).when(F.col("status") == "too_short", F.lit(V.MSG_SHORT_POSTING))
    return out.withColumns({"text": F.when(F.col("status") == "ok", F.col("_text")), "error": error}).drop("_text")


def resolve_posting(pasted: Column, url: Column, fetched: Column, fetch_error: Column) -> Column:
    """STRUCT<text, error>: pasted text wins, then the fetched one, then the reason there is none."""
    own = F.nullif(T.trim_u(F.coalesce(pasted, F.lit(""))), F.lit(""))
    no_url = T.is_blank(url)
    text = F.coalesce(own, F.when(~no_url, fetched))
    error = F.when(text.isNull(), F.when(no_url, F.lit(V.MSG_NO_POSTING)).otherwise(fetch_error))
    return F.struct(text.alias("text"), error.alias("error"))
