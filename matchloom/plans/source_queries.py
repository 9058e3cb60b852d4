"""Sources, sinks and the incremental guard, each over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from matchloom import fixed_values as V
from matchloom.functions.text import percent
from matchloom.plans import sqltext as S
from matchloom.plans import views
from matchloom.plans.corpus_queries import metrics_record
from matchloom.plans.registry import ORACLES, query
from matchloom.sources import files, labelled, records, tables
from matchloom.streaming import incremental


@query("csv_roundtrip", f"SELECT lang AS category, md5(text) AS text_md5 FROM documents WHERE text NOT IN {S.string_list(V.NA_TOKENS)}")
def csv_roundtrip(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(F.col("lang").alias("Category"), F.col("text").alias("Text"))
    folder = tables.scratch_folder(spark, "labelled")
    labelled.write_labelled_csv(docs, folder)
    return labelled.read_labelled_csv(spark, folder).select("category", F.md5("text").alias("text_md5"))


@query("json_roundtrip", ORACLES["metrics_record"])
def json_roundtrip(spark, sf_dir):
    path = tables.scratch_folder(spark, "metrics")
    records.write_metrics(metrics_record(spark, sf_dir), path)
    return records.read_metrics(spark, path)


@query(
    "metrics_shown",
    f"""SELECT n_resumes, cast(n_categories AS varchar) AS n_categories, 0.0 AS holdout_top1_accuracy, holdout_top3_accuracy, holdout_macro_f1, '' AS trained_at,
      concat(cast(cast(round(holdout_top3_accuracy * 100, 0) AS int) AS varchar), '%') AS top3_shown FROM ({ORACLES["metrics_record"]})""",
)
def metrics_shown(spark, sf_dir):
    """The record as it is displayed, of a file in which two fields are missing."""
    path = tables.scratch_folder(spark, "metrics")
    records.write_metrics(metrics_record(spark, sf_dir).drop("trained_at", "holdout_top1_accuracy"), path)
    shown = records.with_display_defaults(records.read_metrics(spark, path))
    return shown.withColumn("top3_shown", F.concat(percent(F.col("holdout_top3_accuracy"), 0).cast("int").cast("string"), F.lit("%")))


#: Pages of a file of the scanned folder, at most.
FILE_PAGES = 200


def _links(name: str, content: bytes) -> str:
    """For each page of the file, a line of its number and how many links it opens."""
    pages = map(json.loads, content.decode().splitlines())
    return "\n".join(f"{p['page_id']} {p['html'].count('<a ')}" for p in pages)


@query("dir_scan", "SELECT page_id, cast((length(html) - length(replace(html, '<a ', ''))) // 3 AS bigint) AS n_links, cast(NULL AS varchar) AS error FROM pages")
def dir_scan(spark, sf_dir):
    """Links of each page, from a folder of files that hold some pages each."""
    folder = tables.scratch_folder(spark, "page_files")
    views.table(spark, sf_dir, "pages").select("page_id", "html").write.option("maxRecordsPerFile", FILE_PAGES).json(folder)
    done = files.process_files(files.scan_directory(spark, folder, ".JSON"), _links)
    rows = done.select(F.explode_outer(F.split("result", "\n")).alias("r"), "error")
    return rows.select(F.split("r", " ")[0].cast("bigint").alias("page_id"), F.split("r", " ")[1].cast("bigint").alias("n_links"), "error")


@query("materialise_once", "SELECT page_id, url, length(html) AS size FROM pages")
def materialise_once(spark, sf_dir):
    path = tables.scratch_folder(spark, "once")
    pages = views.table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("size"))
    tables.materialise_once(pages, path)
    # The second write finds the table in place and leaves it as it is.
    return tables.materialise_once(pages.withColumn("size", F.lit(0).cast("bigint")), path)


# Pages that are known in an earlier version: the size differs where the text has an ampersand.
_NEW_SQL = """SELECT page_id, concat(url, ':', length(html)) AS fingerprint FROM pages
    WHERE concat(url, ':', length(html)) NOT IN (SELECT concat(url, ':', length(replace(html, '&amp;', '&'))) FROM pages)"""


def _sizes(spark, sf_dir):
    """(now, earlier): number, address and size of each page as it is and as it was."""
    pages = views.table(spark, sf_dir, "pages")
    earlier = F.length(F.replace("html", F.lit("&amp;"), F.lit("&")))
    return pages.select("page_id", "url", F.length("html").alias("size")), pages.select("page_id", "url", earlier.alias("size"))


@query("incremental_new", _NEW_SQL)
def incremental_new(spark, sf_dir):
    now, earlier = (incremental.with_fingerprint(df, "url") for df in _sizes(spark, sf_dir))
    return incremental.only_new(now, earlier).select("page_id", "fingerprint")


@query("incremental_stream", _NEW_SQL)
def incremental_stream(spark, sf_dir):
    """The same through a stream: the earlier pages arrive and are worked on, then the stream goes on with those of now."""
    source, results, state = (tables.scratch_folder(spark, n) for n in ("arrivals", "results", "stream"))

    def arrive(df):
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        incremental.process_stream(incremental.with_fingerprint(stream, "url"), lambda rows: rows, results, state).awaitTermination()

    now, earlier = _sizes(spark, sf_dir)
    arrive(earlier)
    done = spark.read.parquet(results).agg(F.max("batch")).first()[0]
    arrive(now)
    return spark.read.parquet(results).where(F.col("batch") > done).select("page_id", "fingerprint")
