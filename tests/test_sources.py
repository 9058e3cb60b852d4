"""Sources, sinks and the incremental stream."""

import pytest
from pyspark.sql import functions as F

from matchloom.sources import files, labelled, records, tables
from matchloom.streaming import incremental


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Category,Text,Extra\nA,"two\nlines, ""quoted""",1\nB,NaN,1\n,x,1\nC,y,\nA,z,2\nD,z,3\n')
    rows = labelled.read_labelled_csv(spark, str(tmp_path / "c.csv")).orderBy("row_id").collect()
    assert [(r["category"], r["text"]) for r in rows] == [("A", 'two\nlines, "quoted"'), ("A", "z"), ("D", "z")]
    first = labelled.read_corpus(spark, str(tmp_path / "c.csv")).collect()
    assert {(r["category"], r["text"]) for r in first} == {("A", 'two\nlines, "quoted"'), ("A", "z")}


def test_directory_scan(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "B.PDF").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.pdf").write_bytes(b"deep")

    def work(name, content):
        if content == b"bad":
            raise ValueError("cannot read")
        return content.decode().upper()

    got = {r["filename"]: (r["result"], r["error"]) for r in files.process_files(files.scan_directory(spark, str(tmp_path)), work).collect()}
    assert got == {"a.pdf": ("ABC", None), "B.PDF": (None, "ValueError: cannot read")}
    assert files.scan_directory(spark, str(tmp_path / "missing")).count() == 0


def test_metrics_record(spark, tmp_path):
    assert records.read_metrics(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert records.read_metrics(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "m.json").write_text('{\n  "n_resumes": 12085,\n  "holdout_top1_accuracy": 0.8204\n}')
    row = records.with_display_defaults(records.read_metrics(spark, str(tmp_path / "m.json"))).first()
    assert row.asDict() == {
        "n_resumes": 12085, "n_categories": "?", "holdout_top1_accuracy": 0.8204, "holdout_top3_accuracy": 0.0, "holdout_macro_f1": 0.0, "trained_at": "",
    }


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.materialise_once(spark.range(3), path).count() == 3
    assert tables.materialise_once(spark.range(9), path).count() == 3


def test_roles(spark):
    assert tables.role_dimension(spark).count() == 4


def test_only_new_files_are_worked_on(spark, tmp_path):
    source, results, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))

    def arrive(rows):
        spark.createDataFrame(rows, "path string, size long").write.mode("append").parquet(source)

    def run():
        stream = incremental.with_fingerprint(spark.readStream.schema("path string, size long").parquet(source))
        incremental.process_stream(stream, lambda df: df.withColumn("done", F.lit(True)), results, checkpoint).awaitTermination()
        return sorted((r["path"], r["size"]) for r in spark.read.parquet(results).collect())

    arrive([("a.pdf", 1), ("b.pdf", 2)])
    assert run() == [("a.pdf", 1), ("b.pdf", 2)]
    arrive([("a.pdf", 1), ("b.pdf", 3)])  # the same file again, and a changed one
    assert run() == [("a.pdf", 1), ("b.pdf", 2), ("b.pdf", 3)]


def test_files_without_rows_are_remembered_and_damage_stops(spark, tmp_path):
    source, results, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    seen = []

    def work(df):
        seen.extend(sorted(r["path"] for r in df.collect()))
        return df.limit(0)

    def run():
        stream = incremental.with_fingerprint(spark.readStream.schema("path string, size long").parquet(source))
        incremental.process_stream(stream, work, results, checkpoint).awaitTermination()

    for rows in ([("a", 1), ("b", 2)], [("a", 1), ("c", 3)]):
        spark.createDataFrame(rows, "path string, size long").write.mode("append").parquet(source)
        run()
    assert seen == ["a", "b", "c"]
    for path in (tmp_path / "check" / "state").rglob("*.delta"):
        path.write_bytes(b"broken")
    spark.createDataFrame([("d", 4)], "path string, size long").write.mode("append").parquet(source)
    with pytest.raises(Exception):
        run()
