"""CSV records over split borders against Python's own reader of the whole file."""

from __future__ import annotations

import csv
import random

import pytest

from matchloom.sources import labelled
from matchloom.sources.csv_records import read_records

RND = random.Random(4)


def cell():
    return "".join(RND.choice(["a", "b c", '"', ",", "\n", "\r\n", "é", "\n\n", "'", "\\"]) for _ in range(RND.randint(1, 12)))


def write(path, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["Category", "Text", "Extra"])
        w.writerows(rows)


@pytest.fixture
def small_splits(spark):
    for key, value in {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0"}.items():
        spark.conf.set(key, value)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def test_one_file_by_many_tasks(spark, tmp_path, small_splits):
    rows = [[f"k{i}", cell(), "z" * RND.randint(1, 9)] for i in range(300)]
    rows[40][1] = 'long "one"\n' * 400  # fills whole splits
    rows[41][1] = "\n" * 900
    for i, end in enumerate(("\r\n", "\n")):
        path = str(tmp_path / f"{i}.csv")
        write(path, rows, end)
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        got = labelled.read_labelled_csv(spark, path).orderBy("row_id").collect()
        assert [(r["category"], r["text"]) for r in got] == [(a, b) for a, b, _ in rows]
        assert len({r["row_id"] for r in got}) == len(rows)


def test_files_keep_their_order_whatever_their_size(spark, tmp_path, small_splits):
    sizes = {"a": 3, "b": 200, "c": 1, "d": 60, "e": 0}
    want = []
    for name, n in sizes.items():
        rows = [[f"{name}{i}", cell(), "x"] for i in range(n)]
        want += [(a, b) for a, b, _ in rows]
        write(str(tmp_path / f"{name}.csv"), rows)
    got = labelled.read_labelled_csv(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [(r["category"], r["text"]) for r in got] == want


def test_same_rows_and_ids_whatever_the_tasks(spark, tmp_path, small_splits):
    rows = [["k", cell(), "x"] for _ in range(150)]
    path = str(tmp_path / "x.csv")
    write(path, rows)
    cut = [r["text"] for r in labelled.read_labelled_csv(spark, path).orderBy("row_id").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100m")
    assert [r["text"] for r in labelled.read_labelled_csv(spark, path).orderBy("row_id").collect()] == cut


def test_blank_lines_repeated_headers_and_values_left_open(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b'Category,Text\r\n\r\nA,"x\r\n\r\ny"\r\n\n\nCategory,Text\nB,"never\nclosed')
    got = read_records(spark, str(path)).orderBy("row_id").collect()
    assert [(r["record"], r["first"]) for r in got] == [
        ("Category,Text", True), ('A,"x\r\n\r\ny"', False), ("Category,Text", False), ('B,"never\nclosed', False)]
    rows = labelled.read_labelled_csv(spark, str(path)).orderBy("row_id").collect()
    assert [(r["category"], r["text"]) for r in rows][:2] == [("A", "x\r\n\r\ny"), ("Category", "Text")]


def test_only_a_header_and_nothing(spark, tmp_path):
    write(str(tmp_path / "h.csv"), [])
    assert labelled.read_labelled_csv(spark, str(tmp_path / "h.csv")).count() == 0
