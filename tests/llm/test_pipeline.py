"""The pipeline against a version of its stages that compares everything with everything, and the registration."""

from __future__ import annotations

import corpus_pipeline
import duckdb
import pytest

from matchloom.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    same, note = compare(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR)
    assert same, note


def test_stages(spark, tmp_path):
    """Each stage's rows follow from its own input: what SQL says of near copies, tests and mixing holds there too."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = str(tmp_path / f"{k}")
        stage(spark, docs, SF_DIR).write.parquet(out)
        docs = spark.read.parquet(out)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF_DIR}/benchmark.parquet'")
        con.register("documents", before.toPandas())
        got = {r["doc_id"] for r in docs.collect()}
        had = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "language":
            assert got == {i for i, t in had.items() if any(c.isalpha() for c in t or "")}
        elif name == "lines":
            deleted = {i: [int(p) for p in d.split(",")] for i, d in con.execute(f"SELECT doc_id, deleted FROM ({ORACLES['op6_line_dedup']}) WHERE deleted <> ''").fetchall()}
            left = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in deleted.get(i, ())) for i, t in had.items()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: t for i, t in left.items() if i not in deleted or t.strip(" ")}
        elif name == "near copies":
            assert got == {i for (i,) in con.execute(f"SELECT doc_id FROM ({ORACLES['op8_minmax_near_dups']}) WHERE kept").fetchall()}
        elif name == "benchmark":
            assert got == {i for (i,) in con.execute(f"SELECT doc_id FROM ({ORACLES['op2_decontamination']}) WHERE NOT contaminated").fetchall()}
        else:
            want = con.execute(f"SELECT doc_id, taken // size FROM ({ORACLES['op4_mixture']}) WHERE taken > 0").fetchall()
            assert {(r["doc_id"], r["copies"]) for r in docs.collect()} >= set(want)
        assert docs.columns == (columns if k + 1 < len(corpus_pipeline.STAGES) else [*columns, "copies"])


def test_stages_of_odd_tables(spark):
    """Null ids and texts, an id on two texts, extra columns with the names that the stages use, and no rows at all."""
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = "The quick brown fox of the house is not here, and it was never seen in that garden by the old man or his dog again."
    rows = [(1, clean, "en", "s", 9, 0, 0, 0, 0), (1, item, None, "s", 9, 0, 0, 0, 0), (None, item, "en", None, 9, 0, 0, 0, 0), (None, clean.upper() + " Now", "xx", "t", 9, 0, 0, 0, 0),
            (2, None, "en", "s", 0, 0, 0, 0, 0), (3, "", "en", "s", 0, 0, 0, 0, 0), (4, "12 34 !", "en", "t", 7, 0, 0, 0, 0)]
    extra = ["_told", "_copy", "_contaminated", "_deleted"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{e} int" for e in extra)
    docs = spark.createDataFrame(rows, schema)
    by_name = dict(corpus_pipeline.STAGES)
    got = by_name["benchmark"](spark, docs, SF_DIR).collect()
    assert item not in {r["text"] for r in got} and len(got) == 5
    told = by_name["language"](spark, docs, SF_DIR).collect()
    assert len(told) == 4 and {r["lang"] for r in told} == {"en"}
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert len([q for q in entry.queries() if q.startswith("op")]) == 13
