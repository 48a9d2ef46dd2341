"""The registry, the pipeline's stages, and guards around them."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from tidewatch.llm import linededup, registry, simhash

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2:3].isdigit()} == set(range(1, 14)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(registry.queries())


@needs_tables
def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        if name != "mix_sources":
            assert 0 < docs.count() <= before
            before = docs.count()
        if name == "near_dedup":
            found = simhash.near_duplicates(docs)
            assert found.filter("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@needs_tables
def test_stages_on_odd_rows(spark):
    long = " ".join(f"word{i % 997}x" for i in range(20_000))
    shared = "a line of several words that stands in two documents"
    texts = [None, "", " ", "x²", "12 34", long, long, f"first one\n{shared}", f"second one\n{shared}", shared, "tie tie tie", "tie tie tie"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None, None]
    rows = [(i, t, "en", "web", len(t or ""), "a", "b", "c") for i, t in zip([*ids, 8], [*texts, texts[7]], strict=True)]
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, `a.b` string"
    for docs in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        columns, some = docs.columns, not docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF).persist()
            assert docs.columns == columns and (docs.count() > 0) == some, name
            left = {r["doc_id"] for r in docs.collect()}
            if name == "language_id" and some:
                assert left == {4, 6, 7, 8, 9, 10, None}
            if name == "line_dedup" and some:
                assert left == {4, 6, 8, 9, None}
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (packed.count() > 0) == some


@needs_tables
def test_line_dedup_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(linededup.ORACLE_SQL).fetchall())
    found = linededup.query(spark, SF).select("doc_id", "line_count", "dropped_count", "text").collect()
    assert sorted(map(tuple, found)) == want
