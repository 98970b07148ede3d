"""Registered queries against their SQL and against each other, and the pipeline's stages."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from twinarm.llm import queries as llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(llm.oracle_sql()[name]), llm.queries()[name](spark, SF)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "personal data", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "stage")
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    assert set(entry.queries()) >= {"pipeline", *llm.queries()}


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_with_hostile_rows(spark, empty):
    """Nulls, empty and long texts, repeated rows and ids, and further columns of names that the operators use."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("length(text) between 300 and 3000").limit(2).collect()
    rows = [(None, None), (10_001, None), (10_002, ""), (10_003, "word " * 30_000), (10_004, "mail me@host.org"), (10_004, "mail me@host.org"), (10_005, "one two"), (10_005, "three four"), (None, "no id"), (10_006, clean[0]["text"])]
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t) if t else None) for i, t in rows], docs.schema)
    docs = docs.unionByName(extra).where(F.lit(not empty)).withColumns({c: F.lit(1) for c in ("_row", "score", "hit", "number", "node", "part")})
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        held[name] = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    if empty:
        assert not packed and not any(held.values())
        return
    kept = held["near duplicates"]
    for row, times in (((None, None), 1), ((10_001, None), 1), ((10_002, ""), 1), ((10_004, "mail me@host.org"), 1), ((10_005, "one two"), 1), ((10_005, "three four"), 1), ((None, "no id"), 1), ((10_006, clean[0]["text"]), 0)):
        assert kept.count(row) == times, row
    assert held["personal data"].count((10_004, "mail [EMAIL]")) == 1
    assert {r["doc_id"] for r in packed} == {d for d, _ in held["personal data"]} and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
