"""The registered queries against their SQL, and the pipeline stage by stage."""

import collections

import pytest
from oracle import duck, spark_rows

import corpus_pipeline
from weirgate.llm import minhash_dedup, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    want_columns, want = duck(SF, queries.oracle_sql()[name])
    columns, got = spark_rows(queries.queries()[name](spark, SF))
    assert columns == want_columns and got == want


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 4:
            assert tables[-1].columns == docs.columns, name
    ids = [[r["doc_id"] for r in t.select("doc_id").collect()] for t in tables]
    good = {r["doc_id"] for r in quality.ledger(docs).where("failures = 0").collect()}
    assert set(ids[1]) == good and len(ids[1]) == len(good)
    lower = lambda t: t.encode().lower()
    texts = {r["doc_id"]: lower(r["text"]) for r in tables[1].collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert sorted(ids[2]) == sorted(first.values())
    near = minhash_dedup.near_duplicates(tables[2]).collect()
    assert sorted(ids[3]) == sorted({r["component_id"] for r in near})
    copies = collections.Counter(ids[4])
    assert set(copies) <= set(ids[3]) and max(copies.values()) <= 2
    pieces = collections.Counter(r["doc_id"] for r in tables[5].where("piece = 0").collect())
    assert pieces == copies
