"""The pipeline, and every registered query, on odd and on empty tables."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lorespark.llm.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect


def test_stages_on_odd_rows(spark, folders):
    docs = spark.read.parquet(f"{folders['edge']}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = step(spark, docs, folders["edge"])
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if i < 4:
            assert docs.columns == columns
        if i < 3:
            assert 0 < docs.count() <= last
            last = docs.count()
        if i == 0:
            assert docs.filter("text is null or not text rlike '[[:alpha:]]|\\\\p{L}'").count() == 0
        if i == 1:
            assert max(Counter(r.text for r in docs.collect()).values()) == 1
    bins = defaultdict(int)
    for r in docs.collect():
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048


def test_empty_table(spark, folders):
    assert corpus_pipeline.run(spark, folders["none"]).count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op3_topk", "op12_vector_codes")])  # these read vectors
def test_query_on_odd_tables(spark, folders, name):
    docs = spark.read.parquet(f"{folders['edge']}/documents.parquet").count()
    got = QUERIES[name](spark, folders["edge"]).count()
    assert got == docs if name != "op5_packing" else got >= docs
    assert QUERIES[name](spark, folders["none"]).count() == 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    status, _, _, note = compare(spark, connect(small), small, name, QUERIES[name], ORACLES[name])
    assert status == "ok", note
