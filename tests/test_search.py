"""Keyword search and listing pages against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import chunk_tables, search
from lorespark.sources.tables import READ_PARTS, read_table


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["ab", "abab", "ana", "banana", "the", "a", "x_y", "it's", "co-op", "zz", "other", "word"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    asks = ["ab the banana", "ana ana it's", "zz", "nothing here", "a", "co-op x_y the the THE", "abab"]
    return [(i, i % 3, t.upper() if i % 5 == 0 else t) for i, t in enumerate(texts)] + [(n, 0, None)], list(enumerate(asks))


def plain_search(chunks, queries, limit):
    out = set()
    for q, ask in queries:
        tokens = [t for t in ask.lower().split() if len(t) >= 2]
        scored = [(sum((text or "").lower().count(t) for t in tokens), doc, part) for doc, part, text in chunks]
        best = sorted((s for s in scored if s[0]), key=lambda s: (-s[0], s[1], s[2]))[:limit]
        out |= {(q, doc, part, score, i + 1) for i, (score, doc, part) in enumerate(best)}
    return out


@pytest.mark.parametrize("most", [search.SMALL_TABLE, 3])
def test_search_in_tasks_and_by_joins(spark, monkeypatch, most):
    monkeypatch.setattr(search, "SMALL_TABLE", most)
    chunks, queries = corpus(2, 300)
    found = search.search(
        spark.createDataFrame(chunks, "doc long, part int, text string").repartition(5), spark.createDataFrame(queries, "q long, ask string"),
        "q", "ask", ["doc", "part"], "text", 7,
    )
    assert {tuple(r) for r in found.select("q", "doc", "part", "score", "position").collect()} == plain_search(chunks, queries, 7)


def test_pages_by_key(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3, 4])) for i in range(250)]
    df = spark.createDataFrame(rows, "id long, size int")
    for down in (False, True):
        want = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if down else r[1]) if r[1] is not None else 0, -r[0] if down else r[0]))
        got, after = [], None
        while page := chunk_tables.listing(df, "size", "id", descending=down, limit=60, after=after).collect():
            assert all(r.total == 250 for r in page)
            got += [(r.id, r["size"]) for r in page]
            after = [page[-1]["size"], page[-1].id]
        assert got == want
    assert chunk_tables.listing(df, "id", "size", limit=1000).count() == 250
    with pytest.raises(ValueError):
        chunk_tables.listing(df, "id", "size", limit=0)


def test_rows_are_dealt_only_if_the_caller_says_so(spark, small):
    assert read_table(spark, small, "documents", 6).rdd.getNumPartitions() == 6
    spark.conf.set(READ_PARTS, "3")
    try:
        assert read_table(spark, small, "documents").rdd.getNumPartitions() == 3
        assert read_table(spark, small, "documents").agg(F.count("*")).first()[0] == 200
    finally:
        spark.conf.unset(READ_PARTS)
    assert read_table(spark, small, "documents").rdd.getNumPartitions() == 1
