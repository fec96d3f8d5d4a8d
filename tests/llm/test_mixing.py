"""Mixing: texts are read once, sizes and weights against plain Python."""

import re

from pyspark.sql import functions as F

from lorespark.llm.op8_mixing import mix_sources, query, text_quality, words_in

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def test_result_reads_no_text(spark, folders):
    # sizes and keys are written once: what is left to do reads no document
    mixed = query(spark, folders["edge"])
    assert mixed.columns == COLUMNS
    assert not [f for f in mixed.inputFiles() if "documents.parquet" in f]


def test_kept_columns_do_not_change_the_mix(edge_docs, no_docs):
    quality = text_quality(F.col("text"))
    whole = mix_sources(edge_docs, quality)
    few = mix_sources(edge_docs, quality, keep=["doc_id"])
    assert few.columns == COLUMNS
    assert sorted(map(repr, few.collect())) == sorted(map(repr, whole.select(*COLUMNS).collect()))
    assert mix_sources(no_docs, quality, keep=["doc_id"]).count() == 0


def test_sizes_and_weights_of_odd_texts(spark):
    spaces = " \t\n\x0b\x0c\r"
    texts = [None, "", " ", spaces, "a", " a ", f"a{spaces}b", f"{spaces}a b{spaces}", "a\x1cb\x1d\x1e\x1f c\x85d", "a\xa0b\u2003c\u3000 d", "\ufeffa", "a\x00b \x00", "\U0001d4b3 \xe9 ", "a b " * 20_000, " " * 50_000]
    texts += ["#*$%&|<>{}[]\\^~=", "a # b", "\xe9#\U0001d4b3", "a-b.c!", "[^a]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.n, r.weight) for r in rows.select("id", words_in(F.col("text")).alias("n"), text_quality(F.col("text")).alias("weight")).collect()}
    for i, text in enumerate(texts):
        plain = [c for c in text or "" if c not in "#*$%&|<>{}[]\\^~="]
        assert got[i][0] == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), repr(text)
        assert abs(got[i][1] - ((len(plain) / len(text)) ** 8 if text else 1)) < 1e-12, repr(text)
