"""From raw texts to ranked answers in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorespark.functions import hashing, text as tx
from lorespark.operators import chunking, search
from lorespark.session import cut_lineage
from lorespark.sources import corpus


def unique_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, clean): usable texts, the first of equal ones.

    One exchange of the texts; copies are already merged before it. A join back
    to the winners would exchange them as well, and clean them a second time.
    """
    usable = corpus.usable_text(docs, "text").filter("usable").select("doc_id", "clean")
    return usable.groupBy("clean").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "clean")


def cut(texts: DataFrame) -> DataFrame:
    return chunking.plain_windows(texts, "doc_id", "clean").select("doc_id", "ordinal", F.col("chunk_text").alias("text"))


def described(chunks: DataFrame, keywords=search.rules.CLASSIFIER_KEYWORDS) -> DataFrame:
    """Hash, category and word count of (doc_id, ordinal, text)."""
    none = F.array().cast("array<string>")
    return chunks.select(
        "doc_id", "ordinal",
        hashing.chunk_hash(F.col("text"), F.lit("paragraph"), none).alias("content_hash"),
        search.classify(F.col("text"), keywords).alias("category"),
        tx.word_count(F.col("text")).alias("word_count"),
    )


def answer(docs: DataFrame, queries: DataFrame, limit: int = 10, keywords=search.rules.CLASSIFIER_KEYWORDS) -> DataFrame:
    """Top ``limit`` chunks per query (item_id, text), with their metadata.

    All chunks are ranked by their texts; only documents with a hit are then
    cut once more and described. Runs jobs.
    """
    hits = search.search(cut(unique_texts(docs)), queries, "item_id", "text", ["doc_id", "ordinal"], "text", limit)
    hits = cut_lineage(hits)
    wanted = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = cut(corpus.usable_text(wanted, "text").filter("usable").select("doc_id", "clean"))
    chunks = chunks.join(hits.select("doc_id", "ordinal").distinct(), ["doc_id", "ordinal"], "left_semi")
    return hits.join(described(chunks, keywords), ["doc_id", "ordinal"]).select(
        "item_id", "position", "score", "doc_id", "ordinal", "category", "word_count", "content_hash"
    )
