"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and read again before the next one. All but the last return the
columns of ``docs``. Null texts are rejected by the first stage; repeated rows
are one group of the second; an empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import replaced, stage, text_of
from lorespark.llm.op4_language import language
from lorespark.llm.op5_packing import pack
from lorespark.llm.op6_substring_dedup import substring_dedup
from lorespark.llm.op7_simhash import simhash_groups
from lorespark.llm.op8_mixing import mix_sources, take_words, text_quality

#: A text is rejected if less than this share of its n-grams is known in its
#: best language; prose has over 0.8, with much junk about 0.4.
LEAST_LANGUAGE = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; no text, no letter or no match: rejected."""
    row = docs.select(F.struct("*").alias("_row"), "text", "lang")
    found = language(row, F.lit(True), ident="_row")
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("id.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group."""
    last = F.lit((1 << 63) - 1)
    keyed = docs.withColumn("_key", F.struct(F.coalesce("doc_id", last).alias("id"), F.xxhash64(text_of(docs)).alias("text")))
    groups = simhash_groups(keyed, ident="_key")
    first = groups.filter(F.col("id") == F.col("component")).select(F.col("id").alias("_key")).distinct()
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a text that loses nothing stays as it is, one that loses all goes."""
    cut = F.size("spans") > 0
    found = substring_dedup(docs)
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    changed = replaced(found.filter(~cut | (F.col("kept") != "")), text=text, n_chars=F.length(text).cast("long"))
    return changed.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = take_words(mix_sources(docs, text_quality(F.col("text"))))
    return replaced(taken, n_chars=F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their places in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_near_copies),
    ("substring_dedup", without_repeats),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed),
]

#: The stages are models, hashes and token ids that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
