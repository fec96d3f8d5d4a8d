"""Exact de-duplication and idempotent appends on content keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lorespark.functions.ordered import first_arrivals


def exact_duplicates(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, sha256, winner_id, is_duplicate): the lowest id per content wins.

    Only ids and digests are shuffled, never the texts. Winners come from a
    map-side aggregate; the join back is many-to-one on the digest, which
    adaptive execution splits when one digest is hot.
    """
    keyed = df.select(id_col, F.sha2(F.col(content), 256).alias("sha256"))
    winners = first_arrivals(keyed, "sha256", [id_col], [id_col]).select(
        "sha256", F.col(id_col).alias("winner_id")
    )
    return keyed.join(winners, "sha256").select(
        id_col, "sha256", "winner_id", (F.col(id_col) != F.col("winner_id")).alias("is_duplicate")
    )


def keep_first_copies(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """The rows whose content was seen first; joins on the unique id, so no skew."""
    keyed = df.select(id_col, F.sha2(F.col(content), 256).alias("sha256"))
    winners = keyed.groupBy("sha256").agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(winners, id_col, "left_semi")


def split_new(
    candidates: DataFrame, history: DataFrame, identity: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows already present) by a null-free identity tuple."""
    known = history.select(*identity)
    fresh = candidates.join(known, list(identity), "left_anti").dropDuplicates(list(identity))
    reused = candidates.join(known, list(identity), "left_semi")
    return fresh, reused


def append_new(
    candidates: DataFrame,
    path: str,
    identity: Sequence[str],
    partition_by: Sequence[str] = (),
) -> None:
    """Append the rows of ``candidates`` not stored at ``path`` yet (runs a job)."""
    spark = candidates.sparkSession
    try:
        history = spark.read.parquet(path)
    except Exception as error:  # first write: the folder does not exist
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = candidates.dropDuplicates(list(identity))
    else:
        fresh, _ = split_new(candidates, history, identity)
    writer = fresh.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
