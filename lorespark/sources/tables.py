"""Readers for the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.session import prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


#: Session setting: deal rows of long texts into so many parts while reading.
READ_PARTS = "spark.lorespark.read.partitions"
LONG = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, folder: str, name: str, partitions: int | None = None) -> DataFrame:
    """One input table; its splits follow ``spark.sql.files.maxPartitionBytes``.

    A file of one row group is one split, whatever that size. ``partitions``,
    or the setting ``READ_PARTS`` for tables of long texts, deals its rows into
    more parts; inputs of many row groups need neither.
    """
    table = prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    if partitions is None and name in LONG:
        partitions = int(spark.conf.get(READ_PARTS, "0"))
    return table.repartition(partitions) if partitions else table


def read_files(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """Raw files as (path, size_bytes, content BINARY) for the corpus scans."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.selectExpr("path", "length AS size_bytes", "content")
