"""Readers for the supplied parquet tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Rows of a wide table that one task of a large join or sort holds: a few hundred MB, so that it needn't spill.
ROWS_PER_TASK = 400_000
# Rows that are worth a file of their own.
ROWS_PER_FILE = 100_000
# A table of so many rows is large whatever the session's number of partitions: what is written of it is worth a denser
# form, and a batch of it meets so many stored keys that it doesn't pay to reduce them first.
LARGE_ROWS = 1_000_000


def partitions_for(spark: SparkSession, rows: int, per_task: int | None = None) -> int:
    """Partitions for a shuffle of ``rows`` rows: as many as the session asks for, more if their tasks would hold too much."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / (per_task or ROWS_PER_TASK)))


def files_for(spark: SparkSession, rows: int) -> int:
    """Files for an export of ``rows`` rows: of ``ROWS_PER_TASK`` rows at most, on average; a small one isn't cut up into as many as the session has
    partitions, since each file costs its readers a task and a stream a part of a batch."""
    return max(1, math.ceil(rows / ROWS_PER_TASK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_FILE)))


def outgrows(spark: SparkSession, rows: int) -> bool:
    """Whether ``rows`` rows are too many for the session's number of partitions."""
    return partitions_for(spark, rows) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` if its ``rows`` are too many for the session's number of partitions; else as it is."""
    return df.repartition(partitions_for(df.sparkSession, rows), *keys) if outgrows(df.sparkSession, rows) else df
