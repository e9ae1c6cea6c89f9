"""Stored logs that streams append to, each row once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET = "bucket"
WRITERS = 8  # parts that write to one folder


def bucket(key: str) -> Column:
    """Folder of a key; a batch reads and writes only the folders of its own keys."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before the first batch has written it."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def in_partitions(rows: DataFrame, name: str, batch: DataFrame) -> DataFrame:
    """``rows`` of the partitions that occur in ``batch``; there are few in a micro-batch."""
    values = [r[0] for r in batch.select(name).distinct().collect()]
    return rows.where(F.col(name).isin(values))


def append_new(rows: DataFrame, path: str, key: list[str], partition: str,
               make: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Appends the rows whose key is not stored yet, so a repeated batch adds nothing.

    ``make`` turns these rows into what is stored, with the same key and partition; rows that are
    stored already are not made again.
    """
    held = stored(rows.sparkSession, path)
    if held is not None:
        known = in_partitions(held, partition, rows).select(*[F.col(k).alias(f"_{k}") for k in key])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        rows = rows.join(known, reduce(and_, same), "left_anti")
    # Dealt by folder first, so that files do not multiply with the tasks.
    part = F.pmod(F.xxhash64(*key), F.lit(WRITERS))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    make(rows.repartition(tasks, partition, part)).write.mode("append").partitionBy(partition).parquet(
        path)
