"""Contiguous shards of near equal bytes, cut from global prefix sums.

Rows are put in key order over range partitions; every partition sums its sizes; the running sum
of those totals (one row per partition) gives each partition its place in the whole, and each row
its global byte offset. A row goes to the shard that holds the middle of its bytes, so shards
are contiguous and none misses its target by more than one row.

Defined results: null text has no bytes (a row still counts 8); null keys come first; rows that
repeat a key, or are equal throughout, are dealt out one by one; an empty table gives no rows; with
fewer rows than shards some shards stay empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.llm.common import kept, partitions, pick

ROW_OVERHEAD = 8
PLACED = "doc_id long, size long, text_crc32 long, before long, place long"


def _placed(bases: dict[int, tuple[int, int]]):
    """Adds the bytes and rows before each row, going through a partition in order."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = bases.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            ends = size + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(ends - sizes, pa.int64()),
                pa.array(rows + np.arange(batch.num_rows), pa.int64()),
            ], ["doc_id", "size", "text_crc32", "before", "place"])
            size, rows = size + int(sizes.sum()), rows + batch.num_rows

    return place


def prefix_sums(rows: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32) with the bytes and rows before each, and all bytes.

    The driver sees one total per partition, never rows.
    """
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(
        partitions(rows.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered = kept(spread.select("doc_id", "size", "text_crc32"))
    totals = ordered.groupBy(F.spark_partition_id().alias("part")).agg(
        F.sum("size").alias("size"), F.count("*").alias("rows"))
    bases, size, count = {}, 0, 0
    for part, part_size, part_rows in sorted(tuple(r) for r in totals.collect()):
        bases[part] = (size, count)
        size, count = size + part_size, count + part_rows
    return ordered.mapInArrow(_placed(bases), PLACED), size


def balanced_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text"
                    ) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and gapless slot."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = pick(docs, doc_id=key, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"))
    placed, total = prefix_sums(rows)
    middle = F.col("before") * 2 + F.col("size")
    sharded = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(
        middle * shards / (2 * max(1, total)))).cast("int"))
    starts = sharded.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return sharded.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def shard_sizes(sharded: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
