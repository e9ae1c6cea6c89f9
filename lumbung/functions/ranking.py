"""Top-k and first-k building blocks that keep hot groups distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group.

    Spark turns the rank filter into a group limit that already runs before the shuffle, so a
    group that holds much of the table is cut down to k rows per map task first.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)


def one_per_group(df: DataFrame, keys: list[str], order: Column, largest: bool = False,
                  null_keys_equal: bool = True) -> DataFrame:
    """The row with the smallest (largest) order value per group, by partial aggregation."""
    pick = F.max_by if largest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n first rows overall: every task keeps n, then the driver side merges n per task."""
    return df.orderBy(*order).limit(n)
