"""Canonical JSON, SHA-256 digests and order-free dataset digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _portable(name: str, dtype: T.DataType) -> Column:
    """Doubles print differently between engines and writers; exact decimals do not."""
    column = F.col(f"`{name}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return column.cast("decimal(38,6)").cast("string")
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(column))
    return column


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """JSON object of ``columns`` in name order with explicit nulls."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [_portable(c, types[c]).alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(canonical_json(df, columns), 256)


def digest_of(*parts: Column) -> Column:
    """Digest of already canonical text parts; null parts stay distinguishable."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def dataset_digest(df: DataFrame, columns: list[str], fanout: int = 4096) -> DataFrame:
    """One order-free digest of a whole table.

    Row digests are summed per bucket before the shuffle, then the (bounded) bucket sums are folded
    once. A bucket adds up four 60-bit slices of the row digests, so equal rows count as often as
    they occur and no list of rows is ever built.
    """
    rows = df.select(row_digest(df, columns).alias("h"))
    slices = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(
        f"s{i}") for i in range(4)]
    bucket = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % fanout
    buckets = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), *slices)
    text = F.concat_ws(":", "bucket", "n", *[f"s{i}" for i in range(4)])
    return buckets.select(F.struct("bucket", text.alias("text")).alias("b"), "n").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("b")),
                                        lambda b: b["text"]), "|"), 256).alias("digest"))
