"""Limits shared out over sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_source_limit(rows: DataFrame, source: str, position: str, limit: int) -> DataFrame:
    """At most ceil(limit / sources) rows per source, then ``limit`` rows overall.

    The constant bound on the rank lets Spark cut every source before the shuffle.
    """
    sources = rows.agg(F.count_distinct(source)).scalar()
    w = W.partitionBy(source).orderBy(position)
    ranked = rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit)
    share = F.ceil(F.lit(limit) / sources)
    return ranked.where(F.col("_rank") <= share).orderBy(position).limit(limit).drop("_rank")
