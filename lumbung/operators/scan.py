"""Running sums and last-known values over an ordered log, safe for hot keys.

A plain window sorts a whole key in one task. Here the order column is cut into blocks first:
each block is scanned on its own, the (small) block totals are scanned per key, and the carry-in
is joined back. A key that holds a third of the log is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumbung.session import broadcast_if_few, cut_lineage

BLOCK_ROWS = 1_000_000


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, inclusive: bool = True,
            block: int | None = BLOCK_ROWS) -> DataFrame:
    """Add prefix sums and last non-null values per key in ``order``.

    ``order`` is an integer position, unique per key; ``block`` is the span of positions one task
    scans, None scans a key at once (see ``by_length``). With ``inclusive=False`` a row sees only
    the rows before it.
    """
    sums, lasts = sums or {}, lasts or {}
    parts = {f"_v{i}": c for i, c in enumerate([*sums.values(), *lasts.values()])}
    sum_in = dict(zip(sums, list(parts)[:len(sums)]))
    last_in = dict(zip(lasts, list(parts)[len(sums):]))
    rows = df.withColumns(parts)
    if block is None:
        return _scanned(rows, keys, order, sum_in, last_in, inclusive).select(
            *[F.col(f"`{c}`") for c in df.columns if c not in {**sum_in, **last_in}],
            *[F.coalesce(f"_l{o}", F.lit(0)).alias(o) for o in sum_in],
            *[F.col(f"_l{o}").alias(o) for o in last_in])
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    group = [*keys, "_block"]

    totals = rows.groupBy(*group).agg(
        *[F.sum(v).alias(f"_t{o}") for o, v in sum_in.items()],
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_t{o}")
          for o, v in last_in.items()])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *group,
        *[F.sum(f"_t{o}").over(before).alias(f"_c{o}") for o in sum_in],
        *[F.last(f"_t{o}", ignorenulls=True).over(before).alias(f"_c{o}") for o in last_in])

    local = _scanned(rows, group, order, sum_in, last_in, inclusive)
    joined = local.join(carry, group, "left")
    out = {o: F.coalesce(f"_l{o}", F.lit(0)) + F.coalesce(f"_c{o}", F.lit(0)) for o in sum_in}
    out.update({o: F.coalesce(f"_l{o}", f"_c{o}") for o in last_in})
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in out],
                         *[c.alias(o) for o, c in out.items()])


def _scanned(rows: DataFrame, group: list[str], order: str, sums: dict[str, str],
             lasts: dict[str, str], inclusive: bool) -> DataFrame:
    inside = W.partitionBy(*group).orderBy(order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumns({
        **{f"_l{o}": F.sum(v).over(inside) for o, v in sums.items()},
        **{f"_l{o}": F.last(v, ignorenulls=True).over(inside) for o, v in lasts.items()}})


def by_length(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``limit`` rows, and those of longer keys (None without any).

    Keys of few rows need no blocks: where a log has many keys, blocks of positions hold a row or
    two of each, and their totals are as many as the rows.
    """
    longer = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(
        F.col("_n") > limit).drop("_n"))
    if longer.isEmpty():
        return df, None
    longer = broadcast_if_few(longer)
    return df.join(longer, keys, "left_anti"), df.join(longer, keys, "left_semi")


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str],
             block: int = BLOCK_ROWS) -> DataFrame:
    """Add ``previous``: a struct of ``columns`` of the row before, null on the first row."""
    row = F.struct(*columns)
    return running(df, keys, order, lasts={"previous": row}, inclusive=False, block=block)
